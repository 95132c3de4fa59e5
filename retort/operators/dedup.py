"""Deduplication of measurements by structure and conditions.

All statistics of a group are windows over one partitioning, and the choice of its row is an aggregate by the same
keys, so a whole deduplication shuffles once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.numbers import name, to_number
from ..functions.shapiro import shapiro_p
from ..roles import ROW

STRATEGY = "Deduplication Strategy"
_TIE = 9  #: decimals in which distances to the mean, as parts of it, are compared: ties don't hang on the last bit


def _shapiro():
    @F.pandas_udf("double")
    def p_value(s: pd.Series) -> float:
        return shapiro_p(s)

    return p_value


@dataclass(frozen=True)
class Dedup:
    """What to deduplicate by, and how. Rows count in the order of order_by (default: as read)."""

    smiles: str
    target: str | None = None
    conditions: tuple[str, ...] = ()
    data_type: str | None = "continuous"
    method: str = "auto"
    priority: tuple[Any, ...] = ()
    p_threshold: float = 0.05
    custom: Callable[[pd.Series], Any] | None = None
    log_transform: bool = False
    dropna_conditions: bool = False
    order_by: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.data_type not in ("smiles", "discrete", "continuous", None):
            raise ValueError(f"unknown data type: {self.data_type}")
        if self.custom is not None and not callable(self.custom):
            raise ValueError("the custom method must be callable")
        if self.data_type in ("continuous", None) and self.target and self.method not in ("auto", "IQR", "3sigma"):
            raise ValueError(f"unknown method for continuous data: {self.method}")

    @property
    def keys(self) -> list[str]:
        return [self.smiles, *self.conditions]

    def __call__(self, df: DataFrame) -> DataFrame:
        missing = [c for c in [*self.keys, *([self.target] if self.target else [])] if c not in df.columns]
        if missing:
            raise KeyError(f"missing columns: {missing}")
        columns = [c for c in df.columns if c != ROW]
        df = df.where(name(self.smiles).isNotNull())
        if self.dropna_conditions:
            for c in self.conditions:
                df = df.where(name(c).isNotNull())
        if self.order_by:
            df = df.withColumn(ROW, F.struct(*[name(c) for c in self.order_by]))
        elif ROW not in df.columns:
            df = df.withColumn(ROW, F.monotonically_increasing_id())
        if self.target is None or self.data_type == "smiles":
            return self._first(df, columns)
        if self.data_type == "discrete":
            return self._discrete(df, columns)
        return self._continuous(df, columns)

    def _first(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Per group the first value of each column that isn't null; keys come first."""
        rest = [c for c in columns if c not in self.keys]
        first = [
            F.min_by(name(c), F.when(name(c).isNotNull(), F.col(ROW))).alias(c) for c in rest
        ]
        grouped = df.groupBy(*[name(k) for k in self.keys])
        out = grouped.agg(*first) if first else df.select(*[name(k) for k in self.keys]).distinct()
        return out.withColumn(STRATEGY, F.lit("smiles_only"))

    def _pick(self, df: DataFrame, columns: list[str], order: Column, value: Column, strategy: Column) -> DataFrame:
        """Per group the row of least order, with its new value and strategy."""
        whole = F.struct(*[name(c) for c in columns], value.alias("__new"), strategy.alias("__how"))
        got = df.groupBy(*[name(k).alias(f"__k{i}") for i, k in enumerate(self.keys)]).agg(F.min_by(whole, order).alias("r"))
        return got.select(
            *[F.col("r").getField(c).alias(c) for c in columns],
            F.col("r.__new").alias(f"{self.target}_new"), F.col("r.__how").alias(STRATEGY),
        )

    def _window(self):
        return Window.partitionBy(*[name(k) for k in self.keys])

    def _discrete(self, df: DataFrame, columns: list[str]) -> DataFrame:
        t = name(self.target)
        df = df.where(t.isNotNull())
        w, same = self._window(), Window.partitionBy(*[name(k) for k in self.keys], t)
        df = df.withColumns({"__n": F.count(F.lit(1)).over(w), "__votes": F.count(F.lit(1)).over(same)})
        df = df.withColumn("__first", F.col(ROW) == F.min(ROW).over(same))
        df = df.withColumn("__most", F.max("__votes").over(w))
        df = df.withColumn("__winners", F.sum(F.when(F.col("__first") & (F.col("__votes") == F.col("__most")), 1).otherwise(0)).over(w))
        rank = F.lit(None).cast("int")
        for i, v in reversed(list(enumerate(self.priority))):
            rank = F.when(t.cast("string") == F.lit(str(v)), F.lit(i)).otherwise(rank)
        df = df.withColumn("__rank", rank).withColumn("__best", F.min("__rank").over(w))
        single, chosen = F.col("__n") == 1, F.col("__best").isNotNull()
        df = df.where(
            single | (chosen & (F.col("__rank") == F.col("__best")))
            | (~chosen & (F.col("__votes") == F.col("__most")) & (F.col("__winners") == 1))
        )
        labels = F.lit("vote")
        for i, v in enumerate(self.priority):
            labels = F.when(F.col("__best") == i, F.lit(f"priority_{v}")).otherwise(labels)
        return self._pick(df, columns, F.col(ROW), t, F.when(single, F.lit("no change")).otherwise(labels))

    def _continuous(self, df: DataFrame, columns: list[str]) -> DataFrame:
        v = to_number(name(self.target), df.schema[self.target].dataType)
        if self.log_transform:
            df = df.where(v > 0).withColumn(self.target, -F.log10(v))
            v = name(self.target)
        df = df.where(v.isNotNull()).withColumn("__v", v)
        if self.custom:
            return self._custom(df, columns)
        w, x = self._window(), F.col("__v")
        df = df.withColumn("__n", F.count(F.lit(1)).over(w))
        few = F.col("__n") <= 3
        stats: dict[str, Column] = {}
        if self.method != "IQR":
            stats |= {"__m": F.avg(x).over(w), "__s": F.stddev_samp(x).over(w)}
        if self.method != "3sigma":
            stats |= {"__q": F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(w)}
        if self.method == "auto":
            stats |= {"__p": _shapiro()(x).over(w)}
        df = df.withColumns(stats)
        sigma, reach = x.between(F.col("__m") - 3 * F.col("__s"), F.col("__m") + 3 * F.col("__s")), None
        if self.method != "3sigma":
            low, high = F.col("__q")[0], F.col("__q")[1]
            reach = x.between(low - 1.5 * (high - low), high + 1.5 * (high - low))
        if self.method == "auto":
            normal = F.col("__p") > self.p_threshold
            keep, label = F.when(normal, sigma).otherwise(reach), F.when(normal, F.lit("3sigma")).otherwise(F.lit("IQR"))
        else:
            keep, label = (sigma, F.lit("3sigma")) if self.method == "3sigma" else (reach, F.lit("IQR"))
        df = df.where(few | keep).withColumn("__mean", F.avg(x).over(w))
        strategy = F.when(F.col("__n") == 1, F.lit("no change")).when(few, F.lit("<=3(mean)")).otherwise(label)
        new = F.when(F.col("__n") == 1, x).otherwise(F.col("__mean"))
        order = F.struct(F.round(F.abs(x - F.col("__mean")) / F.greatest(F.lit(1.0), F.abs("__mean")), _TIE).alias("d"), F.col(ROW).alias("r"))
        return self._pick(df, columns, order, new, strategy)

    def _custom(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """custom(values) gives (kept values or a final number, label) for groups of more than three."""
        custom, new, keys = self.custom, f"{self.target}_new", [f"__k{i}" for i in range(len(self.keys))]
        schema = StructType([*[df.schema[c] for c in columns], StructField(new, DoubleType()), StructField(STRATEGY, StringType())])

        def choose(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(ROW, kind="stable").reset_index(drop=True)
            x = g["__v"]
            if len(g) == 1:
                mean, label, kept = x.iloc[0], "no change", x
            elif len(g) <= 3:
                mean, label, kept = x.mean(), "<=3(mean)", x
            else:
                result, label = custom(x)
                kept = result if isinstance(result, pd.Series) else x
                mean = kept.mean() if isinstance(result, pd.Series) else float(result)
            if kept.empty:
                return pd.DataFrame(columns=[f.name for f in schema])
            row = g.loc[[((kept - mean).abs() / max(1.0, abs(mean))).round(_TIE).idxmin()], columns].copy()
            row[new], row[STRATEGY] = mean, label
            return row

        slim = df.select(*[name(c) for c in columns], "__v", F.col(ROW), *[name(k).alias(a) for k, a in zip(self.keys, keys, strict=True)])
        order = df.schema[ROW].dataType
        if isinstance(order, StructType):  # a plain rank sorts the same in pandas
            place = Window.partitionBy(*keys).orderBy(ROW)
            slim = slim.withColumn(ROW, F.row_number().over(place))
        return slim.groupBy(*keys).applyInPandas(choose, schema)


def chain(steps: list[dict[str, Any]]) -> list[Dedup]:
    """Several deduplications from their settings."""
    return [Dedup(**s) for s in steps]
