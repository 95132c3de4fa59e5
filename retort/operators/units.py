"""Unit standardisation: formulas by (unit, standard unit) as one CASE expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import compile_formula, parse, uses_weight
from ..functions.numbers import name, round_figures, settled, to_number, with_figures

# The built-in conversions, by unit and the unit it becomes.
DEFAULT_RULES = {
    ("g/L", "mg/L"): "x * 1000",
    ("mg/L", "g/L"): "x / 1000",
    ("mg/L", "ug/L"): "x * 1000",
    ("mg/L", "µg/L"): "x * 1000",
    ("ug/L", "mg/L"): "x / 1000",
    ("µg/L", "mg/L"): "x / 1000",
    ("mg/L", "ng/L"): "x * 1000000",
    ("ng/L", "mg/L"): "x / 1000000",
    ("ml/L", "ul/L"): "x * 1000",
    ("ul/L", "ml/L"): "x / 1000",
    ("%", "ppm"): "x * 10000",
    ("ppm", "%"): "x / 10000",
    ("vol%", "ppm"): "x * 10000",
    ("wt%", "ppm"): "x * 10000",
    ("ppm", "ppb"): "x * 1000",
    ("ppb", "ppm"): "x / 1000",
    ("%", "g/L"): "x * 10",
    ("%", "mg/L"): "x * 10000",
    ("d", "h"): "x * 24",
    ("day", "h"): "x * 24",
    ("h", "d"): "x / 24",
    ("h", "min"): "x * 60",
    ("min", "h"): "x / 60",
    ("d", "min"): "x * 1440",
    ("min", "s"): "x * 60",
    ("s", "min"): "x / 60",
    ("mmHg", "Pa"): "x * 133.322",
    ("mm Hg", "Pa"): "x * 133.322",
    ("Torr", "Pa"): "x * 133.322",
    ("psi", "Pa"): "x * 6894.76",
    ("atm", "Pa"): "x * 101325",
    ("kPa", "Pa"): "x * 1000",
    ("°C", "K"): "x + 273.15",
    ("degC", "K"): "x + 273.15",
    ("K", "°C"): "x - 273.15",
    ("°F", "°C"): "(x - 32) * 5/9",
    ("degF", "°C"): "(x - 32) * 5/9",
    ("°C", "°F"): "(x * 9/5) + 32",
    ("mM", "M"): "x / 1000",
    ("uM", "M"): "x / 1000000",
    ("µM", "M"): "x / 1000000",
    ("nM", "M"): "x / 1000000000",
    ("M", "mM"): "x * 1000",
    ("M", "uM"): "x * 1000000",
    ("M", "g/L"): "x * mw",
    ("M", "mg/L"): "x * mw * 1000",
    ("mM", "g/L"): "(x * mw) / 1000",
    ("mM", "mg/L"): "x * mw",
    ("uM", "mg/L"): "(x * mw) / 1000",
    ("uM", "ug/L"): "x * mw",
    ("µM", "ug/L"): "x * mw",
    ("nM", "ng/L"): "x * mw",
    ("g/L", "M"): "x / mw",
    ("mg/L", "M"): "x / (mw * 1000)",
    ("g/L", "mM"): "(x * 1000) / mw",
    ("mg/L", "mM"): "x / mw",
    ("mg/L", "uM"): "(x * 1000) / mw",
    ("ug/L", "uM"): "x / mw",
    ("µg/L", "µM"): "x / mw",
    ("ng/L", "nM"): "x / mw",
}

Provider = Callable[[str, str], str | None]
Weights = Callable[[DataFrame, str, Column, str], DataFrame]


@dataclass(frozen=True)
class UnitRules:
    rules: dict[tuple[str, str], str] = field(default_factory=lambda: dict(DEFAULT_RULES))

    def with_rule(self, unit: str, standard: str, formula: str) -> UnitRules:
        """ValueError unless the formula is allowed."""
        parse(formula)
        return UnitRules({**self.rules, (unit, standard): formula})

    def updated(self, rules: dict[tuple[str, str], str] | None) -> UnitRules:
        out = self
        for (a, b), f in (rules or {}).items():
            out = out.with_rule(a, b, f)
        return out

    def get(self, unit: str, standard: str) -> str | None:
        return self.rules.get((unit, standard))

    def suggest(self, units: list[str], standard: str) -> dict[str, str]:
        """unit: built-in formula or "" for each unit that needs one."""
        return {u: self.get(u, standard) or "" for u in units if u != standard}

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(a, b, f) for (a, b), f in self.rules.items()]
        return spark.createDataFrame(rows, "from_unit string, to_unit string, formula string")


def distinct_units(df: DataFrame, unit: str) -> list[str]:
    """The units that occur, sorted; few by nature."""
    u = name(unit)
    return sorted(r.u for r in df.select(u.alias("u")).where(u.isNotNull() & (u != "")).distinct().collect())


def standardized_names(target: str, unit: str) -> tuple[str, str]:
    return f"{target} (Standardized)", f"{unit} (Standardized)"


def standardize(df: DataFrame, target: str, unit: str, standard: str | None, rules: UnitRules | None = None, provider: Provider | None = None, smiles: str | None = None, weights: Weights | None = None, mw: str | None = None, force: bool = False) -> DataFrame:
    """Add the standardised target and unit.

    With one unit or none in the data both are copied as they are, unless force. Otherwise values of the standard unit
    are cast, others converted by their formula and rounded to the significant figures they were given with; rows
    without a usable formula or value go. provider is asked for missing formulas. Formulas with mw take the column mw
    of df, or weights(df, smiles column, rows that need it, new column), which computes it for those rows only.
    """
    new_target, new_unit = standardized_names(target, unit)
    units = distinct_units(df, unit)
    if len(units) <= 1 and not force:
        return df.withColumns({new_target: name(target), new_unit: name(unit)})
    if not standard:
        raise ValueError(f"several units ({', '.join(units)}): a standard unit must be given")
    rules = rules or UnitRules()
    formulas: dict[str, str] = {}
    for u in units:
        if u == standard:
            continue
        f = rules.get(u, standard)
        if not f and provider and (f := provider(u, standard)):
            try:
                parse(f)
            except ValueError:
                f = None
        if f:
            formulas[u] = f
    heavy = [u for u, f in formulas.items() if uses_weight(f)]
    columns = df.columns
    weight: Column | None = None
    if heavy and mw:
        weight = name(mw).cast("double")
    elif heavy:
        if not smiles or smiles not in df.columns or weights is None:
            raise ValueError("a formula needs molecular weights, but there is no column of structures")
        df = weights(df, smiles, name(unit).isin(*heavy), "__mw")
        weight = F.col("__mw")
    x, u = F.col("__x"), name(unit)
    df = df.withColumn("__x", to_number(name(target), df.schema[target].dataType))
    converted = F.lit(None).cast("double")
    for key, f in formulas.items():
        converted = F.when(u == key, compile_formula(f, x, weight)).otherwise(converted)
    # Rows go before anything is rounded: a predicate on the rounded value would be pushed down with all that it is made of.
    df = df.withColumn("__value", F.when(u == standard, x).otherwise(converted))
    df = df.where(F.col("__value").isNotNull() & ~F.isnan("__value"))
    df = with_figures(df, target, "__figures")
    value = F.when(u == standard, F.col("__value")).otherwise(round_figures(F.col("__value"), F.col("__figures")))
    return df.withColumn(new_target, settled(value)).withColumn(new_unit, F.lit(standard)).select(*[name(c) for c in [*columns, new_target, new_unit]])
