"""Sources: CSV, TSV, Excel, SDF, MOL, SMI, lists, text, Spark and pandas DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..chem.molfile import read_record
from ..functions.numbers import name
from ..roles import Roles

EXTENSIONS = (".csv", ".txt", ".tsv", ".xls", ".xlsx", ".sdf", ".mol", ".smi")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, source: str | list | DataFrame | pd.DataFrame, roles: Roles | None = None, **options) -> tuple[DataFrame, Roles]:
    """The table and its roles. FileNotFoundError, ValueError for an unknown kind, KeyError for missing columns."""
    roles = roles or Roles()
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, pd.DataFrame):
        df = spark.createDataFrame(source)
    elif isinstance(source, list):
        df = from_list(spark, source, roles.smiles or "SMILES")
        roles = roles.with_(smiles=roles.smiles or "SMILES")
    elif isinstance(source, str):
        return load_file(spark, source, roles, **options)
    else:
        raise ValueError(f"unknown kind of source: {type(source).__name__}")
    df = no_nan(df)
    roles.check(df)
    return df, roles


def load_file(spark: SparkSession, path: str, roles: Roles, **options) -> tuple[DataFrame, Roles]:
    extension = PurePosixPath(path).suffix.lower()
    if extension not in EXTENSIONS:
        raise ValueError(f"unknown extension: {extension}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    spare: tuple[str, ...] = ()
    if extension in (".csv", ".txt", ".tsv"):
        df = read_delimited(spark, path, options.pop("sep", "," if extension == ".csv" else "\t"), **options)
    elif extension in (".xls", ".xlsx"):
        df = read_excel(spark, path, **options)
    elif extension == ".smi":
        df = read_smi(spark, path, roles.smiles or "smiles", **options)
        roles = roles.with_(smiles=roles.smiles or "smiles")
    else:
        roles = roles.with_(smiles=roles.smiles or "smiles")
        df, spare = read_sdf(spark, path, roles.smiles), ("smiles",)
    df = stable_types(df)
    roles.check(df, spare)
    return df, roles


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(name(c)), name(c)) for c in floats}) if floats else df


def stable_types(df: DataFrame) -> DataFrame:
    return no_nan(df)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, infer: bool = True, **options) -> DataFrame:
    """Text with separators; a column of numbers only gets a numeric type, any other stays text."""
    reader = spark.read.option("header", header).option("sep", sep).option("inferSchema", infer)
    for k, v in {"quote": '"', "escape": '"', "multiLine": False, "ignoreLeadingWhiteSpace": False, **options}.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def read_excel(spark: SparkSession, path: str, sheet_name: str | int | None = None, **options) -> DataFrame:
    """One sheet, read on the driver. Several sheets: ValueError unless sheet_name is given."""
    with pd.ExcelFile(path) as book:
        if sheet_name is None:
            if len(book.sheet_names) > 1:
                raise ValueError(f"several sheets, choose one with sheet_name: {book.sheet_names}")
            sheet_name = 0
        return spark.createDataFrame(book.parse(sheet_name, **options))


def read_smi(spark: SparkSession, path: str, smiles: str = "smiles", header: bool | None = None) -> DataFrame:
    """Structures and names separated by a tab, else a blank. The first line is a header if it holds the name of the
    structure column; without header the first two columns are called after it and `id`."""
    first = spark.read.text(path).head(1)
    line = first[0].value if first else ""
    sep = "\t" if "\t" in line else " "
    header = smiles in line if header is None else header
    df = spark.read.option("sep", sep).option("header", header).option("quote", "").csv(path)
    if not header:
        df = df.toDF(*[{0: smiles, 1: "id"}.get(i, str(i)) for i in range(len(df.columns))])
    column = smiles if smiles in df.columns else df.columns[0]
    return df.withColumn(column, F.trim(name(column)))


def read_sdf(spark: SparkSession, path: str, smiles: str = "smiles") -> DataFrame:
    """A row per record whose structure can be read, its properties as columns.

    Records are split by the JVM reader; a first pass collects the property names, of which there are few. ValueError
    if no record can be read."""
    records = spark.read.option("lineSep", "$$$$").text(path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [read_record(v) for v in b["value"]]
            yield pd.DataFrame([(s, p) for s, p in rows if s is not None], columns=["__smiles", "__props"])

    parsed = records.mapInPandas(run, "__smiles string, __props map<string,string>").persist()
    keys = sorted(r.k for r in parsed.select(F.explode(F.map_keys("__props")).alias("k")).distinct().collect())
    if parsed.isEmpty():
        raise ValueError(f"no structure could be read: {path}")
    columns = [F.col("__props")[k].alias(k) for k in keys]
    if smiles not in keys:
        columns.insert(0, F.col("__smiles").alias(smiles))
    return typed(parsed.select(*columns))


def typed(df: DataFrame) -> DataFrame:
    """Text columns that hold numbers only become numeric."""
    text = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not text:
        return df
    whole = df.agg(*[F.bool_and(name(c).rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"i{k}") for k, c in enumerate(text)], *[F.bool_and(name(c).rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")).alias(f"f{k}") for k, c in enumerate(text)]).first()
    kinds = {c: "long" if whole[f"i{k}"] else "double" if whole[f"f{k}"] else None for k, c in enumerate(text)}
    return df.withColumns({c: F.trim(name(c)).try_cast(t) for c, t in kinds.items() if t})


def from_list(spark: SparkSession, items: list[str], column: str = "SMILES") -> DataFrame:
    return spark.createDataFrame([(None if i is None else str(i),) for i in items], f"`{column}` string")


def from_text(spark: SparkSession, text: str, column: str = "SMILES") -> DataFrame:
    """Pasted text: a structure per line, blank lines left out."""
    return from_list(spark, [s for line in text.splitlines() if (s := line.strip())], column)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
