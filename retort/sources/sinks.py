"""Sinks: CSV, TSV, Excel, SDF, SMI."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..chem.molecule import InvalidMolecule, parse
from ..chem.molfile import write_record
from ..functions.numbers import name
from ..roles import Roles

SHEET_ROWS = 1_048_575  #: of data in a sheet: a fixed value of the format, less the header
#: Columns that an export is likely to want, by what their names hold.
RECOMMENDED = ("Canonical SMILES", "InChI", "Is Valid", "from_web", "Substructure_", "Deduplication Strategy")


def recommended_columns(df: DataFrame, roles: Roles, conditions: list[str] | None = None) -> list[str]:
    """Columns with roles, then conditions, then those with a telling name; each once."""
    wanted = [*roles.columns().values(), *(conditions or []), *[c for c in df.columns if any(r in c for r in RECOMMENDED)]]
    return [c for c in dict.fromkeys(wanted) if c in df.columns]


def save(df: DataFrame, path: str, roles: Roles | None = None, columns: list[str] | None = None, single: bool = False, mode: str = "error") -> str:
    """Write by extension and return the path; an unknown one gets .csv. A folder of part files, or one with single.

    Columns that don't exist are left out, with a warning. SMI holds structure and id only. A sheet holds SHEET_ROWS rows
    at most, which come to the driver; more are an error."""
    if lost := [c for c in columns or [] if c not in df.columns]:
        warnings.warn(f"no such columns: {', '.join(lost)}", stacklevel=2)
    roles = roles or Roles()
    extension = PurePosixPath(path).suffix.lower()
    if extension not in (".csv", ".txt", ".tsv", ".xls", ".xlsx", ".sdf", ".smi"):
        path, extension = f"{path}.csv", ".csv"
    chosen = df.select(*[name(c) for c in columns if c in df.columns]) if columns else df
    if single:
        chosen, df = chosen.coalesce(1), df.coalesce(1)
    if extension in (".csv", ".txt", ".tsv"):
        sep = "," if extension == ".csv" else "\t"
        chosen.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    elif extension in (".xls", ".xlsx"):
        rows = chosen.limit(SHEET_ROWS + 1).toPandas()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"more than {SHEET_ROWS} rows don't fit a sheet; write .csv")
        rows.to_excel(path, index=False)
    elif extension == ".smi":
        kept = [c for c in (roles.structure, roles.id) if c and c in df.columns]
        df.select(*[name(c) for c in kept]).write.mode(mode).option("header", True).option("sep", "\t").option("quote", "").csv(path)
    else:
        sdf_records(chosen, df, roles).write.mode(mode).text(path)
    return path


def sdf_records(chosen: DataFrame, df: DataFrame, roles: Roles) -> DataFrame:
    """One SD record per row with a valid structure; all chosen columns as properties."""
    structure = roles.structure
    if not structure or structure not in df.columns:
        raise KeyError("no column of structures")
    names = chosen.columns
    rows = df.select(name(structure).cast("string").alias("__s"), *[name(c).cast("string").alias(f"p{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                try:
                    m = parse(row[0] or "")
                except InvalidMolecule:
                    continue
                out.append(write_record(m, {c: v for c, v in zip(names, row[1:], strict=True) if not pd.isna(v)}))
            yield pd.DataFrame({"value": out})

    return rows.mapInPandas(run, "value string").select(F.col("value"))
