"""Structure operators: each one Arrow-batched function over a column of SMILES.

Rules are compiled once per Python worker, and within a batch every distinct structure is worked on once.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..chem import backend
from ..chem.molecule import InvalidMolecule, parse
from ..chem.rules import Rules
from ..chem.smarts import Target, UnsupportedSmarts, compile_smarts, from_molecule, has_match
from ..chem.standardize import Options, Standardizer, Step, atom_counts, weight
from ..functions.numbers import name, truthy
from ..roles import CANONICAL, LOG, VALID


def _mapped(series: pd.Series, f: Callable[[str | None], object]) -> list:
    known = {s: f(s) for s in {None if pd.isna(s) else s for s in series}}
    return [known[None if pd.isna(s) else s] for s in series]


@cache
def _standardizer(rules: Rules, options: Options) -> Standardizer:
    return Standardizer(rules, options)


def preprocess_column(smiles: Column, options: Options | None = None, rules: Rules | None = None, steps: list[tuple[str, Step]] | None = None) -> Column:
    """struct(is_valid, log, smiles) of a column of structures; steps replaces the usual ones."""
    options, rules = options or Options(), rules or Rules()

    @F.pandas_udf("is_valid boolean, log string, smiles string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = _standardizer(rules, options) if steps is None else Standardizer(rules, options, steps)
        for b in batches:
            yield pd.DataFrame(_mapped(b, work), columns=["is_valid", "log", "smiles"])

    return run(smiles.cast("string"))


def preprocess(df: DataFrame, smiles: str, options: Options | None = None, rules: Rules | None = None, steps: list[tuple[str, Step]] | None = None, n_jobs: int | None = None) -> DataFrame:
    """Set Is Valid, Processing Log and Canonical SMILES; no row is dropped. n_jobs spreads rows over so many tasks;
    without it, a table that would be read in fewer parts than there are cores, by the optimizer's estimate of its size,
    is spread over them, since a structure costs milliseconds and moving it next to nothing."""
    if n_jobs and n_jobs > 0:
        df = df.repartition(n_jobs)
    elif not df.isStreaming:
        state, cores = df.sparkSession._jsparkSession.sessionState(), df.sparkSession.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < cores * state.conf().filesMaxPartitionBytes():
            df = df.repartition(cores)
    done = df.withColumn("__r", preprocess_column(name(smiles), options, rules, steps))
    return done.withColumns({CANONICAL: F.col("__r.smiles"), LOG: F.col("__r.log"), VALID: F.col("__r.is_valid")}).drop("__r")


def ensure_generated(df: DataFrame) -> DataFrame:
    """The generated columns with their types, whatever was there before."""
    kinds = {CANONICAL: "string", LOG: "string"}
    out = {c: name(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in kinds.items()}
    out[VALID] = truthy(name(VALID)) if VALID in df.columns else F.lit(None).cast("boolean")
    return df.withColumns(out)


def atom_counts_column(smiles: Column) -> Column:
    """struct(heavy, total), null without a valid structure."""

    @F.pandas_udf("heavy int, total int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([x or (None, None) for x in _mapped(s, atom_counts)], columns=["heavy", "total"], dtype="Int32")

    return run(smiles)


def filter_atoms(df: DataFrame, smiles: str, min_heavy: int | None = None, max_heavy: int | None = None, min_total: int | None = None, max_total: int | None = None, valid_only: bool = False) -> DataFrame:
    """Rows whose structure has atom counts within the bounds, ends included. Without bounds: all rows."""
    bounds = {("heavy", ">="): min_heavy, ("heavy", "<="): max_heavy, ("total", ">="): min_total, ("total", "<="): max_total}
    if all(v is None for v in bounds.values()):
        return df
    if valid_only and VALID in df.columns:
        df = df.where(name(VALID))
    s = name(smiles)
    df = df.where(s.isNotNull() & (F.trim(s) != "")).withColumn("__n", atom_counts_column(s)).where("__n.heavy IS NOT NULL")
    for (which, op), v in bounds.items():
        if v is not None:
            df = df.where(f"__n.{which} {op} {int(v)}")
    return df.drop("__n")


def _compile(pattern: str, is_smarts: bool):
    try:
        return compile_smarts(pattern) if is_smarts else from_molecule(parse(pattern), pattern)
    except (UnsupportedSmarts, InvalidMolecule):
        return None


def substructure_column(smiles: Column, patterns: list[str], is_smarts: bool = False) -> Column:
    """Array of booleans, one per pattern; a pattern or structure that can't be read matches nothing."""

    @F.pandas_udf("array<boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [_compile(p, is_smarts) for p in patterns]

        def look(s: str | None) -> list[bool]:
            try:
                t = Target(parse(s or ""))
            except InvalidMolecule:
                return [False] * len(patterns)
            return [p is not None and has_match(p, t, chiral=True) for p in compiled]

        for b in batches:
            yield pd.Series(_mapped(b, look))

    return run(smiles)


def substructure_search(df: DataFrame, smiles: str, patterns: str | list[str], is_smarts: bool = False) -> DataFrame:
    """Add Substructure_<pattern> for each pattern; a column from an earlier search is replaced."""
    patterns = [patterns] if isinstance(patterns, str) else list(dict.fromkeys(patterns))
    for p in patterns:
        if _compile(p, is_smarts) is None:
            warnings.warn(f"no pattern that can be searched for, it matches nothing: {p}", stacklevel=2)
    found = df.withColumn("__hits", substructure_column(name(smiles), patterns, is_smarts))
    return found.withColumns({f"Substructure_{p}": F.col("__hits")[i] for i, p in enumerate(patterns)}).drop("__hits")


def search(df: DataFrame, smiles: str, pattern: str, is_smarts: bool = False) -> DataFrame:
    """The rows that hold the pattern."""
    return df.where(substructure_column(name(smiles), [pattern], is_smarts)[0])


def weight_column(smiles: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_mapped(s, weight), dtype="float64")

    return run(smiles)


def add_weights(df: DataFrame, smiles: str, wanted: Column, out: str) -> DataFrame:
    """Molecular weight in column out where wanted; other rows' structures never reach Python."""
    return df.withColumn(out, weight_column(F.when(wanted, name(smiles).cast("string"))))


def add_inchi(df: DataFrame, smiles: str) -> DataFrame:
    """Add InChI; needs RDKit."""
    if backend.rdkit() is None:
        raise NotImplementedError("InChI needs RDKit")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_mapped(s, lambda x: backend.inchi(x)[0]), dtype="object")

    return df.withColumn("InChI", run(name(smiles)))
