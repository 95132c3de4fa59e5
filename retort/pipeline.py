"""A session over one table: load, standardise, enrich, convert, deduplicate, filter, save, with audit and undo."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import Audit, History
from .chem.rules import Rules
from .chem.standardize import Options
from .functions.numbers import name
from .operators import structure
from .operators.dedup import Dedup
from .operators.enrich import STATUS, Connector, arguments, enrich
from .operators.units import Provider, UnitRules, distinct_units, standardize, standardized_names
from .roles import ROW, VALID, Roles
from .sources import readers, sinks


@dataclass(frozen=True)
class _State:
    df: DataFrame
    roles: Roles
    units_done: bool
    rows: int


class Pipeline:
    """Every step replaces the table by a new DataFrame; none runs before its rows are counted for the audit log.

    audit=False leaves counting out, so that nothing runs until the result is used."""

    def __init__(self, spark: SparkSession, rules: Rules | None = None, unit_rules: UnitRules | None = None, audit: bool = True) -> None:
        self.spark, self.rules, self.unit_rules = spark, rules or Rules(), unit_rules or UnitRules()
        self.roles, self.units_done = Roles(), False
        self._df: DataFrame | None = None
        self._rows = 0
        self._counting = audit
        self._audit, self._history = Audit(), History()
        self._dedup: dict[str, Any] | None = None
        self._dedup_units: tuple[str | None, dict | None] = (None, None)
        self._sources: list[Connector] = []

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise ValueError("no table is loaded")
        return self._df

    def _advance(self, step: str, df: DataFrame, details: str | Callable[[], str] = "", roles: Roles | None = None, units_done: bool | None = None, fresh: bool = False) -> Pipeline:
        """Make df the table. fresh: a load, which can't be undone and whose rows are all new."""
        before = None if fresh else self._rows
        if fresh:
            self._history = History()
        else:
            self._history = self._history.push(_State(self.df, self.roles, self.units_done, self._rows))
        self._df = df
        self.roles = self.roles if roles is None else roles
        self.units_done = self.units_done if units_done is None else units_done
        if self._counting:
            self._rows = df.count()
            self._audit = self._audit.record(step, before, self._rows, details() if callable(details) else details)
        return self

    # Sources and sinks
    def load(self, source: str | list | DataFrame | pd.DataFrame, smiles: str | None = None, cas: str | None = None, name: str | None = None, target: str | None = None, unit: str | None = None, inchikey: str | None = None, id: str | None = None, **options) -> Pipeline:
        df, roles = readers.load(self.spark, source, Roles(smiles, cas, name, target, unit, inchikey, id), **options)
        df = structure.ensure_generated(df)
        if ROW not in df.columns:
            df = df.withColumn(ROW, F.monotonically_increasing_id())
        return self._advance("Data Loading", df, "Loaded", roles, False, fresh=True)

    def result(self) -> DataFrame:
        """The table without hidden columns."""
        return self.df.drop(ROW)

    def save(self, path: str, columns: list[str] | None = None, **how) -> str:
        return sinks.save(self.result(), path, self.roles, columns, **how)

    def recommended_columns(self) -> list[str]:
        return sinks.recommended_columns(self.result(), self.roles, list((self._dedup or {}).get("conditions", ())))

    def preview(self, n: int = 50) -> DataFrame:
        return readers.preview(self.result(), n)

    # Structures
    def _structure(self) -> str:
        s = self.roles.structure
        if not s or s not in self.df.columns:
            raise ValueError("no column of structures")
        return s

    def preprocess(self, n_jobs: int | None = None, progress: Callable[[int, int], None] | None = None, **flags) -> Pipeline:
        options = Options(**flags)
        if not self.roles.smiles:
            raise ValueError("no column of structures")
        df = structure.preprocess(structure.ensure_generated(self.df), self.roles.smiles, options, self.rules, n_jobs=n_jobs).persist()

        def details() -> str:
            n = df.agg(F.count_if(name(VALID)).alias("v"), F.count(F.lit(1)).alias("n")).first()
            return f"Valid: {n.v} | Invalid: {n.n - n.v} | Rules: [{options.summary()}]"

        self._advance("Preprocessing", df, details, self.roles.with_(preprocessed=True))
        if progress:
            progress(self._rows, self._rows)
        return self

    def substructure_search(self, patterns: str | list[str], is_smarts: bool = False) -> Pipeline:
        listed = [patterns] if isinstance(patterns, str) else patterns
        return self._advance("Substructure Search", structure.substructure_search(self.df, self._structure(), listed, is_smarts), ", ".join(listed))

    def filter_by_atom_count(self, **bounds: int | None) -> Pipeline:
        if all(v is None for v in bounds.values()):
            return self
        df = structure.filter_atoms(self.df, self._structure(), **bounds, valid_only=self.roles.preprocessed)
        return self._advance("Atom Count Filter", df, ", ".join(f"{k}={v}" for k, v in bounds.items() if v is not None))

    def calculate_inchi(self) -> Pipeline:
        return self._advance("InChI", structure.add_inchi(self.df, self._structure()))

    # Units
    def standardize_units(self, standard_unit: str | None = None, rules: dict[tuple[str, str], str] | None = None, provider: Provider | None = None, force: bool = False) -> Pipeline:
        r = self.roles
        if not r.target or not r.unit:
            self.units_done = True
            return self
        df = standardize(
            self.df, r.target, r.unit, standard_unit, self.unit_rules.updated(rules), provider, r.structure,
            structure.add_weights, force=force,
        )
        target, unit = standardized_names(r.target, r.unit)
        return self._advance("Unit Standardization", df, f"Standard unit: {standard_unit}", r.with_(target=target, unit=unit), True)

    # Deduplication
    def config_deduplicator(self, conditions: list[str] | None = None, standard_unit: str | None = None, conversion_rules: dict | None = None, **settings) -> Pipeline:
        self._dedup = {"smiles": self._structure(), "conditions": tuple(conditions or ()), **settings}
        self._dedup_units = (standard_unit, conversion_rules)
        Dedup(target=self.roles.target, **self._dedup)
        return self

    def deduplicate(self) -> Pipeline:
        if self._dedup is None:
            raise ValueError("config_deduplicator() comes first")
        standard, rules = self._dedup_units
        if standard and not self.units_done:
            self.standardize_units(standard, rules)
        if self.roles.unit and not self.units_done and len(units := distinct_units(self.df, self.roles.unit)) > 1:
            raise ValueError(f"several units must be standardised first: {units}")
        spec = Dedup(target=self.roles.target, **self._dedup)
        df = spec(self.df)
        if ROW not in df.columns:
            df = df.withColumn(ROW, F.monotonically_increasing_id())
        new = f"{spec.target}_new"
        roles = self.roles.with_(target=new) if spec.target and new in df.columns else self.roles
        return self._advance("Deduplication", df, f"{spec.data_type} | {spec.method} | by {', '.join(spec.keys)}", roles)

    # Enrichment
    def config_web_request(self, sources: list[Connector]) -> Pipeline:
        self._sources = list(sources)
        return self

    def web_request(self, send: str | list[str], request: str | list[str]) -> Pipeline:
        if not self._sources:
            raise ValueError("config_web_request() comes first")
        df, roles = enrich(self.df, self.roles, send, request, self._sources)
        kinds, asked = arguments(send, request)

        def details() -> str:
            n = df.agg(F.count_if(F.col(STATUS) == "Success").alias("s"), F.count(F.lit(1)).alias("n")).first()
            return f"Queried: {', '.join(asked)} (via {' -> '.join(kinds)}) | Sources: {[s.source for s in self._sources]} | Success: {n.s}/{n.n}"

        return self._advance("Web Request", df, details, roles)

    # Rules
    def change_rules(self, change: Callable[[Rules], Rules | tuple[Rules, list[str]]]) -> list[str]:
        """Replace the rules by what change makes of them; returns what it couldn't use."""
        made = change(self.rules)
        self.rules, failed = made if isinstance(made, tuple) else (made, [])
        return failed

    # Session
    def history(self) -> DataFrame:
        return self._audit.to_df(self.spark)

    def undo(self) -> bool:
        """Back to before the last step; False if there is none. The unit and key roles go back with the table."""
        last = self._history.pop()
        if last is None:
            return False
        state, self._history = last
        now = self._rows
        inchikey = self.roles.inchikey
        self._df, self.roles, self.units_done, self._rows = state.df, replace(state.roles, inchikey=inchikey), state.units_done, state.rows
        if self._counting:
            self._audit = self._audit.record("Undo", now, self._rows)
        return True
