"""Enrichment by keyed lookups: every distinct identifier is looked up once, sources in order of priority."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cas
from ..functions.numbers import name
from ..roles import Roles

PROPERTIES = ("smiles", "cas", "iupac", "mw", "name")
SENDABLE = ("smiles", "cas", "name")
STATUS, SOURCE, METHOD = "Query_Status", "Data_Source", "Query_Method"


class Connector(Protocol):
    """A source of properties. lookup() takes ids (a column key) and gives key and a string column per property."""

    source: str

    def lookup(self, ids: DataFrame, kind: str, properties: list[str]) -> DataFrame: ...


@dataclass(frozen=True)
class TableConnector:
    """A table with one row per key; keys says which of its columns each kind of identifier matches."""

    source: str
    table: DataFrame
    keys: dict[str, str]
    columns: dict[str, str]  #: property: column

    def lookup(self, ids: DataFrame, kind: str, properties: list[str]) -> DataFrame:
        if kind not in self.keys:
            return ids.select("key", *[F.lit(None).cast("string").alias(p) for p in properties]).where("false")
        found = [
            F.max(name(self.columns[p]).cast("string")).alias(p) if p in self.columns else F.max(F.lit(None).cast("string")).alias(p)
            for p in properties
        ]
        return self.table.groupBy(name(self.keys[kind]).cast("string").alias("key")).agg(*found).join(ids, "key", "left_semi")


class Pace:
    """At most limit calls between pauses of so many seconds; 0 or less: no limit. Shared by the threads of a worker."""

    def __init__(self, limit: int, pause: float) -> None:
        self.limit, self.pause, self.used, self.lock = limit, pause, 0, threading.Lock()

    def wait(self, sleep: Callable[[float], None]) -> None:
        with self.lock:
            if self.limit > 0 and self.pause > 0 and self.used >= self.limit:
                sleep(self.pause)
                self.used = 0
            self.used += 1


class GivenUp(Exception):
    """The service says that asking again is pointless (as HTTP 4xx does)."""


@dataclass(frozen=True)
class CallConnector:
    """A service asked once per identifier: fetch(identifier, kind, properties) gives a dict.

    Calls run in threads inside each task; parallel says how many tasks there are at most. Interval and batch_limit hold
    for the whole job: each of several tasks waits so many times as long, and takes its share of the limit. A call is
    tried retries times with a growing delay; GivenUp ends it at once. The result is persisted by enrich(), so that nothing is asked
    twice."""

    source: str
    fetch: Callable[[str, str, list[str]], dict]
    interval: float = 0.3
    retries: int = 3
    delay: float = 30.0
    threads: int = 1
    parallel: int = 1
    batch_limit: int = 1500
    rest: float = 300.0

    def ask(self, key: str, kind: str, properties: list[str], pace: Pace, sleep: Callable[[float], None] = time.sleep) -> dict:
        for attempt in range(self.retries):
            sleep(self.interval)
            pace.wait(sleep)
            try:
                return self.fetch(key, kind, properties)
            except GivenUp:
                break
            except Exception:
                if attempt + 1 < self.retries:
                    sleep(self.delay * (attempt + 1))
        return {}

    def lookup(self, ids: DataFrame, kind: str, properties: list[str]) -> DataFrame:
        share = replace(self, interval=self.interval * self.parallel, batch_limit=-(-self.batch_limit // self.parallel))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pace = Pace(share.batch_limit, share.rest)
            with ThreadPoolExecutor(self.threads) as pool:
                for b in batches:
                    got = list(pool.map(lambda k: share.ask(k, kind, properties, pace), b["key"]))
                    rows = [[k, *[None if g.get(p) is None else str(g[p]) for p in properties]] for k, g in zip(b["key"], got, strict=True)]
                    yield pd.DataFrame(rows, columns=["key", *properties], dtype=object)

        schema = "key string, " + ", ".join(f"{p} string" for p in properties)
        return ids.select("key").repartition(self.parallel, "key").mapInPandas(run, schema)


def cascade(ids: DataFrame, kind: str, properties: list[str], sources: list[Connector]) -> DataFrame:
    """(key, property..., Data_Source): each property from the first source that has it.

    A source is asked only for the keys that still lack a property."""
    have = ids.select("key", *[F.lit(None).cast("string").alias(p) for p in properties], F.array().cast("array<string>").alias("__by"))
    for s in sources:
        lacking = have.where(" OR ".join(f"{p} IS NULL" for p in properties)).select("key")
        found = s.lookup(lacking, kind, properties).select(F.col("key").alias("__k"), *[F.col(p).alias(f"__{p}") for p in properties])
        gives = F.lit(False)
        for p in properties:
            gives = gives | (F.col(p).isNull() & F.col(f"__{p}").isNotNull())
        have = have.join(found, F.col("key") == F.col("__k"), "left").select(
            "key", *[F.coalesce(p, f"__{p}").alias(p) for p in properties],
            F.when(gives, F.array_append("__by", F.lit(s.source))).otherwise(F.col("__by")).alias("__by"),
        )
    by = F.array_join(F.array_sort(F.array_distinct("__by")), ", ")
    return have.select("key", *properties, F.when(F.size("__by") > 0, by).alias(SOURCE))


def arguments(send: str | Iterable[str], request: str | Iterable[str]) -> tuple[list[str], list[str]]:
    """Identifier kinds in order and properties, lower case, each once; ValueError for unknown ones."""
    listed = lambda v: [v] if isinstance(v, str) else list(v)
    kinds = list(dict.fromkeys(x.strip().lower() for x in listed(send)))
    asked = sorted({x.strip().lower() for x in listed(request)})
    unknown = [x for x in [*kinds, *asked] if x not in PROPERTIES]
    if unknown or not kinds or not asked:
        raise ValueError(f"unknown or missing identifiers or properties: {unknown}")
    return kinds, asked


def enrich(df: DataFrame, roles: Roles, send: str | Iterable[str], request: str | Iterable[str], sources: list[Connector], persist: bool | None = None) -> tuple[DataFrame, Roles]:
    """Add <property>_from_web, Query_Status, Data_Source and Query_Method, and the roles that follow from it.

    Identifier kinds are tried in order; a row is done once any property is found for it, and values already there are
    kept. Kinds without a column are skipped. persist keeps lookups in memory and on disk (default: if any source is a
    service)."""
    kinds, asked = arguments(send, request)
    persist = any(not isinstance(s, TableConnector) for s in sources) if persist is None else persist
    empty = F.lit(None).cast("string")
    for p in asked:
        c = f"{p}_from_web"
        df = df.withColumn(c, name(c).cast("string") if c in df.columns else empty)
    df = df.withColumns({
        SOURCE: name(SOURCE).cast("string") if SOURCE in df.columns else empty,
        METHOD: name(METHOD).cast("string") if METHOD in df.columns else empty, STATUS: F.lit("Pending"),
    })
    columns = df.columns
    for kind in kinds:
        column = getattr(roles, kind, None) if kind in SENDABLE else None
        if not column or column not in df.columns:
            continue
        key = cas.clean(name(column)) if kind == "cas" else F.when(F.trim(name(column).cast("string")) != "", name(column).cast("string"))
        df = df.withColumn("__id", F.when(F.col(STATUS) == "Pending", key))
        ids = df.select(F.col("__id").alias("key")).where(F.col("key").isNotNull()).distinct()
        found = cascade(ids, kind, asked, sources)
        if persist:
            found = found.persist()
        found = found.select(F.col("key").alias("__key"), *[F.col(p).alias(f"__{p}") for p in asked], F.col(SOURCE).alias("__source"))
        hit = F.lit(False)
        for p in asked:
            hit = hit | (F.coalesce(F.col(f"__{p}"), F.lit("")) != "")
        df = df.join(found, F.col("__id") == F.col("__key"), "left").withColumn("__hit", hit)
        changes = {f"{p}_from_web": F.when(F.col("__hit"), F.coalesce(f"{p}_from_web", f"__{p}")).otherwise(F.col(f"{p}_from_web")) for p in asked}
        changes |= {
            SOURCE: F.when(F.col("__hit"), F.col("__source")).otherwise(F.col(SOURCE)),
            METHOD: F.when(F.col("__hit"), F.lit(kind)).otherwise(F.col(METHOD)),
            STATUS: F.when(F.col("__hit"), F.lit("Success")).otherwise(F.col(STATUS)),
        }
        df = df.withColumns(changes).select(*[name(c) for c in columns])
    df = df.withColumn(STATUS, F.when(F.col(STATUS) == "Pending", F.lit("Failed")).otherwise(F.col(STATUS)))
    new = {r: f"{r}_from_web" for r in ("cas", "name") if r in asked}
    if "smiles" in asked and not roles.preprocessed:
        new["smiles"] = "smiles_from_web"
    return df, roles.with_(**new)


def status_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(STATUS).agg(F.count(F.lit(1)).alias("n"))
