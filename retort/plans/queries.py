"""One query for each operator, over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem.rules import SOLVENTS, Rules
from ..chem.standardize import Options
from ..functions import cas
from ..functions.formula import compile_formula
from ..functions.numbers import name, round_figures, significant_figures, to_number, truthy
from ..operators import structure
from ..operators.dedup import STRATEGY, Dedup
from ..operators.enrich import TableConnector, enrich, status_summary
from ..operators.units import UnitRules, distinct_units, standardize
from ..pipeline import Pipeline
from ..roles import CANONICAL, LOG, VALID, Roles
from ..sources import readers, sinks
from .fixtures import CASES, COUNTED, FLAGS, literal, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, key: str | None = None):
    def add(f: Query) -> Query:
        k = key or f.__name__
        QUERIES[k] = f
        if sql:
            SQL[k] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{which}.parquet")


#: Added before means are rounded, so that exact halves fall on one side whatever the order of summation.
NUDGE = 1.7e-7


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/retort-{uuid.uuid4().hex}"


# SQL of the numeric functions
def sql_figures(v: str) -> str:
    return f"greatest(1, length(ltrim(replace(ltrim(CAST({v} AS VARCHAR), '-'), '.', ''), '0')))"


def sql_round(v: str, figures: str) -> str:
    d = f"({figures} - 1 - CAST(floor(log10(abs({v}))) AS INTEGER))"
    return (
        f"CASE WHEN {v} = 0 THEN 0.0 WHEN {d} <= 0 THEN round_even({v}, 0) "
        f"ELSE round_even({v} * pow(10.0, {d}), 0) / pow(10.0, {d}) END"
    )


# Sources and types
@query(f'SELECT *, CAST(NULL AS VARCHAR) AS "{CANONICAL}", CAST(NULL AS VARCHAR) AS "{LOG}", CAST(NULL AS BOOLEAN) AS "{VALID}" FROM part')
def load_roles(spark, sf_dir):
    df, roles = readers.load(spark, table(spark, sf_dir, "part"), Roles(name="p_name", target="p_retailprice", id="p_partkey"))
    return structure.ensure_generated(df)


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def coerce_numeric(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.get_json_object("props", "$.k"))
    return e.select("event_id", to_number(F.col("t"), e.schema["t"].dataType).alias("k"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN true WHEN doc_id % 6 IN (2, 3) THEN false END AS flag FROM labels""")
def boolean_truthy(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(x) for x in ("True", "1", "FALSE", "0", "yes", None)]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", truthy(text).alias("flag"))


# Units
UNIT_SQL = "CASE l_linenumber % 4 WHEN 0 THEN 'g/L' WHEN 1 THEN 'mg/L' WHEN 2 THEN 'ug/L' ELSE 'furlong' END"


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("g/L", "mg/L", "ug/L", "furlong")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").withColumn("unit", unit)


@query(f"SELECT DISTINCT {UNIT_SQL} AS unit FROM lineitem", "distinct_units")
def q_distinct_units(spark, sf_dir):
    return spark.createDataFrame([(u,) for u in distinct_units(assays(spark, sf_dir), "unit")], "unit string")


@query(f"SELECT count(DISTINCT {UNIT_SQL}) > 1 AS several FROM lineitem")
def unit_guard(spark, sf_dir):
    return assays(spark, sf_dir).agg((F.count_distinct("unit") > 1).alias("several"))


def sql_converted(value: str, cases: dict[str, str], standard: str, unit: str) -> str:
    """CASE over units: the standard one as it is, others by formula and rounded."""
    parts = [f"WHEN {unit} = {literal(standard)} THEN {value}"]
    parts += [f"WHEN {unit} = {literal(u)} THEN {sql_round(f'({f})', sql_figures(value))}" for u, f in cases.items()]
    return f"CASE {' '.join(parts)} END"


_LINEAR = sql_converted("l_extendedprice", {"g/L": "l_extendedprice * 1000", "ug/L": "l_extendedprice / 1000"}, "mg/L", "unit")


@query(f"""WITH a AS (SELECT *, {UNIT_SQL} AS unit FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unit, l_extendedprice, round({_LINEAR}, 6) AS converted, 'mg/L' AS standard
FROM a WHERE unit <> 'furlong'""")
def unit_convert_linear(spark, sf_dir):
    got = standardize(assays(spark, sf_dir), "l_extendedprice", "unit", "mg/L")
    return got.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "unit", "l_extendedprice",
        rounded(name("l_extendedprice (Standardized)")).alias("converted"), name("unit (Standardized)").alias("standard"),
    )


@query(f"""WITH a AS (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN '°F' WHEN 1 THEN '°C' ELSE 'degF' END AS unit FROM supplier)
SELECT s_suppkey, unit, round({sql_converted('s_acctbal', {'°F': '(s_acctbal - 32) * 5.0 / 9', 'degF': '(s_acctbal - 32) * 5.0 / 9'}, '°C', 'unit')}, 6) AS celsius FROM a""")
def unit_convert_affine(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("°F"), F.lit("°C"), F.lit("degF")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    got = standardize(table(spark, sf_dir, "supplier").withColumn("unit", unit), "s_acctbal", "unit", "°C")
    return got.select("s_suppkey", "unit", rounded(name("s_acctbal (Standardized)")).alias("celsius"))


_MOLAR = {"mM": "l_quantity * p_retailprice", "uM": "(l_quantity * p_retailprice) / 1000", "M": "l_quantity * p_retailprice * 1000"}
_MOLAR_UNIT = "CASE l_linenumber % 4 WHEN 0 THEN 'mM' WHEN 1 THEN 'mg/L' WHEN 2 THEN 'uM' ELSE 'M' END"


@query(f"""WITH a AS (SELECT l.*, p_retailprice, {_MOLAR_UNIT} AS unit FROM lineitem l JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unit, l_quantity, l_extendedprice,
  round({sql_converted('l_quantity', _MOLAR, 'mg/L', 'unit')}, 6) AS converted FROM a""")
def unit_convert_mw(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("mM", "mg/L", "uM", "M")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    both = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("unit", unit)
    got = standardize(both, "l_quantity", "unit", "mg/L", mw="p_retailprice")
    return got.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "unit", "l_quantity", "l_extendedprice",
        rounded(name("l_quantity (Standardized)")).alias("converted"),
    )


@query(f"SELECT {UNIT_SQL} AS unit, count(*) AS n FROM lineitem WHERE l_linenumber % 4 <> 3 GROUP BY 1")
def unit_drop_unmapped(spark, sf_dir):
    got = standardize(assays(spark, sf_dir), "l_quantity", "unit", "mg/L")
    return got.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice AS converted, 'g/L' AS standard FROM orders")
def unit_passthrough(spark, sf_dir):
    got = standardize(table(spark, sf_dir, "orders").withColumn("unit", F.lit("g/L")), "o_totalprice", "unit", "mg/L")
    return got.select("o_orderkey", name("o_totalprice (Standardized)").alias("converted"), name("unit (Standardized)").alias("standard"))


@query("SELECT from_unit, to_unit, formula FROM (VALUES " + ", ".join(f"({literal(a)}, {literal(b)}, {literal(f)})" for (a, b), f in UnitRules().rules.items()) + ") r(from_unit, to_unit, formula)")
def unit_rules(spark, sf_dir):
    return UnitRules().to_df(spark)


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, {sql_figures('l_extendedprice')} AS figures,
  round({sql_round('(l_extendedprice / 7)', sql_figures('l_quantity'))}, 6) AS value FROM lineitem""")
def sigfig_round(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = li.schema["l_quantity"].dataType
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        significant_figures(F.col("l_extendedprice"), kind).cast("long").alias("figures"),
        rounded(round_figures(F.col("l_extendedprice") / 7, significant_figures(F.col("l_quantity"), kind))).alias("value"),
    )


@query("""SELECT event_id, round(ln(value + 1) + exp(-value / 100) * exp(1) + (value + 1) ** 0.5 - log10(value + 2), 6) AS y
FROM events WHERE value >= 0""")
def formula_functions(spark, sf_dir):
    y = compile_formula("log(x + 1) + exp(-x / 100) * e + (x + 1) ** 0.5 - log10(x + 2)", F.col("value"))
    return table(spark, sf_dir, "events").where("value >= 0").select("event_id", rounded(y).alias("y"))


# Deduplication
def first_rows(df: DataFrame, spec: Dedup, keep: list[str]) -> DataFrame:
    got = spec(df)
    return got.select(*keep, rounded(name(f"{spec.target}_new") + NUDGE, 3).alias("new"), name(STRATEGY).alias("strategy"))


@query("""SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id,
  arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS v, arg_min(p, event_id) FILTER (WHERE p IS NOT NULL) AS p, 'smiles_only' AS strategy
FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 2 = 0 THEN props END AS p FROM events)
GROUP BY user_id, event_type""")
def dedup_smiles_only(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("p"))
    return Dedup("user_id", "v", ("event_type",), data_type="smiles", order_by=("event_id",))(e).withColumnRenamed(STRATEGY, "strategy")


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus,
  arg_min(o_totalprice, o_orderkey) AS o_totalprice, 'smiles_only' AS strategy FROM orders GROUP BY o_custkey""")
def dedup_no_target(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return Dedup("o_custkey", order_by=("o_orderkey",))(o).withColumnRenamed(STRATEGY, "strategy")


@query("""WITH e AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m FROM events WHERE value > 0 WINDOW w AS (PARTITION BY event_id))
SELECT event_id, round(-log10(value) + 1.7e-7, 3) AS new, 'no change' AS strategy FROM e""")
def neg_log10(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "events"), Dedup("event_id", "value", log_transform=True, order_by=("event_id",)), ["event_id"])


def sql_continuous(source: str, keys: str, value: str, order: str, columns: str, bounds: str, label: str, drop: str = "") -> str:
    """The deduplication of continuous values as SQL; keys may be null."""
    return f"""WITH d AS (SELECT *, {value} AS v FROM {source} WHERE {value} IS NOT NULL {drop}),
    s AS (SELECT {keys}, count(*) AS n, avg(v) AS m, stddev_samp(v) AS s, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM d GROUP BY {keys}),
    k AS (SELECT d.*, s.n FROM d JOIN s ON {' AND '.join(f'd.{k.strip()} IS NOT DISTINCT FROM s.{k.strip()}' for k in keys.split(','))} WHERE s.n <= 3 OR {bounds}),
    m AS (SELECT *, avg(v) OVER (PARTITION BY {keys}) AS mean FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(abs(v - mean) / greatest(1.0, abs(mean)), 9), {order}) AS place FROM m)
    SELECT {columns}, round(CASE WHEN n = 1 THEN v ELSE mean END + {NUDGE}, 3) AS new,
      CASE WHEN n = 1 THEN 'no change' WHEN n <= 3 THEN '<=3(mean)' ELSE '{label}' END AS strategy FROM r WHERE place = 1"""


IQR = "v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
SIGMA = "v BETWEEN m - 3 * s AND m + 3 * s"
_CONDITION = "(SELECT *, CASE WHEN event_id % 5 <> 0 THEN event_type END AS c FROM events)"


def conditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("c", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))


for _name, _method, _bounds, _drop in (
    ("dedup_iqr", "IQR", IQR, None), ("dedup_3sigma", "3sigma", SIGMA, None), ("dedup_keepna", "IQR", IQR, False), ("dedup_dropna", "IQR", IQR, True),
):
    def _continuous(spark, sf_dir, method=_method, drop=_drop):
        spec = Dedup("user_id", "value", () if drop is None else ("c",), method=method, dropna_conditions=bool(drop), order_by=("event_id",))
        return first_rows(conditioned(spark, sf_dir), spec, ["event_id", "user_id", "c", "value"])

    query(
        sql_continuous(_CONDITION, "user_id" if _drop is None else "user_id, c", "value", "event_id", "event_id, user_id, c, value", _bounds, _method, "AND c IS NOT NULL" if _drop else ""),
        _name,
    )(_continuous)


@query(sql_continuous("lineitem", "l_orderkey, l_returnflag", "l_quantity", "l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate", "l_orderkey, l_returnflag, l_partkey, l_quantity", "true", "IQR").replace("WHERE s.n <= 3 OR true", f"WHERE s.n <= 3 OR {IQR}"))
def dedup_small_mean(spark, sf_dir):
    order = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    spec = Dedup("l_orderkey", "l_quantity", ("l_returnflag",), method="IQR", order_by=order)
    return first_rows(table(spark, sf_dir, "lineitem"), spec, ["l_orderkey", "l_returnflag", "l_partkey", "l_quantity"])


@query()
def dedup_auto(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "events"), Dedup("user_id", "value", method="auto", order_by=("event_id",)), ["event_id", "user_id", "value"])


@query(sql_continuous("events", "user_id", "value", "event_id", "event_id, user_id, value", "v <= 2 * m", "trimmed"))
def dedup_custom(spark, sf_dir):
    spec = Dedup("user_id", "value", custom=lambda s: (s[s <= 2 * s.mean()], "trimmed"), order_by=("event_id",))
    return first_rows(table(spark, sf_dir, "events"), spec, ["event_id", "user_id", "value"])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS event_id FROM events GROUP BY ALL),
g AS (SELECT user_id, max(votes) AS most, sum(votes) AS n FROM c GROUP BY user_id),
w AS (SELECT c.*, g.n, count(*) OVER (PARTITION BY user_id) AS winners FROM c JOIN g USING (user_id) WHERE votes = most)
SELECT user_id, event_id, event_type AS new, CASE WHEN n = 1 THEN 'no change' ELSE 'vote' END AS strategy FROM w WHERE winners = 1""")
def dedup_vote(spark, sf_dir):
    got = Dedup("user_id", "event_type", data_type="discrete", order_by=("event_id",))(table(spark, sf_dir, "events"))
    return got.select("user_id", "event_id", F.col("event_type_new").alias("new"), name(STRATEGY).alias("strategy"))


@query("""WITH o AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS votes,
    CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 END AS place FROM orders),
b AS (SELECT *, min(place) OVER (PARTITION BY o_custkey) AS best, max(votes) OVER (PARTITION BY o_custkey) AS most FROM o),
x AS (SELECT *, count(DISTINCT CASE WHEN votes = most THEN o_orderstatus END) OVER (PARTITION BY o_custkey) AS winners FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM x
  WHERE n = 1 OR (best IS NOT NULL AND place = best) OR (best IS NULL AND votes = most AND winners = 1))
SELECT o_custkey, o_orderkey, o_orderstatus AS new,
  CASE WHEN n = 1 THEN 'no change' WHEN best = 0 THEN 'priority_P' WHEN best = 1 THEN 'priority_F' ELSE 'vote' END AS strategy
FROM k WHERE r = 1""")
def dedup_priority(spark, sf_dir):
    got = Dedup("o_custkey", "o_orderstatus", data_type="discrete", priority=("P", "F"), order_by=("o_orderkey",))(table(spark, sf_dir, "orders"))
    return got.select("o_custkey", "o_orderkey", F.col("o_orderstatus_new").alias("new"), name(STRATEGY).alias("strategy"))


_ORDER = ("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_shipdate", "l_extendedprice")


@query(sql_continuous(
    f"(SELECT * FROM (SELECT *, {_LINEAR} AS std FROM (SELECT *, {UNIT_SQL} AS unit FROM lineitem)) WHERE std IS NOT NULL)",
    "l_partkey, l_returnflag", "std", ", ".join(_ORDER), "l_partkey, l_returnflag, l_orderkey, unit", IQR, "IQR",
))
def dedup_conditions_full(spark, sf_dir):
    """The flagship: convert units, then one value for each structure and condition."""
    converted = standardize(assays(spark, sf_dir), "l_extendedprice", "unit", "mg/L")
    spec = Dedup("l_partkey", "l_extendedprice (Standardized)", ("l_returnflag",), method="IQR", order_by=_ORDER)
    return first_rows(converted, spec, ["l_partkey", "l_returnflag", "l_orderkey", "unit"])


# CAS numbers and enrichment
_CAS_TEXT = """CASE p_partkey % 5 WHEN 0 THEN 'CAS: ' || body WHEN 1 THEN 'CASRN ' || body WHEN 2 THEN replace(body, '-', '')
  WHEN 3 THEN body ELSE 'n/a' END"""
_CAS_BODY = "CAST(100 + p_partkey AS VARCHAR) || '-' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '-' || CAST(p_partkey % 10 AS VARCHAR)"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    body = F.concat_ws("-", (k + 100).cast("string"), F.lpad((k % 100).cast("string"), 2, "0"), (k % 10).cast("string"))
    text = F.when(k % 5 == 0, F.concat(F.lit("CAS: "), body)).when(k % 5 == 1, F.concat(F.lit("CASRN "), body)).when(k % 5 == 2, F.replace(body, F.lit("-"))).when(k % 5 == 3, body).otherwise("n/a")
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"), text.alias("text"))


_CHECK = "list_sum(list_transform(range(1, length(digits)), lambda i: i * CAST(digits[length(digits) - i] AS INTEGER))) % 10 = CAST(digits[length(digits)] AS INTEGER)"


@query(f"""WITH a AS (SELECT p_partkey, {_CAS_BODY} AS body FROM part), b AS (SELECT *, {_CAS_TEXT} AS text, replace(body, '-', '') AS digits FROM a)
SELECT p_partkey, text, CASE WHEN p_partkey % 5 <> 4 AND {_CHECK} THEN body END AS cas FROM b""")
def cas_clean(spark, sf_dir):
    return numbers(spark, sf_dir).select("p_partkey", "text", cas.clean(F.col("text")).alias("cas"))


@query(f"""WITH a AS (SELECT p_partkey, {_CAS_BODY} AS body FROM part), b AS (SELECT *, replace(body, '-', '') AS digits FROM a)
SELECT p_partkey, {_CHECK} AS ok FROM b""")
def cas_checksum(spark, sf_dir):
    return numbers(spark, sf_dir).select("p_partkey", cas.checksum_ok(F.col("body")).alias("ok"))


def customers(spark: SparkSession, sf_dir: str) -> TableConnector:
    c = table(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return TableConnector("customers", c, {"name": "c_custkey"}, {"iupac": "c_name", "mw": "segment"})


def suppliers(spark: SparkSession, sf_dir: str) -> TableConnector:
    return TableConnector("suppliers", table(spark, sf_dir, "supplier"), {"name": "s_suppkey", "smiles": "s_suppkey"}, {"mw": "s_name"})


def nations(spark: SparkSession, sf_dir: str) -> TableConnector:
    return TableConnector("nations", table(spark, sf_dir, "nation"), {"name": "n_nationkey", "smiles": "n_nationkey"}, {"iupac": "n_name", "mw": "n_name"})


@query("""SELECT o_orderkey, c_name AS iupac_from_web, CASE WHEN c_custkey IS NULL THEN 'Failed' ELSE 'Success' END AS status,
  CASE WHEN c_custkey IS NOT NULL THEN 'customers' END AS source, CASE WHEN c_custkey IS NOT NULL THEN 'name' END AS method
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def enrich_lookup(spark, sf_dir):
    got, _ = enrich(table(spark, sf_dir, "orders"), Roles(name="o_custkey"), "name", "iupac", [customers(spark, sf_dir)])
    return got.select("o_orderkey", "iupac_from_web", F.col("Query_Status").alias("status"), F.col("Data_Source").alias("source"), F.col("Query_Method").alias("method"))


@query("""SELECT o_orderkey, coalesce(c_name, n_name) AS iupac_from_web, coalesce(seg, s_name, n_name) AS mw_from_web,
  nullif(array_to_string(list_filter([CASE WHEN c_name IS NOT NULL THEN 'customers' END,
    CASE WHEN (c_name IS NULL AND n_name IS NOT NULL) OR (seg IS NULL AND s_name IS NULL AND n_name IS NOT NULL) THEN 'nations' END,
    CASE WHEN seg IS NULL AND s_name IS NOT NULL THEN 'suppliers' END], lambda x: x IS NOT NULL), ', '), '') AS source
FROM orders LEFT JOIN (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS seg FROM customer) ON c_custkey = o_custkey
LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey""")
def enrich_source_cascade(spark, sf_dir):
    sources = [customers(spark, sf_dir), suppliers(spark, sf_dir), nations(spark, sf_dir)]
    got, _ = enrich(table(spark, sf_dir, "orders"), Roles(name="o_custkey"), "name", ["iupac", "mw"], sources)
    return got.select("o_orderkey", "iupac_from_web", "mw_from_web", F.col("Data_Source").alias("source"))


_TWO_KINDS = """SELECT o_orderkey, CASE WHEN c_name IS NOT NULL THEN c_name ELSE n_name END AS iupac_from_web,
  CASE WHEN c_name IS NOT NULL THEN 'name' WHEN n_name IS NOT NULL THEN 'smiles' END AS method,
  CASE WHEN coalesce(c_name, n_name) IS NULL THEN 'Failed' ELSE 'Success' END AS status
FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS a, o_orderkey % 40 AS b FROM orders)
LEFT JOIN customer ON c_custkey = a LEFT JOIN nation ON n_nationkey = b"""


def two_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("a"), (F.col("o_orderkey") % 40).alias("b"))
    only_name = TableConnector("customers", table(spark, sf_dir, "customer"), {"name": "c_custkey"}, {"iupac": "c_name"})
    only_smiles = TableConnector("nations", table(spark, sf_dir, "nation"), {"smiles": "n_nationkey"}, {"iupac": "n_name"})
    return enrich(o, Roles(name="a", smiles="b"), ["name", "smiles"], "iupac", [only_name, only_smiles])[0]


@query(_TWO_KINDS)
def enrich_identifier_cascade(spark, sf_dir):
    return two_kinds(spark, sf_dir).select("o_orderkey", "iupac_from_web", F.col("Query_Method").alias("method"), F.col("Query_Status").alias("status"))


@query(f"SELECT status, count(*) AS n FROM ({_TWO_KINDS}) GROUP BY status")
def enrich_status_summary(spark, sf_dir):
    return status_summary(two_kinds(spark, sf_dir)).withColumnRenamed("Query_Status", "status")


# Structures: each part has the structure of its number modulo the cases
def molecules(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    cases = F.broadcast(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, smiles string"))
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(rows)).cast("int").alias("i"))
    return part.join(cases, "i").drop("i")


for _step, _cases in CASES.items():
    def _preprocess(spark, sf_dir, step=_step, cases=_cases):
        got = structure.preprocess(molecules(spark, sf_dir, cases), "smiles", Options(**FLAGS[step]))
        return got.select("p_partkey", "smiles", name(VALID).alias("valid"), name(LOG).alias("log"), name(CANONICAL).alias("canonical"))

    query(
        f"""SELECT p_partkey, smiles, canonical IS NOT NULL AS valid, log, canonical FROM part
        JOIN (VALUES {values(_cases)}) v(i, smiles, log, canonical) ON p_partkey % {len(_cases)} = i""",
        f"preprocess_{_step}",
    )(_preprocess)

_COUNTED_SQL = f"part JOIN (VALUES {values(COUNTED)}) v(i, smiles, heavy, total, mw, ring, hydroxyl) ON p_partkey % {len(COUNTED)} = i"


@query(f"SELECT p_partkey, smiles FROM {_COUNTED_SQL} WHERE heavy BETWEEN 3 AND 13 AND total <= 13")
def atom_count_filter(spark, sf_dir):
    return structure.filter_atoms(molecules(spark, sf_dir, COUNTED), "smiles", min_heavy=3, max_heavy=13, max_total=13)


@query(f"SELECT p_partkey, heavy::INTEGER AS heavy, total::INTEGER AS total FROM {_COUNTED_SQL}")
def atom_counts(spark, sf_dir):
    got = molecules(spark, sf_dir, COUNTED).withColumn("n", structure.atom_counts_column(F.col("smiles")))
    return got.select("p_partkey", "n.heavy", "n.total")


@query(f'SELECT p_partkey, smiles, ring AS "Substructure_c1ccccc1", hydroxyl AS "Substructure_[OX2H]", false AS "Substructure_[" FROM {_COUNTED_SQL}')
def substructure_flags(spark, sf_dir):
    return structure.substructure_search(molecules(spark, sf_dir, COUNTED), "smiles", ["c1ccccc1", "[OX2H]", "["], is_smarts=True)


@query(f"SELECT p_partkey, round(mw, 2) AS mw FROM {_COUNTED_SQL}")
def mol_weight(spark, sf_dir):
    got = structure.add_weights(molecules(spark, sf_dir, COUNTED), "smiles", F.lit(True), "mw")
    return got.select("p_partkey", rounded("mw", 2).alias("mw"))


@query(f"""SELECT pattern FROM (VALUES {values([(s,) for s in SOLVENTS])}) v(i, pattern) UNION SELECT 'CCCO' EXCEPT SELECT 'CCO'""")
def rules_effective(spark, sf_dir):
    rules = Rules().with_solvents("CCCO")[0].without_solvents("OCC")[0]
    return rules.to_df(spark).where("kind = 'solvents'").select("pattern")


# Session, sinks
def _flow(spark: SparkSession, sf_dir: str) -> Pipeline:
    p = Pipeline(spark).load(molecules(spark, sf_dir, COUNTED), smiles="smiles", id="p_partkey")
    return p.preprocess(remove_inorganic=False).filter_by_atom_count(min_heavy=3)


@query(f"""WITH a AS (SELECT count(*) AS n, count(*) FILTER (WHERE heavy >= 3) AS k FROM {_COUNTED_SQL})
SELECT 'Data Loading' AS step, CAST(NULL AS BIGINT) AS before, n AS after, '+' || n AS delta FROM a UNION ALL
SELECT 'Preprocessing', n, n, '0' FROM a UNION ALL SELECT 'Atom Count Filter', n, k, CAST(k - n AS VARCHAR) FROM a""")
def audit_log(spark, sf_dir):
    return _flow(spark, sf_dir).history().select(F.col("Step").alias("step"), name("Rows Before").alias("before"), name("Rows After").alias("after"), F.col("Delta").alias("delta"))


@query(f"SELECT p_partkey, smiles FROM {_COUNTED_SQL}")
def undo_restore(spark, sf_dir):
    p = _flow(spark, sf_dir)
    p.undo()
    p.undo()
    return p.result().select("p_partkey", "smiles")


@query(f'SELECT smiles, p_partkey, CAST(NULL AS VARCHAR) AS "{CANONICAL}", CAST(NULL AS BOOLEAN) AS "{VALID}" FROM {_COUNTED_SQL}')
def export_recommended(spark, sf_dir):
    p = Pipeline(spark, audit=False).load(molecules(spark, sf_dir, COUNTED).withColumn("other", F.lit(1)), smiles="smiles", id="p_partkey")
    return p.result().select(*[name(c) for c in p.recommended_columns()])


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def roundtrip_csv(spark, sf_dir):
    path = scratch(spark) + ".csv"
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    sinks.save(part, path)
    return readers.load(spark, path)[0].select(F.col("p_partkey").cast("long"), "p_name", "p_brand", F.col("p_size").cast("int"), F.col("p_retailprice").cast("double"))


@query(f"SELECT smiles, p_partkey FROM {_COUNTED_SQL} WHERE heavy IS NOT NULL")
def roundtrip_smi(spark, sf_dir):
    path = scratch(spark) + ".smi"
    good = [r for r in COUNTED if r[1]]
    df = molecules(spark, sf_dir, COUNTED).where(F.col("smiles").isin([r[0] for r in good]))
    sinks.save(df, path, Roles(smiles="smiles", id="p_partkey"))
    got, _ = readers.load(spark, path, Roles(smiles="smiles"))
    return got.select("smiles", F.col("p_partkey").cast("long"))


@query(f"SELECT p_partkey, heavy::INTEGER AS heavy, total::INTEGER AS total FROM {_COUNTED_SQL} WHERE heavy IS NOT NULL")
def roundtrip_sdf(spark, sf_dir):
    path = scratch(spark) + ".sdf"
    sinks.save(molecules(spark, sf_dir, COUNTED), path, Roles(smiles="smiles"))
    got, roles = readers.load(spark, path, Roles(smiles="structure"))
    got = got.withColumn("n", structure.atom_counts_column(F.col(roles.smiles)))
    return got.select(F.col("p_partkey").cast("long"), "n.heavy", "n.total")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50")
def preview_head(spark, sf_dir):
    return readers.preview(table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey"), 50)
