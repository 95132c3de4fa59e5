"""Queries of operators that the first list doesn't show on their own: further formats, guards, changed rules, chains,
null structures, providers, known normality."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem.rules import NEUTRALIZATION, SALTS, VALID_ATOMS, Rules
from ..chem.standardize import default_chain
from ..functions.numbers import name
from ..operators import structure
from ..operators.dedup import STRATEGY, Dedup
from ..operators.enrich import CallConnector, GivenUp, arguments, enrich
from ..operators.units import UnitRules, standardize
from ..pipeline import Pipeline
from ..roles import CANONICAL, LOG, VALID, Roles
from ..sources import readers, sinks
from .fixtures import CASES, COUNTED, values
from .queries import (
    IQR, SIGMA, UNIT_SQL, _COUNTED_SQL, assays, first_rows, molecules, query, rounded, scratch, sql_continuous, sql_converted, table,
)


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def refused(call: Callable[[], object]) -> str:
    """The name of the error that a call raises."""
    try:
        call()
    except Exception as e:
        return type(e).__name__
    return "none"


# Sources and sinks
_PART = "p_partkey, p_name, p_brand, p_size, p_retailprice"

for _extension in ("tsv", "txt"):
    def _round_trip(spark, sf_dir, extension=_extension):
        path = f"{scratch(spark)}.{extension}"
        sinks.save(table(spark, sf_dir, "part").select(*_PART.split(", ")), path)
        got = readers.load(spark, path)[0]
        return got.select(F.col("p_partkey").cast("long"), "p_name", "p_brand", F.col("p_size").cast("int"), F.col("p_retailprice").cast("double"))

    query(f"SELECT {_PART} FROM part", f"roundtrip_{_extension}")(_round_trip)


@query(f"SELECT {_PART} FROM part")
def sink_unknown_extension(spark, sf_dir):
    """An unknown extension gets .csv."""
    path = sinks.save(table(spark, sf_dir, "part").select(*_PART.split(", ")), scratch(spark) + ".data")
    got = readers.load(spark, path)[0]
    return got.select(F.col("p_partkey").cast("long"), "p_name", "p_brand", F.col("p_size").cast("int"), F.col("p_retailprice").cast("double"))


@query(f"SELECT p_partkey, heavy::INTEGER AS heavy FROM {_COUNTED_SQL} WHERE heavy IS NOT NULL")
def load_mol(spark, sf_dir):
    df, path = molecules(spark, sf_dir, COUNTED), scratch(spark) + ".mol"
    sinks.sdf_records(df, df, Roles(smiles="smiles")).write.text(path)
    got, roles = readers.load(spark, path, Roles(smiles="structure"))
    counted = got.withColumn("n", structure.atom_counts_column(F.col(roles.smiles)))
    return counted.select(F.col("p_partkey").cast("long"), "n.heavy")


_SMILES = [(r[0],) for r in COUNTED]


@query(f'SELECT smiles AS "SMILES" FROM (VALUES {values(_SMILES)}) v(i, smiles)')
def load_list(spark, sf_dir):
    return readers.load(spark, [s for s, in _SMILES])[0]


@query(f"SELECT smiles FROM (VALUES {values([('CCO',), ('c1ccccc1',), ('CC(=O)O',)])}) v(i, smiles)")
def load_pasted_text(spark, sf_dir):
    return readers.from_text(spark, "  CCO\n\n\tc1ccccc1 \r\n CC(=O)O\n", "smiles")


_SOURCE_GUARDS = [
    ("unknown extension", "ValueError"), ("no such file", "FileNotFoundError"), ("unknown kind", "ValueError"),
    ("missing column", "KeyError"), ("no table", "ValueError"), ("no structures to write", "KeyError"),
]


@query(f"SELECT guard, error FROM (VALUES {values(_SOURCE_GUARDS)}) v(i, guard, error)")
def source_guards(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    calls = {
        "unknown extension": lambda: readers.load(spark, "table.parquet"), "no such file": lambda: readers.load(spark, scratch(spark) + ".csv"),
        "unknown kind": lambda: readers.load(spark, 7), "missing column": lambda: readers.load(spark, part, Roles(smiles="nothing")),
        "no table": lambda: Pipeline(spark).preprocess(), "no structures to write": lambda: sinks.save(part, scratch(spark) + ".sdf"),
    }
    return listed(spark, [(k, refused(f)) for k, f in calls.items()], "guard string, error string")


@query("SELECT role, col FROM (VALUES ('id', 'p_partkey'), ('name', 'p_name'), ('target', 'p_retailprice'), ('target', 'p_retailprice_new')) v(role, col)")
def roles_follow(spark, sf_dir):
    """Roles of a loaded table, and the target's after a deduplication."""
    p = Pipeline(spark, audit=False).load(table(spark, sf_dir, "part").withColumn("s", F.col("p_brand")), smiles="s", target="p_retailprice", name="p_name", id="p_partkey")
    before = [(k, v) for k, v in p.roles.columns().items() if k in ("id", "name", "target")]
    p.config_deduplicator(method="IQR").deduplicate()
    return listed(spark, [*before, ("target", p.roles.target)], "role string, col string")


# Rules and chains
@query(f"""SELECT symbol FROM (VALUES {values([(a,) for a in sorted(VALID_ATOMS)])}) v(i, symbol) WHERE symbol NOT IN ('Te', 'At')
UNION SELECT 'B' UNION SELECT 'Hg' UNION SELECT 'refused: Xx' UNION SELECT 'refused: Zr'""")
def rules_atoms(spark, sf_dir):
    rules, bad = Rules().with_atoms("B", "Hg", "Xx")
    rules, missing = rules.without_atoms("Te", "At", "Zr")
    kept = rules.to_df(spark).where("kind = 'atoms'").select(F.col("pattern").alias("symbol"))
    return kept.unionByName(listed(spark, [(f"refused: {s}",) for s in bad + missing], "symbol string"))


@query(f"""SELECT pattern, product FROM (VALUES {values([r for r in NEUTRALIZATION])}) v(i, pattern, product)
WHERE pattern NOT IN ('[n+;H]', '[S-;X1]') UNION SELECT '[S-;X1]', '[SH]'""")
def rules_neutralization(spark, sf_dir):
    rules = Rules().with_neutralization("[S-;X1]", "[SH]").without_neutralization("[n+;H]")
    return rules.to_df(spark).where("kind = 'neutralization'").select("pattern", "product")


@query(f"""SELECT pattern FROM (VALUES {values([(s,) for s in SALTS])}) v(i, pattern) WHERE pattern NOT IN ('CCN(CC)CC', 'Br')
UNION SELECT 'CCCCCCS' UNION SELECT 'refused: [#6' UNION SELECT 'refused: CCCCCCCCCC'""")
def rules_salts(spark, sf_dir):
    rules, bad = Rules().with_salts("CCCCCCS", "C(C)(=O)O", "[#6")
    rules, missing = rules.without_salts("N(CC)(CC)CC", "Br", "CCCCCCCCCC")
    kept = rules.to_df(spark).where("kind = 'salts'").select("pattern")
    return kept.unionByName(listed(spark, [(f"refused: {s}",) for s in bad + missing], "pattern string"))


_KEPT_SALT = [("C[NH3+].[Cl-]", True, "CN"), ("CCS.CCCCCCS", True, "CCS"), ("CCS.Br", True, "Br.CCS"), ("CCO", True, "CCO"), (None, False, None)]


@query(f"""SELECT p_partkey, smiles, valid, canonical FROM part
JOIN (VALUES {values(_KEPT_SALT)}) v(i, smiles, valid, canonical) ON p_partkey % {len(_KEPT_SALT)} = i""")
def preprocess_changed_rules(spark, sf_dir):
    rules = Rules().with_salts("CCCCCCS")[0].without_salts("Br")[0]
    got = structure.preprocess(molecules(spark, sf_dir, _KEPT_SALT), "smiles", rules=rules)
    return got.select("p_partkey", "smiles", name(VALID).alias("valid"), name(CANONICAL).alias("canonical"))


_CHAIN = [("N[C@@H](C)C(=O)O.Cl", "CC(N)C(=O)O"), ("CCO.CCO", "CCO"), ("CC[S-].[K+]", "CCS"), ("CC[Hg]CC", None), ("bad(", None)]


@query(f"SELECT p_partkey, smiles, canonical FROM part JOIN (VALUES {values(_CHAIN)}) v(i, smiles, canonical) ON p_partkey % {len(_CHAIN)} = i")
def preprocess_chain(spark, sf_dir):
    """Own steps in place of the usual ones."""
    got = structure.preprocess(molecules(spark, sf_dir, _CHAIN), "smiles", steps=default_chain().own_steps)
    return got.select("p_partkey", "smiles", name(CANONICAL).alias("canonical"))


@query(f"""SELECT p_partkey, smiles, canonical IS NOT NULL AS valid, log, canonical FROM part
JOIN (VALUES {values(CASES['default'])}) v(i, smiles, log, canonical) ON p_partkey % {len(CASES['default'])} = i""")
def preprocess_parallel(spark, sf_dir):
    got = structure.preprocess(molecules(spark, sf_dir, CASES["default"]), "smiles", n_jobs=3)
    return got.select("p_partkey", "smiles", name(VALID).alias("valid"), name(LOG).alias("log"), name(CANONICAL).alias("canonical"))


_TAILS = ("Cl", "[Na+]", "CO", "O")


@query(f"""SELECT p_partkey, true AS valid, heavy, heavy + 2 * (a + b + c) + 7 AS total
FROM (SELECT p_partkey, a, b, c, (a + b + c + 7)::INTEGER AS heavy FROM
  (SELECT p_partkey, 1 + p_partkey % 17 AS a, 1 + (p_partkey // 17) % 13 AS b, 1 + (p_partkey // 221) % 11 AS c FROM part))""")
def preprocess_distinct(spark, sf_dir):
    """Structures that mostly differ from each other (9,724 in turn), with counter-ions and solvents to strip."""
    k = F.col("p_partkey")
    chain = lambda n: F.repeat(F.lit("C"), n.cast("int"))
    a, b, c = 1 + k % 17, 1 + F.floor(k / 17) % 13, 1 + F.floor(k / 221) % 11
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.floor(k / 2431) % len(_TAILS) + 1).cast("int"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(chain(a), F.lit("N("), chain(b), F.lit(")c1ccc("), chain(c), F.lit(")cc1."), tail).alias("smiles"))
    got = structure.preprocess(part, "smiles").withColumn("n", structure.atom_counts_column(name(CANONICAL)))
    return got.select("p_partkey", name(VALID).alias("valid"), "n.heavy", F.col("n.total").cast("long").alias("total"))


@query(f"""SELECT 'Valid: ' || count(heavy) || ' | Invalid: ' || count(*) - count(heavy) ||
  ' | Rules: [isotopes, hydrogens, salts, solvents, radicals, neutralize]' AS details FROM {_COUNTED_SQL}""")
def audit_details(spark, sf_dir):
    p = Pipeline(spark).load(molecules(spark, sf_dir, COUNTED), smiles="smiles").preprocess(remove_inorganic=False, remove_isotopes=True)
    return p.history().where("Step = 'Preprocessing'").select(F.col("Details").alias("details"))


# Units
@query(f"""WITH a AS (SELECT *, {UNIT_SQL} AS unit FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unit, l_quantity,
  round({sql_converted('l_quantity', {'g/L': 'l_quantity * 1000', 'ug/L': 'l_quantity / 1000', 'furlong': 'l_quantity * 2 + 1'}, 'mg/L', 'unit')}, 6) AS converted FROM a""")
def unit_provider(spark, sf_dir):
    """A provider is asked for what the rules lack; formulas that aren't allowed count as none."""
    got = standardize(assays(spark, sf_dir), "l_quantity", "unit", "mg/L", provider=lambda u, s: {"furlong": "x * 2 + 1"}.get(u))
    return got.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "unit", "l_quantity", rounded(name("l_quantity (Standardized)")).alias("converted"))


@query(f"""WITH a AS (SELECT *, {UNIT_SQL} AS unit FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unit, l_quantity,
  round({sql_converted('l_quantity', {'ug/L': 'l_quantity / 1000', 'g/L': 'l_quantity ** 2'}, 'mg/L', 'unit')}, 6) AS converted FROM a WHERE unit <> 'furlong'""")
def unit_custom_rule(spark, sf_dir):
    got = standardize(assays(spark, sf_dir), "l_quantity", "unit", "mg/L", UnitRules().with_rule("g/L", "mg/L", "x ** 2"))
    return got.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "unit", "l_quantity", rounded(name("l_quantity (Standardized)")).alias("converted"))


_FORMULAS = [
    ("x * 2", "none"), ("log10(x) + e", "none"), ("__import__('os')", "ValueError"), ("x.real", "ValueError"), ("y + 1", "ValueError"),
    ("2 + 2", "ValueError"), ("x if x else 1", "ValueError"), ("x *", "ValueError"), ("mw * x / 1000", "none"),
]


@query(f"SELECT formula, error FROM (VALUES {values(_FORMULAS)}) v(i, formula, error)")
def unit_formula_guards(spark, sf_dir):
    return listed(spark, [(f, refused(lambda f=f: UnitRules().with_rule("a", "b", f))) for f, _ in _FORMULAS], "formula string, error string")


# Deduplication
@query("""SELECT s, min(event_id) AS event_id, 'smiles_only' AS strategy
FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN event_type || user_id END AS s FROM events) WHERE s IS NOT NULL GROUP BY s""")
def dedup_null_structures(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.concat("event_type", F.col("user_id").cast("string"))).alias("s"))
    return Dedup("s", data_type="smiles", order_by=("event_id",))(e).withColumnRenamed(STRATEGY, "strategy")


_DEDUP_GUARDS = [("missing column", "KeyError"), ("unknown type", "ValueError"), ("unknown method", "ValueError"), ("not callable", "ValueError"), ("not configured", "ValueError"), ("several units", "ValueError")]


@query(f"SELECT guard, error FROM (VALUES {values(_DEDUP_GUARDS)}) v(i, guard, error)")
def dedup_guards(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mixed = part.withColumn("unit", F.when(F.col("p_partkey") % 2 == 0, "g/L").otherwise("mg/L"))
    loaded = lambda df, **roles: Pipeline(spark, audit=False).load(df, smiles="p_name", target="p_retailprice", **roles)
    calls = {
        "missing column": lambda: Dedup("nothing")(part), "unknown type": lambda: Dedup("p_name", data_type="text"),
        "unknown method": lambda: Dedup("p_name", "p_retailprice", method="median"), "not callable": lambda: Dedup("p_name", custom=3),
        "not configured": lambda: loaded(part).deduplicate(),
        "several units": lambda: loaded(mixed, unit="unit").config_deduplicator().deduplicate(),
    }
    return listed(spark, [(k, refused(f)) for k, f in calls.items()], "guard string, error string")


#: Groups whose normality is known: weights of eleven men (Shapiro and Wilk 1965: W = 0.79, p < 0.01); the same skew in
#: powers of two; quantiles of the normal distribution; an even scale.
_KNOWN = {
    "men": ("IQR", [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]), "powers": ("IQR", [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]),
    "normal": ("3sigma", [-1.54, -1.0, -0.66, -0.38, -0.12, 0.12, 0.38, 0.66, 1.0, 1.54]), "even": ("3sigma", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]),
}
_KNOWN_ROWS = [(g, label, float(v)) for g, (label, some) in _KNOWN.items() for v in some]


@query(
    sql_continuous(
        f"(SELECT i, g, label, CAST(x AS DOUBLE) AS x FROM (VALUES {values(_KNOWN_ROWS)}) t(i, g, label, x))", "g", "x", "i", "g, x",
        f"CASE label WHEN 'IQR' THEN {IQR} ELSE {SIGMA} END", "label",
    ).replace("ELSE 'label' END", "ELSE label END"),
)
def dedup_auto_known(spark, sf_dir):
    rows = listed(spark, [(i, g, x) for i, (g, _, x) in enumerate(_KNOWN_ROWS)], "i int, g string, x double")
    return first_rows(rows, Dedup("g", "x", method="auto", order_by=("i",)), ["g", "x"])


# Enrichment
def _service(key: str, kind: str, properties: list[str]) -> dict:
    """A service that fails for some, says that others are unknown, and answers the rest."""
    if int(key) % 5 == 0:
        raise GivenUp
    if int(key) % 5 == 1:
        raise TimeoutError
    return {p: f"{kind} {key}" if int(key) % 5 != 2 else None for p in properties}


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 2 THEN 'name ' || n_nationkey END AS iupac_from_web,
  CASE WHEN n_nationkey % 5 > 2 THEN 'Success' ELSE 'Failed' END AS status FROM nation""")
def enrich_service(spark, sf_dir):
    """Calls with retries; an answer without the property, a failure and a refusal alike count as failed."""
    service = CallConnector("service", _service, interval=0, retries=2, delay=0)
    got, _ = enrich(table(spark, sf_dir, "nation"), Roles(name="n_nationkey"), "name", "iupac", [service])
    return got.select("n_nationkey", "iupac_from_web", F.col("Query_Status").alias("status"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 2 THEN 'name ' || n_nationkey ELSE n_name END AS iupac_from_web,
  CASE WHEN n_nationkey % 5 > 2 THEN 'service' ELSE 'table' END AS source FROM nation""")
def enrich_service_then_table(spark, sf_dir):
    from ..operators.enrich import TableConnector

    nation = table(spark, sf_dir, "nation")
    service = CallConnector("service", _service, interval=0, retries=1, delay=0, threads=4, parallel=2)
    fallback = TableConnector("table", nation, {"name": "n_nationkey"}, {"iupac": "n_name"})
    got, _ = enrich(nation, Roles(name="n_nationkey"), "name", "iupac", [service, fallback])
    return got.select("n_nationkey", "iupac_from_web", F.col("Data_Source").alias("source"))


_ASKED = [("name", "iupac", "none"), ("cas", "colour", "ValueError"), ("colour", "cas", "ValueError"), (" CAS ", "Iupac", "none")]


@query(f"SELECT send, request, error FROM (VALUES {values(_ASKED)}) v(i, send, request, error)")
def enrich_arguments(spark, sf_dir):
    return listed(spark, [(s, r, refused(lambda s=s, r=r: arguments(s, r))) for s, r, _ in _ASKED], "send string, request string, error string")


@query("SELECT 'cas' AS role, 'cas_from_web' AS col UNION ALL SELECT 'smiles', 'smiles_from_web'")
def enrich_roles(spark, sf_dir):
    """Roles that had no column follow what was found."""
    service = CallConnector("service", lambda k, kind, asked: {p: k for p in asked}, interval=0)
    _, roles = enrich(table(spark, sf_dir, "nation"), replace(Roles(), name="n_name"), "name", ["cas", "smiles"], [service])
    return listed(spark, [(k, v) for k, v in roles.columns().items() if k != "name"], "role string, col string")
