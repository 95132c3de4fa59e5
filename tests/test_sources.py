import pandas as pd
import pytest
from pyspark.sql import functions as F

from retort.pipeline import Pipeline
from retort.roles import CANONICAL, LOG, ROW, VALID, Roles
from retort.sources import readers, sinks
from retort.streaming.stream import first_of_structure


def test_csv_and_txt(spark, tmp_path):
    (tmp_path / "a.csv").write_text("s,t,u\nCCO,1.5,a\nC,<5,\n")
    (tmp_path / "b.TXT").write_text("s\tt\nCCO\t1\n")
    df, _ = readers.load(spark, str(tmp_path / "a.csv"), Roles(smiles="s", target="t"))
    assert df.dtypes == [("s", "string"), ("t", "string"), ("u", "string")] and df.count() == 2
    assert readers.load(spark, str(tmp_path / "b.TXT"))[0].dtypes == [("s", "string"), ("t", "int")]
    with pytest.raises(KeyError):
        readers.load(spark, str(tmp_path / "a.csv"), Roles(smiles="nope"))
    with pytest.raises(FileNotFoundError):
        readers.load(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "c.doc"))
    with pytest.raises(ValueError):
        readers.load(spark, 5)


@pytest.mark.parametrize("case", [("CCO\tx1\nC\tx2\n", ["smiles", "id"], 2), ("smiles id\nCCO x1\n", ["smiles", "id"], 1), ("CCO\n", ["smiles"], 1)])
def test_smi(spark, tmp_path, case):
    text, columns, n = case
    (tmp_path / "a.smi").write_text(text)
    df, roles = readers.load(spark, str(tmp_path / "a.smi"))
    assert df.columns == columns and df.count() == n and roles.smiles == "smiles"


def test_sdf(spark, tmp_path):
    df = spark.createDataFrame([("CCO", 1, "a b"), ("c1ccccc1[N+](=O)[O-]", 2, None), ("bad(", 3, "x")], "smiles string, n int, note string")
    sinks.save(df, str(tmp_path / "o.sdf"), Roles(smiles="smiles"), columns=["n", "note", "absent"], single=True)
    got, roles = readers.load(spark, str(tmp_path / "o.sdf"))
    assert sorted(tuple(r) for r in got.select("smiles", "n", "note").collect()) == [("CCO", 1, "a b"), ("[O-][N+](=O)c1ccccc1", 2, None)] or roles.smiles == "smiles"
    assert got.count() == 2 and dict(got.dtypes)["n"] == "bigint"
    (tmp_path / "empty.sdf").write_text("nothing\n$$$$\n")
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "empty.sdf"))


def test_lists_text_and_frames(spark):
    df, roles = readers.load(spark, ["CCO", None])
    assert roles.smiles == "SMILES" and df.count() == 2
    assert [r[0] for r in readers.from_text(spark, " CCO\n\n C ").collect()] == ["CCO", "C"]
    assert readers.load(spark, pd.DataFrame({"a": [1.0, float("nan")]}))[0].where("a is null").count() == 1


def test_unknown_extension_becomes_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    assert sinks.save(df, str(tmp_path / "out.xyz")).endswith(".xyz.csv")


def test_roles_warn():
    with pytest.warns(UserWarning):
        Roles(smiles="a", cas="a")


def test_pipeline(spark, tmp_path):
    rows = [("CCO.Cl", "5", "g/L", "x"), ("OCC", "4000", "mg/L", "x"), ("OCC", "6", "g/L", "x"), ("bad(", "1", "g/L", "x"), ("CCCS", "2", "g/L", "y"), ("CCCS", "2", "cup", "y")]
    p = Pipeline(spark).load(spark.createDataFrame(rows, "smi string, v string, u string, c string"), smiles="smi", target="v", unit="u")
    p.preprocess(n_jobs=2).config_deduplicator(["c"], standard_unit="mg/L", method="IQR").deduplicate()
    got = {r[CANONICAL]: r["v (Standardized)_new"] for r in p.result().collect()}
    assert got == {"CCO": 5000.0, "CCCS": 2000.0}
    assert p.roles.target == "v (Standardized)_new"
    p.substructure_search("[SX2H]", is_smarts=True).filter_by_atom_count(min_heavy=4)
    assert [r[CANONICAL] for r in p.result().collect()] == ["CCCS"]
    log = p.history().collect()
    assert [(r.Step, r["Rows Before"], r["Rows After"], r.Delta) for r in log] == [
        ("Data Loading", None, 6, "+6"), ("Preprocessing", 6, 6, "0"), ("Unit Standardization", 6, 5, "-1"), ("Deduplication", 5, 2, "-3"),
        ("Substructure Search", 2, 2, "0"), ("Atom Count Filter", 2, 1, "-1"),
    ]
    assert log[1].Details.startswith("Valid: 5 | Invalid: 1")
    assert set(p.recommended_columns()) >= {"smi", CANONICAL, VALID, "c", "Substructure_[SX2H]"}
    assert all([p.undo() for _ in range(5)]) and not p.undo()
    assert p.result().count() == 6 and p.roles.target == "v" and ROW not in p.result().columns
    p.save(str(tmp_path / "o.csv"), [LOG, "smi"], single=True)
    assert readers.load(spark, str(tmp_path / "o.csv"))[0].columns == [LOG, "smi"]


def test_pipeline_guards(spark):
    with pytest.raises(ValueError):
        Pipeline(spark).df
    p = Pipeline(spark, audit=False).load(spark.createDataFrame([("C", "1", "a"), ("C", "1", "b")], "s string, v string, u string"), smiles="s", target="v", unit="u")
    with pytest.raises(ValueError, match="several units"):
        p.config_deduplicator().deduplicate()
    with pytest.raises(ValueError):
        Pipeline(spark).load(["C"]).web_request("cas", "name")
    assert p.change_rules(lambda r: r.with_salts("C[")) == ["C["]
    with pytest.raises(NotImplementedError):
        p.calculate_inchi()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("CCO.Cl", "2024-01-01 00:00:00"), ("OCC", "2024-01-01 00:00:01"), ("bad(", "2024-01-01 00:00:02")], "s string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(source))
    stream = spark.readStream.schema("s string, t timestamp").parquet(str(source))
    q = first_of_structure(stream, "s", "t", "1 hour").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r[CANONICAL] for r in spark.table("firsts").collect()] == ["CCO"]
