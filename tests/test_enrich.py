import pytest

from retort.functions import cas
from retort.operators.enrich import CallConnector, GivenUp, Pace, TableConnector, arguments, cascade, enrich, status_summary
from retort.roles import Roles


@pytest.mark.parametrize("case", [("7732-18-5", "7732-18-5"), ("CAS: 64-17-5", "64-17-5"), ("CASRN 67-56-1", "67-56-1"), ("cas#50-00-0", "50-00-0"), ("50000", "50-00-0"), ("7732-18-4", None), ("n/a", None), ("", None), ("abc", None), ("64175.0", None), (None, None), ("12", None)])
def test_cas(spark, case):
    text, want = case
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cas.clean(df.t).alias("c")).first().c == want


def sources(spark):
    a = spark.createDataFrame([("64-17-5", None, "ethanol"), ("50-00-0", "C=O", None)], "cas string, smi string, n string")
    b = spark.createDataFrame([("64-17-5", "CCO", "alcohol")], "cas string, smi string, n string")
    columns = {"smiles": "smi", "name": "n"}
    return [TableConnector("A", a, {"cas": "cas"}, columns), TableConnector("B", b, {"cas": "cas", "name": "n"}, columns)]


def test_cascade(spark):
    ids = spark.createDataFrame([("64-17-5",), ("50-00-0",), ("x",)], "key string")
    got = {r.key: (r.smiles, r.name, r.Data_Source) for r in cascade(ids, "cas", ["name", "smiles"], sources(spark)).collect()}
    assert got == {"64-17-5": ("CCO", "ethanol", "A, B"), "50-00-0": ("C=O", None, "A"), "x": (None, None, None)}


def test_enrich(spark):
    df = spark.createDataFrame([(1, "CAS 64-17-5", None), (2, "64175", "alcohol"), (3, "bad", "alcohol"), (4, None, None)], "i int, c string, n string")
    got, roles = enrich(df, Roles(cas="c", name="n"), ["CAS ", "name", "iupac"], ["smiles", "name"], sources(spark))
    rows = {r.i: (r.smiles_from_web, r.Data_Source, r.Query_Method, r.Query_Status) for r in got.collect()}
    assert rows == {1: ("CCO", "A, B", "cas", "Success"), 2: ("CCO", "A, B", "cas", "Success"), 3: ("CCO", "B", "name", "Success"), 4: (None, None, None, "Failed")}
    assert (roles.smiles, roles.name, roles.cas) == ("smiles_from_web", "name_from_web", "c")
    assert {r.Query_Status: r.n for r in status_summary(got).collect()} == {"Success": 3, "Failed": 1}
    again, _ = enrich(got.withColumn("smiles_from_web", got.c), Roles(cas="c", preprocessed=True), "cas", "smiles", sources(spark))
    assert {r.i: r.smiles_from_web for r in again.collect()}[1] == "CAS 64-17-5"


def test_arguments():
    assert arguments(" CAS", ["Name", "name"]) == (["cas"], ["name"])
    for bad in (("cas", "colour"), ("phone", "name"), ([], "name")):
        with pytest.raises(ValueError):
            arguments(*bad)


def test_service(spark):
    def fetch(key, kind, properties):
        if key == "gone":
            raise GivenUp
        if key == "down":
            raise OSError
        return {"name": f"{kind}:{key}"}

    c = CallConnector("S", fetch, interval=0, retries=2, delay=0, threads=2)
    df = spark.createDataFrame([("a",), ("gone",), ("down",), ("a",), (" ",)], "n string")
    got, _ = enrich(df, Roles(name="n"), "name", "name", [c])
    assert sorted((r.n, r.name_from_web or "") for r in got.collect()) == [(" ", ""), ("a", "name:a"), ("a", "name:a"), ("down", ""), ("gone", "")]


def test_retries_and_pauses():
    calls, naps = [], []

    def fetch(key, kind, properties):
        calls.append(key)
        raise OSError

    c = CallConnector("S", fetch, interval=1, retries=3, delay=10)
    assert c.ask("a", "name", ["name"], Pace(0, 0), naps.append) == {}
    assert calls == ["a"] * 3 and naps == [1, 10, 1, 20, 1]
    pace, naps = Pace(2, 60), []
    for _ in range(5):
        pace.wait(naps.append)
    assert naps == [60, 60]
