import random

import numpy as np
import pandas as pd
import pytest

from retort.functions.shapiro import shapiro_p
from retort.operators.dedup import STRATEGY, Dedup, chain


def run(spark, values, kind="double", **settings):
    df = spark.createDataFrame([("C", v, i) for i, v in enumerate(values)], f"s string, t {kind}, i int")
    got = Dedup("s", "t", order_by=("i",), **settings)(df).collect()
    return [(r.t, r.t_new, r[STRATEGY]) for r in got]


@pytest.mark.parametrize("case", [
    ([2.5], {}, [(2.5, 2.5, "no change")]), ([None], {}, []), ([1.0, 3.0], {}, [(1.0, 2.0, "<=3(mean)")]),
    ([1.0, 2.0, 3.0, 4.0, 100.0], {"method": "IQR"}, [(2.0, 2.5, "IQR")]), ([1.0, 2.0, 3.0, 4.0, 100.0], {"method": "3sigma"}, [(4.0, 22.0, "3sigma")]),
    ([1.0, 2.0, 3.0, 4.0, 100.0], {"method": "auto"}, [(2.0, 2.5, "IQR")]), ([1.0, 1.0, 1.0, 1.0], {"method": "auto"}, [(1.0, 1.0, "3sigma")]),
    ([0.01, 0.0, -1.0], {"log_transform": True}, [(2.0, 2.0, "no change")]),
    ([1.0, 2.0, 3.0, 9.0], {"custom": lambda s: (s[s < 5], "mine")}, [(2.0, 2.0, "mine")]), ([1.0, 2.0, 3.0, 9.0], {"custom": lambda s: (8.0, "number")}, [(9.0, 8.0, "number")]),
    ([1.0, 2.0, 3.0, 9.0], {"custom": lambda s: (s[s > 50], "none")}, []), ([1.0, 3.0], {"custom": lambda s: (s, "x")}, [(1.0, 2.0, "<=3(mean)")]),
])
def test_continuous(spark, case):
    values, settings, want = case
    assert run(spark, values, **settings) == want


@pytest.mark.parametrize("case", [
    (["A", "B", "A"], {}, [("A", "A", "vote")]), (["A", "B"], {}, []), (["A", "B"], {"priority": ("B", "A")}, [("B", "B", "priority_B")]),
    (["A", "A", "B"], {"priority": ("Z",)}, [("A", "A", "vote")]), (["A"], {"priority": ("B",)}, [("A", "A", "no change")]), ([None, "A", None], {}, [("A", "A", "no change")]),
])
def test_discrete(spark, case):
    values, settings, want = case
    assert run(spark, values, "string", data_type="discrete", **settings) == want


def test_text_targets_are_cast(spark):
    assert run(spark, ["1", "<5", "3"], "string") == [("1", 2.0, "<=3(mean)")]


def test_first_values(spark):
    df = spark.createDataFrame([("C", None, "x", 1), ("C", 5, None, 2), (None, 1, "y", 3)], "s string, a int, b string, i int")
    got = Dedup("s", data_type="smiles", order_by=("i",))(df)
    assert got.columns == ["s", "a", "b", "i", STRATEGY] and [tuple(r) for r in got.collect()] == [("C", 5, "x", 1, "smiles_only")]


@pytest.mark.parametrize("drop", [False, True])
def test_null_conditions(spark, drop):
    df = spark.createDataFrame([("C", 1.0, None), ("C", 3.0, None), ("C", 5.0, "a")], "s string, t double, c string")
    got = Dedup("s", "t", ("c",), dropna_conditions=drop)(df).collect()
    assert sorted(r.t_new for r in got) == ([5.0] if drop else [2.0, 5.0])


def test_settings():
    for bad in ({"data_type": "other"}, {"custom": 3}, {"method": "vote"}):
        with pytest.raises(ValueError):
            Dedup("s", "t", **bad)
    assert len(chain([{"smiles": "s"}, {"smiles": "s", "target": "t"}])) == 2


def test_missing_column(spark):
    with pytest.raises(KeyError):
        Dedup("s", "t")(spark.createDataFrame([("C",)], "s string"))


def model(rows, method):
    out = []
    for key, g in pd.DataFrame(rows, columns=["s", "t", "i"]).groupby("s"):
        t = g.t
        if len(t) == 1:
            out.append((key, g.i.iloc[0], t.iloc[0], "no change"))
            continue
        kept = t
        if len(t) > 3:
            if method == "IQR":
                a, b = t.quantile(0.25), t.quantile(0.75)
                kept = t[(t >= a - 1.5 * (b - a)) & (t <= b + 1.5 * (b - a))]
            else:
                kept = t[(t >= t.mean() - 3 * t.std()) & (t <= t.mean() + 3 * t.std())]
        mean = kept.mean()
        best = (kept - mean).abs().round(9).idxmin()
        out.append((key, g.i.loc[best], mean, method if len(t) > 3 else "<=3(mean)"))
    return sorted(out)


@pytest.mark.parametrize("method", ["IQR", "3sigma"])
def test_against_pandas(spark, method):
    rng = random.Random(5)
    rows = [(f"m{int(rng.paretovariate(0.7)) % 40}", round(rng.lognormvariate(1, 1), 3), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "s string, t double, i int")
    for parts in (1, 7):
        got = Dedup("s", "t", method=method, order_by=("i",))(df.repartition(parts)).collect()
        found = sorted((r.s, r.i, r.t_new, r[STRATEGY]) for r in got)
        for a, b in zip(found, model(rows, method), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and a[3] == b[3]


def test_one_exchange(spark):
    df = spark.createDataFrame([("C", 1.0, 1)], "s string, t double, i int")
    plan = Dedup("s", "t", method="IQR", order_by=("i",))(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_shapiro():
    assert shapiro_p([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]) == pytest.approx(0.0067038, abs=1e-6)
    rng = np.random.default_rng(0)
    assert shapiro_p(rng.normal(size=200)) > 0.01 > shapiro_p(rng.exponential(size=200))
    assert shapiro_p([1, 1, 1, 1]) == 1.0 and 0 <= shapiro_p([1, 2, 9]) <= 1
    small = [shapiro_p(rng.normal(size=5)) for _ in range(300)]
    assert 0.4 < np.mean(small) < 0.6
