import random

import numpy as np
import pytest

from retort.llm import mixing

WORDS = {"a": ["lorem", "ipsum", "dolor"], "b": ["kette", "über", "schön"], "c": ["zzz", "qqq", "xyx"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        d = "abc"[min(2, i % 5)] if i % 7 else "a"
        rows.append((i, " ".join(rng.choices(WORDS[d], k=rng.randint(3, 60))), d, 0.5))
    rows += [(300, None, "a", 1.0), (301, "", "b", 1.0), (5, rows[5][1], rows[5][2], 1.0), (302, "lorem kette " * 30, None, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, rate double").cache()


def test_meets_targets(docs):
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    got = mixing.mix(docs, docs, targets).toPandas()
    assert len(got) == 304 and (got.rate >= 0).all()
    p = got[["p_a", "p_b", "p_c"]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    reached = (p * (got.rate * got.n_tokens).to_numpy()[:, None]).sum(0)
    assert np.allclose(reached / reached.sum(), [0.2, 0.3, 0.5], atol=1e-6)
    assert (np.abs(got.copies - got.rate) < 1).all()
    truth = dict(docs.where("domain is not null").select("doc_id", "domain").collect())
    likely = [("abc"[int(np.argmax(q))]) == truth[d] for d, q, n in zip(got.doc_id, p, got.n_tokens, strict=True) if n and d in truth]
    assert np.mean(likely) > 0.97


def test_against_dense_projected_gradient(docs):
    targets = {"a": 0.05, "b": 0.05, "c": 0.9}
    base, model = mixing.prepared(docs, docs, targets)
    got = base.withColumn("r", mixing.rates(base, targets, model.domains, total=4000.0)).toPandas()
    p, t = np.array(got["__p"].tolist()), got.n_tokens.to_numpy(float)
    goal, white = 4000 * np.array([0.05, 0.05, 0.9]), np.linalg.pinv((p * t[:, None]).T @ p)
    r = np.full(len(t), 4000 / t.sum())
    for _ in range(mixing.STEPS):
        r = np.maximum(0, r - p @ (white @ ((r * t) @ p - goal)))
    assert np.allclose((got.r.to_numpy() * t) @ p, (r * t) @ p, rtol=1e-6)
    assert np.allclose(got.r, r, atol=1e-5)


def test_out_of_reach_target(docs):
    """A weight of zero drives rates to zero, never below."""
    got = mixing.mix(docs, docs, {"a": 1.0, "b": 0.0, "c": 1.0}).toPandas()
    assert (got.rate >= 0).all() and got[got.p_b > 0.99].rate.max() < 0.05


def test_resample_keeps_every_document(docs):
    got = mixing.resample(docs, docs, {"a": 0.3, "b": 0.3, "c": 0.4})
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
    assert got.count() > docs.count()


@pytest.mark.filterwarnings("ignore:mixing")
@pytest.mark.parametrize("gone", ["c", "b"])
def test_resample_without_a_target_language(spark, docs, gone):
    """Also texts between two languages, short ones and junk stay; the languages that are there have their ratio."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.domain) for r in docs.where(f"domain is null or domain <> '{gone}'").collect()]
    rows += [(1000 + i, " ".join(rng.choices(WORDS["a"] + WORDS["b"] + WORDS["c"], k=rng.randint(1, 40))), None) for i in range(200)]
    rows += [(2000 + i, "".join(rng.choices("0123456789#%&", k=50)), None) for i in range(20)]
    some = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    targets = {"a": 0.05, "b": 0.8, "c": 0.15}
    out = mixing.resample(some, some, targets)
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
    base, model = mixing.prepared(some, some, targets)
    got = base.withColumn("r", mixing.whole_rates(base, targets, model)).toPandas()
    assert got.r.min() >= 1
    reached = (np.array(got["__p"].tolist()) * (got.r * got.n_tokens).to_numpy()[:, None]).sum(0)
    there = [i for i, d in enumerate("abc") if d != gone]
    want = np.array([targets["abc"[i]] for i in there])
    assert np.allclose(reached[there] / reached[there].sum(), want / want.sum(), atol=1e-6)


def test_empty(docs):
    none = docs.where("false")
    assert mixing.mix(none, docs, {"a": 1.0, "b": 1.0}).collect() == []
    got = mixing.mix(docs, none, {"a": 1.0, "b": 1.0}).toPandas()
    assert np.allclose(got.p_a, 0.5)


def test_words():
    for text in (b"", b" ", b"a", b" a b\tc\n", b"a\x0bb\x1cc"):
        assert mixing.n_tokens(text) == len([w for w in text.replace(b"\x1c", b"x").split()])


def test_repeated_documents_count_once(docs, monkeypatch):
    monkeypatch.setattr(mixing, "LABELLED", 100)
    one = mixing.fit(docs, docs, ["a", "b", "c"])
    many = mixing.fit(docs.unionByName(docs), docs.unionByName(docs), ["a", "b", "c"])
    assert (one.table == many.table).all() and one.learnt == many.learnt and sum(one.learnt) == 50
