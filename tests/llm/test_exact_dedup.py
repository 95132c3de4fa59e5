import hashlib
import random

import pytest
from pyspark.sql import functions as F

from retort.llm import exact_dedup


def corpus():
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["river", "stone", "é", "light"]) for _ in range(12)) + ". "
    texts = [None, "", "", "a", "a", "a\n", " a"] + ["".join(sentence() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += texts[10:20] + [texts[12] + " ", "x" * 50_000, "x" * 50_000, "x" * 49_999, "same text. " * 3000]
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(8, texts[8], 1), (None, "a", 1), (None, "lonely", 1)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(3)).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, _ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r) for r in got], key=order) == sorted(want, key=order)


def test_colliding_identifiers(spark, monkeypatch):
    """Where identifiers collide the digests decide."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.lit(7).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not exact_dedup.verified(exact_dedup.recipes(df))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_chunks(spark):
    texts = [t for t in corpus() if t]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    for r in df.collect():
        cut = [bytes.fromhex(c) for c in r.c]
        assert b"".join(cut) == r.text.encode() and all(len(c) <= exact_dedup.MAX_CHUNK for c in cut)
        assert all(len(c) >= exact_dedup.MIN_CHUNK for c in cut[:-1])


def test_shifted_text_shares_chunks(spark):
    rng = random.Random(1)
    text = "".join(" ".join(str(rng.randrange(9**9)) for _ in range(12)) + ". " for _ in range(400))
    df = spark.createDataFrame([(text,), ("Something else stands before. " + text,)], "text string")
    a, b = (set(r.c) for r in df.select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert len(a & b) > 0.8 * len(a)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "0123456789", "漢字仮名交文章例句"])
def test_shifted_text_without_punctuation_shares_chunks(spark, letters):
    text = "".join(random.Random(5).choices(letters, k=60_000))
    df = spark.createDataFrame([(text,), ("2 " + text,)], "text string")
    a, b = (set(r.c) for r in df.select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert len(a) > 15 and len(a & b) > 0.8 * len(a)


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
