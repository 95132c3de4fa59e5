import hashlib
import random
from collections import Counter

import numpy as np

from retort.llm import substrings


def brute(texts):
    docs = [(t or "").encode().split() for t in texts]
    n = substrings.WINDOW
    count = Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus():
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [word(n) for n in (34, 35, 36, 60, 120)]
    texts = ["", None, " \n\t", "a b", " ".join(word(34)), "same " * 34, "same " * 35, "same " * 36, "x y z " * 40]
    for i in range(60):
        parts = [word(rng.randint(0, 80)) for _ in range(3)]
        for p in parts:
            if rng.random() < 0.5:
                p += rng.choice(passages)
        texts.append(rng.choice([" ", "\n"]).join(w for p in parts for w in p))
    whole = " ".join(word(200))
    near = whole.split()
    near[100] = "changed"
    texts += [whole, whole, whole.replace(" ", "\x0b"), " ".join(near), " ".join(word(30))] + [" ".join(passages[3])] * 2
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "row") for i, t in enumerate(texts)] + [(70, texts[70], "row"), (20, texts[21], "row")]
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, whole string").repartition(3))
    want = brute([r[1] for r in rows])
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted((r[0], *w) for r, w in zip(rows, want, strict=True))


def test_empty_table(spark):
    assert substrings.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_windows_share_a_pick():
    rng = random.Random(1)
    words = [b"%d" % rng.randrange(9) for _ in range(400)]
    of = lambda w: substrings.picks(substrings.Words(w), np.array([len(w)]))[0]
    whole, part = of(words), of(words[100:135])
    assert set(part["fp"].tolist()) <= set(whole["fp"].tolist()) and len(part) == 1
    assert len(whole) < 400 / 7
    # Every window has exactly one pick.
    assert sorted(s + i for s, n in zip(whole["start"].tolist(), whole["n"].tolist(), strict=True) for i in range(n)) == list(range(366))
    # Texts that are hashed together have the picks they have alone.
    other = [b"%d" % rng.randrange(9) for _ in range(50)]
    both, text = substrings.picks(substrings.Words(other + words[:20] + words), np.array([50, 70, 470]))
    assert both[text == 2].tolist() == whole.tolist() and both[text == 0].tolist() == of(other).tolist() and not (text == 1).any()


def test_batches_are_held_against_history(spark, tmp_path):
    texts = corpus()
    rows = list(enumerate(texts))
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    parts = [rows[:25], rows[25:50], rows[50:]]
    frames = [frame(p) for p in parts]
    told = lambda df: sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())
    index = substrings.Index(spark, folder=f"{tmp_path}/index")
    assert told(substrings.substring_dedup(frames[0], index)) == [(d, *w) for (d, _), w in zip(rows[:25], brute([t for _, t in rows[:25]]), strict=True)]
    assert told(substrings.substring_dedup(frames[1], index)) == [(d, *w) for (d, _), w in zip(rows[25:50], brute([t for _, t in rows[:50]])[25:], strict=True)]
    assert index.runs == [(0, 1)]  # compacted
    # Opened again from its folder.
    index = substrings.Index(spark, folder=f"{tmp_path}/index", batches=frames[:2])
    assert told(substrings.substring_dedup(frames[2], index)) == [(d, *w) for (d, _), w in zip(rows[50:], brute(texts)[50:], strict=True)]
    assert index.runs == [(0, 2)]
    # And everything at once.
    assert told(index.report()) == [(d, *w) for (d, _), w in zip(rows, brute(texts), strict=True)]
    index.drop()


def test_history_is_not_shuffled(spark):
    index = substrings.Index(spark)
    text = " ".join(str(i) for i in range(100))
    for i in range(2):
        index.add(spark.createDataFrame([(i, text)], "doc_id long, text string"))
    one, = index.runs
    plan = index._table(one).join(index._table(one).select("fp").hint("merge"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


def test_rows_without_doc_id(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 90))) for _ in range(4000)]
    got = substrings.substring_dedup(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"))
    assert Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == Counter(brute(texts))


def test_covered():
    assert np.flatnonzero(~substrings.covered(np.array([2, 40]), np.array([1, 2]), 80)).tolist() == [0, 1, 37, 38, 39, 76, 77, 78, 79]
