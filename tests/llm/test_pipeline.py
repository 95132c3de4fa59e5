import hashlib

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retort.llm import quality, simhash
from retort.llm.shared import staged, table

from .test_lines import brute
from .test_simhash import brute_components, brute_fingerprint

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, DIR, "documents")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], DIR), name.replace(" ", "-")))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert all(df.count() for df in steps)


def test_quality(spark, steps):
    model = quality.fit(steps[0], table(spark, DIR, "labels"))
    want = sorted(d for (d, t) in texts(steps[0]) if quality.scores([t.encode()], model)[0] >= quality.KEEP)
    assert sorted(d for d, _ in texts(steps[1])) == want


def test_lines(steps):
    assert sorted(texts(steps[2])) == sorted(brute(texts(steps[1])))


def test_near(steps):
    before = dict(texts(steps[2]))
    groups = brute_components({d: brute_fingerprint(t) for d, t in before.items()})
    assert sorted(texts(steps[3])) == sorted((d, before[d]) for d in set(groups.values()))


def test_mixing(steps):
    before, after = dict(texts(steps[3])), texts(steps[4])
    assert {d for d, _ in after} == set(before) and all(before[d] == t for d, t in after)
    assert len(after) >= len(before)


def test_tokens(steps):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in texts(steps[4]):
        ids = reference.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in steps[5].collect()) == sorted(want)


def test_run(spark, steps):
    assert sorted(pipeline.run(spark, DIR).collect()) == sorted(steps[5].collect())


def test_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b c", 7), (1, "a b c", 8), (2, "x y z", 7), (None, "q r s", 7), (1, "other text here", 7), (3, None, 7), (4, "", 7)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k int"))
    assert got.columns == ["doc_id", "text", "k"]
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "q r s"), (1, "a b c"), (1, "other text here"), (2, "x y z"), (3, "")]


def odd(spark):
    """Documents and labels with nulls, repeats, empty and very long texts, and columns that clash with hidden names."""
    texts = ["a river runs\nover old stones", "", None, " \n ", "BUY!! NOW!!\nBUY!! NOW!!", "word " * 40_000, "x" * 100_000, "the same line of text here", "the same line of text hear"]
    rows = [(i if i % 7 else None, t, 1, "p", 0.5, "en", i) for i, t in enumerate(texts * 2)]
    rows += rows[3:5]
    names = "doc_id long, text string, n int, p string, rate double, lang string, component int"
    labels = [(i, i % 2) for i in range(40)] + [(1, 0), (1, None), (None, 1)]
    return spark.createDataFrame(rows, names), spark.createDataFrame(labels, "doc_id long, quality int")


@pytest.mark.parametrize("some", [True, False])
def test_stages_stand_odd_rows_and_empty_tables(spark, tmp_path, some):
    docs, labels = odd(spark)
    docs, labels = (docs, labels) if some else (docs.where("false"), labels.where("false"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        after = staged(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        if name != "bpe":
            assert after.columns == docs.columns
            if name in ("line dedup", "mixing"):
                assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()}
        assert bool(after.count()) == some
        docs = after


def test_hidden_names_are_refused(spark):
    docs, labels = odd(spark)
    for name, stage in pipeline.STAGES[1:4]:
        with pytest.raises(ValueError, match="__p"):
            stage(spark, docs.withColumn("__p", docs.p), DIR)
