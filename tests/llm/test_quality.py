import math
import random
import zlib

import zstandard

from retort.llm import quality


def fixture(spark, n=900):
    rng = random.Random(1)
    good = ["the river runs", "over old stones", "and she said", "that morning", "light came in", "slowly"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(["BUY!!", "NOW!!", "$$$", "WIN!!"]) for _ in range(40)] if bad else [rng.choice(good) for _ in range(40)]
        rows.append((i, " ".join(words), 5))
        labels.append((i, 0 if bad else 1))
    rows += [(n, None, 5), (n + 1, "", 5), (3, rows[3][1], 5), (n + 2, "word " * 50_000, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame([*labels, (n + 9, None)], "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = fixture(spark)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 904
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(judged) > 100 and sum(judged) / len(judged) > 0.98


def test_held_out_rows_are_not_used(spark):
    docs, labels = fixture(spark, 400)
    held = quality.held_out(labels.doc_id)
    assert quality.fit(docs, labels) == quality.fit(docs, labels.where(~held))


def test_nothing_to_learn_from(spark):
    docs, labels = fixture(spark, 40)
    model = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).collect() == []


def test_keep_good_keeps_columns(spark):
    docs, labels = fixture(spark)
    kept = quality.keep_good(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert not bad & {r.doc_id for r in kept.collect()}
    assert kept.count() > 600


def test_repeated_documents_count_once(spark):
    docs, labels = fixture(spark, 400)
    assert quality.fit(docs, labels) == quality.fit(docs.unionByName(docs), labels.unionByName(labels))


def test_pieces_of_all_rows_have_even_chances(spark):
    """What a dictionary is built from is an even share of all rows' pieces, not the first ones."""
    rows = spark.createDataFrame([(i * 10**15, bytes([i]) * 10_000) for i in range(100)], "h long, t binary")
    assert len(quality._sample(rows, 1.0)) == 1000
    some = quality._sample(rows, 0.3)
    assert 200 < len(some) < 400 and len({p[0] for p in some}) > 90


def test_scores_against_brute_force(spark):
    """Scores by compressing every piece anew, without the shared compressors, and by the formula."""
    docs, labels = fixture(spark, 300)
    model = quality.fit(docs, labels)
    for r in quality.score(docs, model).collect()[::20]:
        text = (next(d.text for d in docs.collect() if d.doc_id == r.doc_id) or "").encode()
        sizes = []
        for raw in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(text[i : i + quality.PIECE])) for i in range(0, max(1, len(text)), quality.PIECE)))
        d, q, n = (sizes[1] - sizes[0]) / max(sizes), min(1.2, min(sizes) / max(1, len(text))), math.log1p(len(text))
        x = [d, q, n, d * d, q * q, n * n, d * q, d * n, q * n]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.spread, strict=True))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
