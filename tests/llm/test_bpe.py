import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retort.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    syllables = ["th", "er", "tion", "É", "ß", "on", "ing", "ñ", "!!", " | ", "'s", "'ll", "’", "3", "12", "\n", "  ", "\t", "漢字", "🙂", "\u0085", "\x1c", " ", "<|endoftext|>", "%%%", "ſ", "Ⅷ", "½", "​", "é"]
    texts = ["".join(rng.choices(syllables, k=rng.randint(0, 60))) for _ in range(600)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 14))) for _ in range(3000)]
    return [*texts, "", " ", "<|endoftext|>", "a <|endoftext|> b", "x" * 5000, "ab " * 2000 + " " * 300]


def test_as_tokenizers(samples):
    reference, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    for text, packed in zip(samples, codec.encode(samples), strict=True):
        want = reference.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)] == want, text
        assert codec.decode(packed) == reference.decode(want, skip_special_tokens=False)
    assert 0 < codec.merged_words < codec.new_words


def test_long_words():
    """Words of any length take little more than their length."""
    rng = random.Random(8)
    reference, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "ab" * 50_000, "z" * 100_000):
        began = time.perf_counter()
        packed, = codec.encode([text])
        assert time.perf_counter() - began < 15
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_broken_utf8_decodes_alike():
    reference, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(12)]
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert codec.decode(packed) == reference.decode(ids, skip_special_tokens=False)


def test_small_memory(samples, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "SLICE", 200)
    assert list(bpe.Codec(PATH).encode(samples[:700])) == list(bpe.Codec(PATH).encode(samples)) [:700]


def test_frame(spark):
    rows = [(1, "The the", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode(docs, PATH, with_ids=True)
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256 == empty) for r in got.collect()) == [(0, 1, False), (1, 2, False), (2, 0, True), (3, 0, True), (3, 0, True)]
    assert {(r.doc_id, r.text) for r in bpe.decode(got, PATH).collect()} == {(1, "The the"), (2, ""), (3, ""), (None, "x")}
    assert bpe.encode(docs.where("false"), PATH).collect() == []
