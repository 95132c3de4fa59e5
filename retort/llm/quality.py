"""Quality classifier by compression.

Two zstandard dictionaries are built from text labelled good and bad. A text is cut into pieces of equal length, and
each piece is compressed with either dictionary: the label whose dictionary compresses it better is likelier. The
difference of the compressed sizes, normalised by their larger one, becomes a probability by logistic calibration on
labelled rows that no dictionary has seen; the calibration also takes how far and how long the text compresses at all,
since text that merely repeats itself compresses well with any dictionary.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import labelled

PIECE, LEVEL, DICTIONARY = 1024, 3, 112_640  #: bytes of a piece; zstandard level; bytes of a dictionary
LABELLED = 12_000  #: labelled rows that the classifier is fitted on at most: those of least doc_id hash
DICTIONARY_TEXT = 4_000_000  #: bytes of pieces that a dictionary is built from, about: an even share of all rows' pieces
KEEP = 0.3  #: least score of text that counts as good


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float | None = None  #: the score of every text, where there was nothing to learn from


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself serves
        return b"".join(pieces)[-DICTIONARY:]


@cache
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, max(1, len(text)), PIECE)]


def _sizes(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: normalised difference, compressed size by length, logarithm of the length, and their products."""
    g, b = _compressor(good).compress, _compressor(bad).compress
    found = np.empty((len(texts), 3))
    for i, t in enumerate(texts):
        with_good = with_bad = 0
        for p in _pieces(t):
            with_good += len(g(p))
            with_bad += len(b(p))
        found[i] = (with_bad - with_good) / max(with_good, with_bad), min(with_good, with_bad) / max(1, len(t)), np.log1p(len(t))
    d, r, n = found.T
    r = np.minimum(r, 1.2)
    return np.stack([d, r, n, d * d, r * r, n * n, d * r, d * n, r * n], axis=1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w)), a.T @ (p - y) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(rows: DataFrame, share: float) -> list[bytes]:
    """That share of the pieces of all rows' texts, chosen by a hash of their row and place, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, p in enumerate(_pieces(t)):
                    luck = xxhash.xxh64_intdigest(struct.pack("<qq", h, i))
                    if p and luck < share * 2**64:
                        out.append((h, i, p))
            columns = zip(*out, strict=True) if out else [[]] * 3
            kinds = pa.int64(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["h", "i", "piece"])

    got = rows.select("h", "t").mapInArrow(run, "h long, i int, piece binary").toArrow()
    return [p for _, _, p in sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on at most LABELLED labelled documents that aren't held out, each once, whatever repeats.

    Half of them give the dictionaries' pieces: all, or where those of a label have more than DICTIONARY_TEXT bytes, an
    even share of them. The other half's whole texts are compressed on the cluster, for calibration. So what comes to the
    driver is bounded, however long the texts are."""
    rows = labelled(docs, labels.where(~held_out(F.col("doc_id"))), label, LABELLED)
    all_ = sorted((r.h, int(r.y)) for r in rows.select("h", "y").collect())
    if not all_:
        return Model(b"", b"", (), (), (), 0.5)
    middle = all_[len(all_) // 2][0]
    first, second = rows.where(F.col("h") < middle), rows.where(F.col("h") >= middle)
    size = {int(r.y): r.n for r in first.groupBy("y").agg(F.sum(F.length("t")).alias("n")).collect()}
    if not (size.get(0) and size.get(1)) or len({y for h, y in all_ if h >= middle}) < 2:
        return Model(b"", b"", (), (), (), float(np.mean([y for _, y in all_])))
    good, bad = (_dictionary(_sample(first.where(F.col("y") == side), DICTIONARY_TEXT / size[side])) for side in (1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _sizes(b.column(2).to_pylist(), good, bad)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), flat], names=["h", "y", "x"])

    got = sorted((r.h, r.y, r.x) for r in second.select("h", "y", "t").mapInArrow(run, "h long, y int, x array<double>").collect())
    x, y = np.array([r[2] for r in got]), np.array([r[1] for r in got])
    return Model(good, bad, *(tuple(v.tolist()) for v in _calibrate(x, y)))


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    w = np.array(model.weights)
    x = (_sizes(texts, model.good, model.bad) - np.array(model.mean)) / np.array(model.spread) if texts else np.empty((0, 9))
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. A null text counts as empty and gets the score of an
    empty text; repeated rows are scored each; other columns are ignored; without labelled rows of both kinds every
    score is the mean label, or 0.5."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scores([x or b"" for x in b.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found), pa.array((found >= KEEP).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text scores KEEP or more.

    A null text counts as empty and stays or goes as an empty one does; repeated rows stay or go together; very long texts
    are scored whole. An empty table gives an empty result. Without labelled rows of both kinds every text has the mean
    label (0.5 without any) as its score."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scores([(x or "").encode() for x in b.column(at).to_pylist()], model)
            yield b.filter(pa.array(found >= KEEP))

    return docs.mapInArrow(run, docs.schema)
