"""SimHash near-deduplication by anchor-point covering.

The anchors are the words of a product of two perfect binary Golay codes (23 bits each, covering radius 3) over 46 of
a fingerprint's 64 bits. Each fingerprint has one home anchor, within the radius of each block; it is replicated to
every anchor within covering radius plus threshold, counted over both blocks, about 61 of 2**24. Of two fingerprints
within the threshold, each thus meets the other at its home. Per anchor, home fingerprints are compared with all that
are there. Only distinct fingerprints take part, packed into arrays, so copies cost nothing, and a crowded anchor is
compared through shared neighbours (each fingerprint with its 64 one-bit variants), in linear work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected, hidden, n_tasks, staged

SHINGLE, THRESHOLD, SEED = 3, 2, 42
BLOCK_BITS, RADIUS, GENERATOR = 23, 3, 0b101011100011  #: of the Golay code; its generator polynomial
CROWDED = 1024  #: fingerprints at one anchor from which shared neighbours are used
PAIRS = 1 << 21  #: compared at once
REPLICAS, TASK = 64, 1 << 25  #: of a fingerprint, about; bytes of entries in a bucket, about

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_digest
    found = b"".join([digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))])
    n = len(found) // 8
    at = (np.frombuffer(found, np.uint8).reshape(n, 8) + _COLUMN).ravel()
    ones = np.bincount(at, minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(ones.ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a long."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


@cache
def _patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words' high and low parts, and error patterns up to radius + threshold by syndrome.

    Returns (syndrome table by 23-bit word, start of each (syndrome, excess) in patterns, patterns)."""
    words = np.arange(1 << BLOCK_BITS, dtype=np.uint32)
    syndrome = words.copy()
    for bit in range(BLOCK_BITS - 1, 10, -1):  # remainder of the polynomial division
        syndrome ^= np.where(syndrome >> bit & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    weight = np.bitwise_count(words)
    near = np.flatnonzero(weight <= RADIUS + THRESHOLD).astype(np.uint32)
    excess = np.maximum(weight[near].astype(int) - RADIUS, 0)
    group = syndrome[near].astype(np.int64) * (THRESHOLD + 1) + excess
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(2048 * (THRESHOLD + 1) + 1))
    return syndrome.astype(np.uint16), starts, near[order]


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(counts) items: the row that it belongs to, and its number there."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (row of fps, anchor, whether it is the row's home) within covering radius plus threshold."""
    syndrome, starts, patterns = _patterns()
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    blocks = [(fps & mask).astype(np.uint32), (fps >> np.uint64(BLOCK_BITS) & mask).astype(np.uint32)]
    rows, places, homes = [], [], []
    for first in range(THRESHOLD + 1):
        for second in range(THRESHOLD + 1 - first):
            a = syndrome[blocks[0]].astype(np.int64) * (THRESHOLD + 1) + first
            b = syndrome[blocks[1]].astype(np.int64) * (THRESHOLD + 1) + second
            na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
            row, k = _expand(na * nb)
            pa_, pb = patterns[starts[a[row]] + k // np.maximum(nb[row], 1)], patterns[starts[b[row]] + k % np.maximum(nb[row], 1)]
            place = (blocks[0][row] ^ pa_).astype(np.uint64) | (blocks[1][row] ^ pb).astype(np.uint64) << np.uint64(BLOCK_BITS)
            rows.append(row)
            places.append(place)
            homes.append(np.full(len(row), first == second == 0))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(homes)


_ENTRY = np.dtype([("anchor", "<u8"), ("fp", "<u8"), ("home", "u1")])


def _replicate(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 20_000):
                fps = every[at : at + 20_000]
                row, place, home = anchors(fps)
                entries = np.empty(len(row), _ENTRY)
                entries["anchor"], entries["fp"], entries["home"] = place, fps[row], home
                bucket = (place * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                entries, bucket = entries[order], bucket[order]
                keys, begin = np.unique(bucket, return_index=True)
                parts = np.split(entries, begin[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["bucket", "entries"],
                )

    return run


class Forest:
    """Union-find that keeps the links which join two parts."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _crowd(fps: np.ndarray, forest: Forest, slices: int) -> None:
    """Join all of fps within two bits: such a pair has a word within one bit of both."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for s in range(slices):
        words, owners = [], []
        for f in flips:
            w = fps ^ f
            keep = w * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
            keep = keep % np.uint64(slices) == s
            words.append(w[keep])
            owners.append(fps[keep])
        words, owners = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(words, kind="stable")
        words, owners = words[order], owners[order]
        same = np.flatnonzero(words[1:] == words[:-1])
        for x, y in zip(owners[same].tolist(), owners[same + 1].tolist(), strict=True):
            forest.join(x, y)


def compare(entries: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect, as far as the anchors in entries show, all fingerprints within the threshold."""
    entries = entries[np.argsort(entries["anchor"], kind="stable")]
    first = np.flatnonzero(np.diff(entries["anchor"], prepend=entries["anchor"][:1] + np.uint64(1)))
    sizes = np.diff(first, append=len(entries))
    n_home = np.add.reduceat(entries["home"], first, dtype=np.int64)
    forest = Forest()
    for k in np.flatnonzero((n_home > 0) & (sizes > CROWDED)):
        fps = np.unique(entries["fp"][first[k] : first[k] + sizes[k]])
        _crowd(fps, forest, 1 + len(fps) // 50_000)
    few = (n_home > 0) & (sizes > 1) & (sizes <= CROWDED)
    at = np.flatnonzero(entries["home"].astype(bool) & np.repeat(few, sizes))  # every home entry is compared with its group
    group = np.repeat(np.arange(len(first)), sizes)[at]
    counts = sizes[group]
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
        row, k = _expand(counts[begin:stop])
        x = entries["fp"][at[begin:stop]][row]
        y = entries["fp"][first[group[begin:stop]][row] + k]
        hit = (np.bitwise_count(x ^ y) <= THRESHOLD) & (x != y)
        for p, q in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
            forest.join(p, q)
        begin = stop
    return forest.links


def links(fps: DataFrame, buckets: int) -> DataFrame:
    """fps: distinct fp. (a, b): links that connect exactly what is within the threshold."""

    def run(t: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(t.column("entries").to_pylist()), _ENTRY)
        found = np.array(compare(entries), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    packed = fps.select("fp").mapInArrow(_replicate(buckets), "bucket long, entries binary")
    return packed.groupBy("bucket").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable).

    Words are maximal runs without ASCII white space, A-Z in lower case; documents link if the fingerprints of their
    3-word shingles differ in 2 bits or fewer. A null or wordless text has fingerprint zero and links like any other.
    Repeated rows give repeated rows; a null doc_id is never a component's least unless it has no other. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    buckets = max(2 * n_tasks(docs.sparkSession), distinct.count() * REPLICAS * _ENTRY.itemsize // TASK)
    members = connected(links(distinct, buckets), "simhash")
    least = distinct.join(members, distinct.fp == members.node).groupBy("component").agg(F.min("least").alias("c"))
    linked = members.join(least, "component").select(F.col("node").alias("f"), "c")
    copies = distinct.where("n > 1").join(linked, F.col("fp") == F.col("f"), "left_anti").select(F.col("fp").alias("f"), F.col("least").alias("c"))
    # Only fingerprints of several documents, or linked ones, are joined back; as a table, so that the join may split.
    of = staged(linked.unionByName(copies), "members")
    return rows.join(of, rows.fp == of.f, "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("c", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component of near duplicates: that of least (doc_id, hash of the text).

    Of repeated rows one stays. Rows with a null doc_id are ordered before all others. Null, empty and wordless texts have
    fingerprint zero: one of all of them stays. Very long texts are read whole. An empty table gives an empty result.
    Columns may have any names but those that begin with two underscores."""
    hidden(docs)
    mark = F.xxhash64(F.col(text_col)).alias("__th")
    key = docs.select(F.struct(F.col(id_col).alias("__k"), mark).alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(near_duplicates(key.select("doc_id", "text")), "near")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = rows.where(first).groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).select("doc_id.__k", "doc_id.__th", "__n")
    kept = staged(kept, "kept")
    here = F.col(id_col).eqNullSafe(F.col("__k")) & (F.xxhash64(F.col(text_col)) == F.col("__th"))
    out = docs.join(kept.where("__n = 1"), here, "left_semi")
    more = kept.where("__n > 1")
    if more.isEmpty():
        return out
    again = staged(docs.join(more, here).withColumn("__row", F.monotonically_increasing_id()), "again")
    one = again.groupBy("__k", "__th").agg(F.min("__row").alias("__first"))
    again = again.join(staged(one, "one").select("__first"), F.col("__row") == F.col("__first"), "left_semi")
    return out.unionByName(again.drop("__k", "__th", "__n", "__row"))
