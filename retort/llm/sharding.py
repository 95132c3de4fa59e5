"""Sharding by minimax contiguous partition.

Groups of equal texts are atoms, ordered by the SHA-256 of their text. The smallest capacity at which a greedy
left-to-right filling needs no more than the given number of shards is found by binary search; the order is cut there.

The atoms stay on the cluster. The driver holds byte totals of ranges of the order: 4096 ranges at first, of which
only those that a cut may fall into are split, 256-fold, until every such range is one atom. For a capacity, filling
with cuts allowed anywhere in unsplit ranges needs the fewest shards possible, and filling with cuts at range ends only
the most; the true least capacity lies between the least that either finds feasible.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged

FIRST, STEP, WHOLE = 3, 2, 64  #: hexadecimal digits of the first ranges, more for each split, of a whole key
BUCKETS = 4096  #: of doc_id hashes in each shard, for numbering slots in parallel


def _fill(capacity: int, ends: np.ndarray, atomic: np.ndarray, shards: int, anywhere: bool) -> list[int] | None:
    """Ends of the shards in bytes for a greedy filling, or None if there would be too many."""
    cuts, at, total = [], 0, int(ends[-1])
    while at < total:
        if len(cuts) == shards:
            return None
        goal = at + capacity
        if goal >= total:
            nxt = total
        else:
            k = int(np.searchsorted(ends, goal, side="right"))  # the range that holds the goal
            nxt = goal if anywhere and not atomic[k] else (int(ends[k - 1]) if k else 0)
        if nxt <= at:
            return None
        cuts.append(nxt)
        at = nxt
    return cuts


def _least(ends: np.ndarray, atomic: np.ndarray, shards: int, anywhere: bool) -> int:
    low, high = -(-int(ends[-1]) // shards), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if _fill(mid, ends, atomic, shards, anywhere) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _totals(rows: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    found = (
        rows.groupBy(F.substring("g", 1, digits).alias("p"))
        .agg(F.sum("size").alias("s"), (F.min("g") == F.max("g")).alias("one")).collect()
    )  # at most 16 ** FIRST rows, or 256 for each range that is split
    return [(r.p, int(r.s), bool(r.one)) for r in found]


def cut_keys(rows: DataFrame, shards: int) -> tuple[list[str], int]:
    """rows: g (64 hexadecimal digits, equal for rows that belong together), size.

    The key at which each shard but the first begins ("~" if it is empty), and the capacity."""
    ranges, digits = sorted(_totals(rows, FIRST)), FIRST
    if not ranges:
        return ["~"] * (shards - 1), 0
    while True:
        ends = np.cumsum([s for _, s, _ in ranges], dtype=np.int64)
        atomic = np.array([one for _, _, one in ranges])
        low, high = _least(ends, atomic, shards, True), _least(ends, atomic, shards, False)
        first, last = _fill(low, ends, atomic, shards, False), _fill(high, ends, atomic, shards, True)
        if low == high and first == last:
            break
        # Cuts may fall between those of the least capacity with coarse cuts and of the most with free cuts.
        first = first or _coarse(low, ends, shards)
        last = last + [int(ends[-1])] * (len(first) - len(last))
        first = first + [first[-1]] * (len(last) - len(first))
        starts = np.concatenate([[0], ends[:-1]])
        split = np.zeros(len(ranges), bool)
        for f, t in zip(first, last, strict=True):
            split |= (starts <= max(f, t)) & (ends >= min(f, t)) & ~atomic
        if not split.any():
            split = ~atomic
        digits = min(WHOLE, digits + STEP)
        parts = [ranges[i][0] for i in np.flatnonzero(split)]
        finer = []
        for width in sorted({len(p) for p in parts}):
            names = [p for p in parts if len(p) == width]
            finer += _totals(rows.where(F.substring("g", 1, width).isin(names)), digits)
        ranges = sorted([r for r, s in zip(ranges, split, strict=True) if not s] + finer)
    # A shard begins with the range after its predecessor's end.
    names = [p for p, _, _ in ranges] + ["~"]
    begins = [names[int(np.searchsorted(ends, c, side="right"))] for c in first]
    return (begins + ["~"] * shards)[: shards - 1], high


def _coarse(capacity: int, ends: np.ndarray, shards: int) -> list[int]:
    """As _fill() with cuts at range ends only, but past a range that is too large by leaving the cut before it."""
    cuts, at, total = [], 0, int(ends[-1])
    for _ in range(shards):
        k = int(np.searchsorted(ends, min(total, at + capacity), side="right"))
        at = max(at, int(ends[k - 1]) if k else 0)
        cuts.append(at)
    return cuts


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1. Equal texts share a shard; the largest shard is as small as a contiguous
    partition allows (law `bytes`). A null text counts as empty. Slots number a shard's rows from 0 without gaps, in
    the order of a hash of (doc_id, text), then of doc_id; repeated rows get one slot each. With fewer groups than
    shards the last ones stay empty. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("g"),
    ), "sizes")
    keys, _ = cut_keys(rows, shards)
    number: Column = F.lit(0)
    for k in keys:
        number = number + (F.col("g") >= F.lit(k)).cast("int")
    rows = rows.withColumn("shard", number).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g"), F.lit(BUCKETS)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )  # at most shards * BUCKETS rows, so it may be broadcast
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "g")
    return (
        rows.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"))
    )
