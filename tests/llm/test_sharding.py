import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from retort.llm import sharding


def brute_capacity(sizes, shards):
    def needed(capacity):
        n, room = 0, 0
        for s in sizes:
            if s > capacity:
                return shards + 1
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("case", [(700, 16, 1), (700, 3, 2), (5, 16, 3), (1, 4, 4), (300, 7, 5)])
def test_minimax(spark, case, monkeypatch):
    n, shards, seed = case
    monkeypatch.setattr(sharding, "FIRST", 1)
    monkeypatch.setattr(sharding, "STEP", 1)
    monkeypatch.setattr(sharding, "BUCKETS", 8)
    rng = random.Random(seed)
    texts = ["w" * int(rng.paretovariate(0.8)) + str(rng.randrange(n)) for _ in range(n)]
    texts += ["hot"] * (n // 3) + [None, "", "é"]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, slot int"), shards).collect()
    assert len(got) == len(rows)
    sizes, where, slots, filled = defaultdict(int), defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[hashlib.sha256(raw).hexdigest()] += r.size
        where[raw].add(r.shard)
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(filled) <= set(range(shards))
    assert max(filled.values()) <= brute_capacity([s for _, s in sorted(sizes.items())], shards)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(empty).collect() == []
    same = spark.createDataFrame([(1, "a")] * 5 + [(None, "a")], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard(same, 4).collect()) == list(range(6))
