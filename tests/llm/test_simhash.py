import random
import re

import numpy as np
import xxhash

from retort.llm import simhash


def brute_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    of = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            for y in fps:
                if (fps[x] ^ fps[y]).bit_count() <= 2 and of[x] != of[y]:
                    of[x] = of[y] = min(of[x], of[y])
                    changed = True
    return of


def test_against_brute_force(spark):
    random.seed(4)
    vocabulary = ["Ab", "É", "cd e", "x", "the", "Tion", "nd", "er,"]
    texts = ["", None, " \n", "one", "One two", "ONE\ttwo"] + [" ".join(random.choices(vocabulary, k=random.randint(1, 9))) for _ in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "again")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = {i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    want = brute_components(fps)
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


def parts(fps, links):
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in fps}


def test_covering_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = [base]
    for _ in range(3):  # chains of one and two flipped bits
        flips = (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64))
        fps.append(fps[-1] ^ flips)
    fps = np.unique(np.concatenate(fps))
    row, place, home = simhash.anchors(fps)
    assert home.sum() == len(fps)
    entries = np.empty(len(row), simhash._ENTRY)
    entries["anchor"], entries["fp"], entries["home"] = place, fps[row], home
    want = parts(fps.tolist(), [(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 2])
    assert parts(fps.tolist(), simhash.compare(entries)) == want


def test_crowded_anchor(monkeypatch):
    rng = np.random.default_rng(2)
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (4, 400)).astype(np.uint64), axis=0))
    want = parts(fps.tolist(), [(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 2])
    forest = simhash.Forest()
    simhash._crowd(fps, forest, 3)
    assert parts(fps.tolist(), forest.links) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
