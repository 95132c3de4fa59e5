import hashlib
import random

import numpy as np

from retort.llm import lines


def brute(rows):
    """Texts after removal, by comparing all pairs of distinct lines."""
    where = {}
    for doc, t in sorted({(d, t) for d, t in rows if t}):
        for pos, x in enumerate(t.split("\n")):
            if (s := lines.normal(x)):
                where.setdefault(s, []).append((doc, pos, t))
    distinct = sorted(where)
    up = {s: s for s in distinct}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    sets = {s: lines.shingles(s) for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    keep = {}
    for s in distinct:
        r = root(s)
        keep[r] = min([*where[s], *([keep[r]] if r in keep else [])])
    out = []
    for doc, t in rows:
        if t is None:
            out.append((doc, None))
            continue
        left = [x for pos, x in enumerate(t.split("\n")) if not (s := lines.normal(x)) or keep[root(s)] == (doc, pos, t)]
        out.append((doc, "\n".join(left)))
    return out


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re", "ñ", "is"], k=rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(60)) for _ in range(12)]
    made = []
    for b in base:
        for _ in range(14):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            made.append(" ".join(w))
    made += [b.upper().replace(" ", "  ") for b in base] + ["short", "short", "Short ", "abcdefg", "abcdefgh", ""] * 3
    rng.shuffle(made)
    rows, i = [], 0
    while made:
        n = rng.randint(1, 5)
        rows.append((i, "\n".join(made[:n])))
        made, i = made[n:], i + 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, "\n\n"), (3, rows[3][1]), (i + 3, "one " * 30_000)]


def test_against_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, line string, n_lines int").repartition(3)
    got = lines.dedup_lines(frame)
    assert got.columns == frame.columns
    want = brute(rows)
    key = lambda r: (r[0], r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want, key=key)
    told = {(r.doc_id, r.kept_sha256) for r in lines.report(frame).collect()}
    assert told == {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in want}


def test_recall_of_bands():
    rng = random.Random(3)
    hits = total = 0
    for _ in range(300):
        a = [str(rng.randrange(10**6)) for _ in range(60)]
        b = list(a)
        for i in rng.sample(range(60), 2):
            b[i] = str(rng.randrange(10**6))
        a, b = " ".join(a), " ".join(b)
        x, y = lines.shingles(a), lines.shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            total += 1
            k = lines.band_keys([a, b])
            hits += bool((k[0] == k[1]).any())
    assert total > 100 and hits / total > 0.98


def test_packed_shingles():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choices("abé漢", (9, 9, 3, rng.choice([0, 0, 1])), k=rng.randint(8, 60))) for _ in "ab")
        assert lines.common(lines.packed(a), lines.packed(b)) == len(lines.shingles(a) & lines.shingles(b))
        assert len(lines.packed(a)) == len(lines.shingles(a))


def test_band_keys_stay_inside_lines():
    one = lines.band_keys(["abcdefghij klm", "second line here", "x" * 8])
    assert (one[1] == lines.band_keys(["second line here"])[0]).all()
    assert (one[0] == lines.band_keys(["abcdefghij klm"])[0]).all() and (one[2] == lines.band_keys(["x" * 8])[0]).all()


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def variants(rng, word, n):
    """Lines made from one line by changes that some share, by cutting ends off and by leaving words out."""
    base = [word() for _ in range(80)]
    shared = [(rng.randrange(80), word()) for _ in range(6)]
    made = {" ".join(base)}
    while len(made) < n:
        w = list(base)
        for at, x in rng.sample(shared, rng.randint(0, 3)):
            w[at] = x
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = word()
        for _ in range(rng.randint(0, 3)):
            del w[rng.randrange(len(w))]
        cut = rng.choice([0, 0, 0, 4, 8])
        made.add(" ".join(rng.choice([w[cut:], w[: len(w) - cut]])))
    return " ".join(base), sorted(made)


def test_groups_are_joined_exactly_as_their_similar_pairs_are(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["th", "er", "on", "漢", "re", "is"], k=rng.randint(1, 4)))
    rows, want = [], {}
    for p in range(3):
        base, made = variants(rng, word, 90)
        made.remove(base)
        sets = [lines.shingles(x) for x in made]
        b = lines.shingles(base)
        alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
        linked = [alike(x, b) for x in sets]
        assert 10 < sum(linked) < 80
        tokens = lines._tokens(lines.packed(base))
        names = [f"{p}-{i}" for i in range(len(made))]
        rows += [(p, names[i], linked[i], len(sets[i]), np.setxor1d(tokens, lines._tokens(lines.packed(x))).tobytes()) for i, x in enumerate(made)]
        pairs = [(names[i], names[j]) for i in range(len(made)) for j in range(i) if alike(sets[i], sets[j])]
        want |= parts(names, pairs + [(n, f"{p}") for n, l in zip(names, linked, strict=True) if l])
    frame = spark.createDataFrame(rows, "p long, id string, linked boolean, size int, differ binary")
    known = [(r[1], f"{r[0]}") for r in rows if r[2]]
    for group, size in ((2048, 1 << 24), (20, 1 << 24), (2048, 30_000)):
        monkeypatch.setattr(lines, "GROUP", group)
        monkeypatch.setattr(lines, "BYTES", size)
        got = [(r.a, r.b) for r in lines.further(frame).collect()]
        assert parts([r[1] for r in rows], got + known) == want
    assert len({v for v in want.values()}) < len(rows) - 60


def parts(names, pairs):
    up = {n: n for n in [*names, *(x for p in pairs for x in p)]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in up}


def test_crowded_buckets_are_dealt_and_lose_no_line(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"the very same beginning of a line number {i % 70:02d}") for i in range(200)] + [(200, "a line alone")], "doc_id long, text string")
    met = lambda hot: {(r.key, r.h0) for r in (monkeypatch.setattr(lines, "HOT", hot), lines.buckets(frame.repartition(3), 5))[1].collect()}
    usual, dealt = met(1000), met(3)
    several = lambda found: {(k, h) for k, h in found if sum(k == x for x, _ in found) > 1}
    assert several(usual) and several(usual) == several(dealt)
