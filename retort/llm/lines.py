"""Line deduplication: near-equal lines by MinHash, verified, one line kept of each component.

A line is compared in lower case with single blanks. Equal lines have equal 128-bit hashes and count as one from then
on. Lines of SHINGLE characters or more get a signature of BANDS x ROWS minima over hashed character shingles; lines
that agree in a band meet in a bucket (a shorter line is its own only shingle, so it is similar to equal lines alone).
A pair links if the exact Jaccard similarity of its shingle sets is SIMILARITY or more.

Each bucket has a leader, its most frequent line, and every line of the bucket is compared with it: linear work. Lines
that are similar to the leader are in one component already, so only pairs with a line that isn't are left. They are
found from what each line differs in from the leader, which is little: two lines are similar if and only if their
differences differ little enough, so a line meets others through the shingles that set them off, counted exactly. No
pairs are made as rows, no link is lost, and a large group is split in parts, every two of which are one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected, hidden, n_tasks, remove_staged, sieve, staged

SHINGLE, SIMILARITY = 8, 0.8
BANDS, ROWS = 10, 4  #: a pair at the threshold meets with probability 1 - (1 - 0.8 ** 4) ** 10 = 0.995
SLICE = 1 << 16  #: characters of lines whose signatures are computed together, while they are in the cache
HOT = 256  #: lines of one batch in one bucket from which its entries are dealt over all tasks
TASK = 1 << 25  #: bytes of bucket entries in one task
GROUP, BYTES = 2048, 1 << 24  #: lines, and bytes of what they differ in, in a part of a group
_ALL = (1 << 64) - 1


def normal(line: str) -> str:
    """In lower case, with single blanks between words and none around."""
    return " ".join(line.lower().split())


def normals(text: str) -> list[str]:
    """The lines of a text, normal."""
    found = text.lower().split("\n")
    if "  " not in text and all(map(str.isprintable, found)):  # no white space but single blanks
        return list(map(str.strip, found))
    return [" ".join(x.split()) for x in found]


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def packed(line: str) -> np.ndarray | set[str]:
    """The shingles as sorted 64-bit numbers, each the bytes of its characters; as text if one needs more than a byte."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return shingles(line)
    return np.unique(np.ndarray((len(raw) - SHINGLE + 1,), "<u8", raw, strides=(1,)))


def common(a: np.ndarray | set[str], b: np.ndarray | set[str]) -> int:
    """How many shingles two lines share."""
    if isinstance(a, set) and isinstance(b, set):
        return len(a & b)
    if isinstance(a, set) or isinstance(b, set):  # only what both can write in a byte may be shared
        text, numbers = (a, b) if isinstance(a, set) else (b, a)
        return len({x for x in text if x.isascii() or max(x) < "\u0100"} & {n.tobytes().decode("latin-1") for n in numbers})
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _ids(lines: list[str]) -> np.ndarray:
    """128-bit hashes as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)


@cache
def _permutations() -> tuple[list[np.uint32], list[np.uint32]]:
    rng = np.random.default_rng(20)
    a, b = rng.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
    return list(a | np.uint32(1)), list(b)


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys; every line must have SHINGLE characters or more."""
    out = np.empty((len(lines), BANDS), np.uint64)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= SLICE):
            size += len(lines[end])
            end += 1
        x = np.frombuffer("".join(lines[at:end]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        step = 1
        while step < SHINGLE:  # hashes of 2, 4, then 8 characters
            x = (x[:-step] * np.uint64(0x9E3779B97F4A7C15) ^ x[:-step] >> np.uint64(29)) + x[step:] * np.uint64(0xC2B2AE3D27D4EB4F)
            step *= 2
        x ^= x >> np.uint64(31)
        h = (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)
        sizes = np.array([len(s) for s in lines[at:end]])
        starts = np.cumsum(sizes) - sizes
        inside = np.ones(len(h), bool)  # without shingles that reach into the next line
        for back in range(1, SHINGLE):
            cut = starts[1:] - back
            inside[cut[cut >= 0]] = False
        h = h[inside]
        counts = sizes - SHINGLE + 1
        begin = np.cumsum(counts) - counts
        minima, y = np.empty((BANDS * ROWS, len(sizes)), np.uint32), np.empty_like(h)
        for k, (a, b) in enumerate(zip(*_permutations(), strict=True)):
            np.multiply(np.bitwise_xor(h, b, out=y), a, out=y)
            minima[k] = np.minimum.reduceat(y, begin)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(sizes), 1)
        for row in range(ROWS):
            key = (key ^ minima[row::ROWS]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
        out[at:end] = key.T
        at = end
    return out


_ENTRY = np.dtype([("key", "<u8"), ("h0", "<i8"), ("n", "<u4")])


def _fresh(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct normal lines that are long enough for shingles, their hashes, and how often they occur."""
    found = Counter([x for t in texts if t for x in normals(t) if len(x) >= SHINGLE])
    lines = list(found)
    return lines, _ids(lines), np.fromiter(found.values(), np.uint32, len(lines))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lines): hash of the text, and the hashes of its lines, null for blank ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, ends = [], [0]
            for t in b.column(2).to_pylist():
                lines += normals(t) if t else []
                ends.append(len(lines))
            ids = _ids(lines)
            blank = pa.array(np.array([not x for x in lines], bool))
            items = pa.StructArray.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["h0", "h1"], mask=blank)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["doc_id", "th", "lines"])

    slim = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where("text is not null")
    return slim.mapInArrow(run, f"doc_id {kind}, th long, lines array<struct<h0:long,h1:long>>")


def buckets(docs: DataFrame, parts: int) -> DataFrame:
    """(key, h0, n): members of at least all buckets that hold two lines or more, and how often they occur; repeats possible.

    The entries of a bucket that is crowded in a batch go to all tasks; one of them also goes where the bucket belongs,
    so that a line which is alone there isn't taken for the only one."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for b in batches:
            lines, ids, n = _fresh(b.column(0).to_pylist())
            entries = np.empty((len(lines), BANDS), _ENTRY)
            entries["key"], entries["h0"], entries["n"] = band_keys(lines), ids[:, :1], n[:, None]
            entries = entries.ravel()
            entries = entries[np.argsort(entries["key"])]
            key = entries["key"]
            part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            size = np.diff(first, append=len(key))
            crowded = np.repeat(size > HOT, size)
            dealt = np.flatnonzero(crowded)
            salted = rng.integers(0, parts, len(dealt))
            crowded[first[size > HOT]] = False
            order = np.argsort(salted, kind="stable")
            for mixed, at, of in ((False, np.flatnonzero(~crowded), None), (True, dealt[order], salted[order])):
                of = part[at] if of is None else of
                keys, begin = np.unique(of, return_index=True)
                blobs = np.split(entries[at], begin[1:]) if len(keys) else []
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.tobytes() for x in blobs], pa.binary()), pa.array([mixed] * len(keys), pa.bool_())], names=["part", "entries", "mixed"])

    def meet(t: pa.Table) -> pa.Table:
        blobs, mixed = t.column("entries").to_pylist(), t.column("mixed").to_pylist()
        e = np.frombuffer(b"".join([x for x, m in zip(blobs, mixed, strict=True) if not m]), _ENTRY)
        e = e[np.argsort(e["key"])]
        same = e["key"][1:] == e["key"][:-1]
        # Buckets with entries of one line only, from several batches, fall away too.
        first = np.flatnonzero(np.append(True, ~same)[: len(e)])
        if len(e):
            size = np.diff(first, append=len(e))
            several = np.minimum.reduceat(e["h0"], first) < np.maximum.reduceat(e["h0"], first)
            crowd = np.frombuffer(b"".join([x for x, m in zip(blobs, mixed, strict=True) if m]), _ENTRY)
            e = np.concatenate([e[np.repeat(several | (size > 1) & np.isin(e["key"][first], crowd["key"]), size)], crowd])
        else:
            e = np.frombuffer(b"".join(blobs), _ENTRY)
        e = e[np.lexsort((e["h0"], e["key"]))]
        first = np.flatnonzero(np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["h0"][1:] != e["h0"][:-1]))[: len(e)])
        n = np.add.reduceat(e["n"].astype(np.int64), first) if len(e) else np.empty(0, np.int64)
        return pa.table({"key": e["key"][first].view(np.int64), "h0": e["h0"][first], "n": n})

    packed_ = docs.select("text").mapInArrow(spread, "part long, entries binary, mixed boolean")
    return packed_.groupBy("part").applyInArrow(meet, "key long, h0 long, n long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h0, h1, line) of at least all lines whose h0 is in wanted, repeats possible.

    A sieve spares most others the shuffle; the joins that follow are exact."""
    may = sieve(wanted, "h0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, ids, _ = _fresh(b.column(0).to_pylist())
            hit = np.flatnonzero(may(ids[:, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit, 0]), pa.array(ids[hit, 1]), pa.array([lines[i] for i in hit.tolist()], pa.string())], names=["h0", "h1", "line"])

    return docs.select("text").mapInArrow(run, "h0 long, h1 long, line string")


def _tokens(shingled: np.ndarray | set[str]) -> np.ndarray:
    """Shingles as sorted 64-bit numbers: those of packed(), and hashes of the others."""
    if not isinstance(shingled, set):
        return shingled
    hashed = [int.from_bytes(x.encode("latin-1"), "little") if max(x) < "\u0100" else xxhash.xxh64_intdigest(x) for x in shingled]
    return np.unique(np.array(hashed, np.uint64))


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: p, a, many; texts: h0, h1, line. Per pair: p; the whole ids of both lines; whether they are similar by exact
    comparison; how many shingles a has; and where many > 1, the shingles that only one of the two has."""
    left, right = (texts.select(F.col("h0").alias(f"h{s}"), F.col("h1").alias(f"g{s}"), F.col("line").alias(f"l{s}")) for s in "pa")
    both = pairs.join(right, pairs.a == right.ha).join(left, F.col("p") == left.hp).select("p", "a", "gp", "ga", "lp", "la", "many")
    name = lambda h, g: f"{h & _ALL:016x}{g & _ALL:016x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            rows = []
            for p, a, gp, ga, lp, la, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lp != last:  # rows come sorted by p
                    last, x = lp, packed(lp)
                y = packed(la)
                shared = common(x, y)
                linked = shared >= SIMILARITY * (len(x) + len(y) - shared)
                differ = np.setxor1d(_tokens(x), _tokens(y), assume_unique=True).tobytes() if many > 1 else None
                rows.append((p, name(p, gp), name(a, ga), linked, len(y), differ))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["p", "to", "id", "linked", "size", "differ"])

    return both.mapInArrow(run, "p long, to string, id string, linked boolean, size int, differ binary")


def joined(ids: list[str], linked: np.ndarray, sizes: np.ndarray, differ: list[np.ndarray]) -> list[tuple[str, str]]:
    """Links that connect the lines of a group as far as they are similar, given what each differs in from one and the
    same line, and whether it is linked to that.

    The symmetric difference of two lines is that of their differences, whatever they refer to; so shingles that most
    lines differ in are turned round first. Only lines that aren't linked look for others, through the lines that hold
    their shingles."""
    m = len(ids)
    line = np.repeat(np.arange(m), [len(d) for d in differ])
    token = np.unique(np.concatenate(differ), return_inverse=True)[1].reshape(-1)
    often = np.bincount(token)
    # Turn round what more than half of the lines differ in.
    turned = np.flatnonzero(2 * often > m)
    if len(turned):
        held = np.zeros((len(turned), m), bool)
        at = np.isin(token, turned)
        held[np.searchsorted(turned, token[at]), line[at]] = True
        which, who = np.nonzero(~held)
        token, line = np.append(token[~at], turned[which]), np.append(line[~at], who)
    counts = np.bincount(line, minlength=m)
    order = np.argsort(token, kind="stable")
    post, ends = line[order], np.cumsum(np.bincount(token, minlength=len(often)))
    starts = ends - np.bincount(token, minlength=len(often))
    order = np.argsort(line, kind="stable")
    mine, begin = token[order], np.cumsum(counts) - counts
    up = np.arange(m)
    up[linked] = np.flatnonzero(linked)[0] if linked.any() else 0
    found = []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in np.flatnonzero(~linked).tolist():
        t = mine[begin[i] : begin[i] + counts[i]]
        n = ends[t] - starts[t]
        where = np.arange(n.sum()) + np.repeat(starts[t] - np.cumsum(n) + n, n)
        shared = np.bincount(post[where], minlength=m)
        near = np.flatnonzero(9 * (counts[i] + counts - 2 * shared) <= sizes[i] + sizes)
        for j in near.tolist():
            if (x := root(i)) != (y := root(j)):
                up[max(x, y)] = min(x, y)
                found.append((ids[i], ids[j]))
    return found


def further(first: DataFrame) -> DataFrame:
    """first: compared pairs. (a, b): links between lines of one group that aren't both linked to its leader.

    A group of more than GROUP lines, or BYTES of differences, is split in parts, every two of which make a task."""
    size = F.length("differ")
    groups = first.where("differ is not null").groupBy(F.col("p").alias("g")).agg(
        F.count(F.lit(1)).alias("many"), F.sum(size).alias("bytes"), F.min("linked").alias("all"),
    ).where("not all").select("g", F.ceil(F.greatest(F.col("many") / GROUP, F.col("bytes") / BYTES)).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    rows = first.where("differ is not null").join(groups, F.col("p") == F.col("g")).select("p", F.explode(others).alias("of"), "id", "linked", "size", "differ")

    def run(t: pa.Table) -> pa.Table:
        t = t.select(["id", "linked", "size", "differ"]).combine_chunks()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("differ").to_pylist()]
        links = joined(t.column("id").to_pylist(), t.column("linked").to_numpy().astype(bool), t.column("size").to_numpy().astype(np.int64), sets)
        return pa.table({"a": pa.array([x for x, _ in links], pa.string()), "b": pa.array([x for _, x in links], pa.string())})

    return rows.select("p", "of.i", "of.j", "id", "linked", "size", "differ").groupBy("p", "i", "j").applyInArrow(run, "a string, b string")


def components(docs: DataFrame, seen: DataFrame) -> DataFrame | None:
    """seen: occurrences(docs). (h0, h1, component) of the lines that are similar to others."""
    lines = seen.agg(F.sum(F.size("lines"))).first()[0] or 0
    parts = max(2 * n_tasks(docs.sparkSession), lines * BANDS * _ENTRY.itemsize // TASK)
    met = staged(buckets(docs, parts), "buckets")
    lead = met.groupBy("key").agg(F.max(F.struct("n", "h0")).alias("lead"), F.min("h0").alias("lo"), F.max("h0").alias("hi")).where("lo < hi").select(F.col("key").alias("k"), F.col("lead.h0").alias("p"))
    pairs = staged(met.join(lead, F.col("key") == F.col("k")).where("h0 <> p").select("p", F.col("h0").alias("a")).distinct(), "led")
    if pairs.isEmpty():
        return None
    wanted = pairs.select(F.col("a").alias("h0")).unionByName(pairs.select(F.col("p").alias("h0"))).distinct()
    texts = staged(_texts(docs, wanted).dropDuplicates(["h0", "h1"]), "texts")
    remove_staged(met)
    many = pairs.groupBy(F.col("p").alias("g")).agg(F.count(F.lit(1)).alias("many"))
    first = staged(compared(pairs.join(many, F.col("p") == F.col("g")).drop("g"), texts), "compared")
    links = first.where("linked").select(F.col("to").alias("a"), F.col("id").alias("b")).unionByName(further(first))
    of = connected(links, "lines")
    part = lambda at: F.conv(F.substring("node", at, 16), 16, -10).cast("long")
    return of.select(part(1).alias("h0"), part(17).alias("h1"), "component")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): positions of the lines of each document that go; documents without any are left out."""
    seen = staged(occurrences(docs), "occurrences")
    each = seen.select("doc_id", "th", F.posexplode("lines").alias("pos", "l")).where("l is not null").select("doc_id", "th", "pos", "l.h0", "l.h1")
    groups = each.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    groups = groups.select("h0", "h1", F.concat(hexed("h0"), hexed("h1")).alias("component"))
    of = components(docs, seen)
    if of is not None:
        of = staged(of, "similar")
        groups = groups.join(of, ["h0", "h1"], "left_anti").unionByName(of)
    # As a table, so that the join may split a line that is everywhere.
    groups = staged(groups, "groups")
    place = F.struct("doc_id", "th", "pos")
    hits = staged(each.join(groups, ["h0", "h1"]).select(place.alias("place"), "component"), "hits")
    keep = staged(hits.groupBy(F.col("component").alias("of")).agg(F.min("place").alias("keep")), "keep")
    gone = hits.join(keep, F.col("component") == F.col("of")).where(~F.col("place").eqNullSafe(F.col("keep")))
    return gone.groupBy("place.doc_id", "place.th").agg(F.collect_set("place.pos").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns, with only the first line of each component in its text.

    First is the least (doc_id, hash of the text, position). Blank lines always stay. Repeated rows (equal doc_id and
    text) count as one document and each come out with the same text. A null text stays null. A document all of whose
    lines go stays with an empty text. A line of fewer than SHINGLE characters is similar to equal lines alone. Very long
    texts and lines are read whole. An empty table gives an empty result. Columns may have any names but those that begin
    with two underscores."""
    hidden(docs)
    return _applied(docs).drop("__gone", "__lines")


def _applied(docs: DataFrame) -> DataFrame:
    gone = staged(removals(docs), "gone").select(F.col("doc_id").alias("__d"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, docs.doc_id.eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__th")), "left")
    joined = joined.select(*docs.columns, "__gone", F.lit(0).alias("__lines"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = [], []
            for t, g in zip(b.column(at).to_pylist(), b.column(b.num_columns - 2).to_pylist(), strict=True):
                parts = t.split("\n") if t else []
                n.append(sum(1 for x in parts if x.strip()))
                if g:
                    out = set(g)
                    t = "\n".join([x for i, x in enumerate(parts) if i not in out])
                texts.append(t)
            b = b.set_column(at, b.schema.field(at), pa.array(texts, pa.string()))
            yield b.set_column(b.num_columns - 1, "__lines", pa.array(n, pa.int32()))

    return joined.mapInArrow(run, joined.schema)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines (not blank), n_removed, kept_sha256 of the text that is left (null: empty)."""
    slim = docs.select("doc_id", "text")
    return _applied(slim).select(
        "doc_id", F.col("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
