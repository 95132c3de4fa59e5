"""Substring deduplication over a log-structured fingerprint index.

A window is WINDOW consecutive words. Of the hashes of the sub-windows of SUB words that a window holds, the least (the
leftmost, of equal ones) is its pick: equal windows have equal picks in equal places, and neighbours mostly share one,
so about one hash in fourteen words is kept, together with a digest of all the words that the windows of a pick span.

Each batch of documents is written to the index as a run: its hashes counted, sorted, in buckets, never changed. The new
run is merge-joined with the runs of history; nothing of history is shuffled for that. Hashes that occur again are hits,
and the runs are compacted into one when there are several. Hits are verified: picks with equal hash and equal digest
have equal windows; where picks of one hash differ in what is around them, their windows are compared one by one by
128-bit digests of their very words. An index may be kept, opened later and given further batches; a batch's report
holds it against itself and all that came before. Documents that are copies as a whole are told by a digest of all their
words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, n_tasks, shared_dir, sieve, staged

WINDOW, SUB = 35, 8
SPAN = WINDOW - SUB + 1  #: sub-windows in a window
BATCHES, RUNS = 2, 2  #: batches that a table without an index is added in; runs from which an index is compacted
SLICE, ROWS = 1 << 16, 256  #: words of texts that are hashed together; rows whose texts are held at once
_FACTORS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_PICK = np.dtype([("fp", "<i8"), ("digest", "<i8"), ("start", "<u4"), ("n", "u1")])


@cache
def _powers(n: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64."""
    inverse = pow(factor, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, f, np.uint64)])) for f in (factor, inverse))


def _mix(x: np.ndarray) -> np.ndarray:
    """All bits spread."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


class Words:
    """Hashes of any runs of a list of words."""

    def __init__(self, words: list[bytes]) -> None:
        h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
        n = 1 << max(10, len(words).bit_length())
        self.sums, self.down = [], []
        for each, factor in zip((h, _mix(h ^ np.uint64(0x5851F42D4C957F2D))), _FACTORS, strict=True):
            up, down = _powers(n, factor)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * up[: len(h)])]))
            self.down.append(down)

    def runs(self, kind: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of one of two kinds of the words from begin to end."""
        return _mix((self.sums[kind][end] - self.sums[kind][begin]) * self.down[kind][begin])


def picks(words: Words, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picks of texts that end at ends, with window starts counted in their own text; and whose each is."""
    total = int(ends[-1]) if len(ends) else 0
    if total < WINDOW:
        return np.empty(0, _PICK), np.empty(0, np.int64)
    at = np.arange(total - SUB + 1)
    h = words.runs(0, at, at + SUB)
    # The least of each SPAN neighbours and its place, the leftmost of equal ones.
    least, place, k = h, at, 1
    while k < SPAN:
        step = min(k, SPAN - k)
        a, b = least[: len(least) - step], least[step:]
        least, place = np.where(b < a, b, a), np.where(b < a, place[step:], place[: len(a)])
        k += step
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), np.maximum(0, ends - starts - WINDOW + 1))
    inside = np.arange(len(text)) - np.repeat(np.cumsum(np.bincount(text, minlength=len(ends))) - np.bincount(text, minlength=len(ends)), np.bincount(text, minlength=len(ends)))
    window = starts[text] + inside
    own = place[window]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1]))[: len(own)])
    n = np.diff(first, append=len(own))
    lo, p = window[first], own[first]
    found = np.empty(len(first), _PICK)
    found["fp"] = h[p].view(np.int64)
    around = words.runs(1, lo, lo + n - 1 + WINDOW) ^ _mix(((p - lo) * 256 + n).astype(np.uint64))
    found["digest"], found["start"], found["n"] = around.view(np.int64), inside[first], n
    return found, text[first]


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few texts."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _slices(texts: list[bytes | None]) -> Iterator[tuple[list[list[bytes]], Words, np.ndarray]]:
    """Texts' words, in slices, with their hashes and ends."""
    at = 0
    while at < len(texts):
        many, size = [], 0
        while at < len(texts) and size < SLICE:
            many.append(_words(texts[at]))
            size += len(many[-1])
            at += 1
        yield many, Words([w for words in many for w in words]), np.cumsum([len(w) for w in many])


def covered(starts: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Which of a text's words are in n windows from each of starts on."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n - 1 + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def survey(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, th, n_words, whole, picks): 64-bit identifier of the text, digest of all words, and packed picks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            n, whole, packed = [], [], []
            for many, words, ends in _slices(b.column(2).to_pylist()):
                n += map(len, many)
                whole += [hashlib.sha256(b" ".join(w)).digest() for w in many]
                found, text = picks(words, ends)
                cut = np.searchsorted(text, np.arange(len(many) + 1))
                packed += [found[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n_words", "whole", "picks"])

    slim = docs.select("doc_id", _identifier(seed).alias("th"), docs["text"].cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, th long, n_words long, whole binary, picks binary")


def _identifier(seed: int) -> Column:
    return F.xxhash64("text", F.lit(seed))


def _each(rows: DataFrame, schema: str, some: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What some() makes of (picks, their texts' identifiers) of a survey's batches; of whole copies in a batch one
    speaks, as its windows are repeated anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = {w: i for i, w in enumerate(b.column(1).to_pylist())}.values()
            raw, th = b.column(2).to_pylist(), b.column(0).to_numpy(zero_copy_only=False)
            blobs = [raw[i] for i in one]
            sizes = np.array([len(x) // _PICK.itemsize for x in blobs], np.int64)
            yield some(np.frombuffer(b"".join(blobs), _PICK), np.repeat(th[list(one)], sizes))

    return rows.select("th", "whole", "picks").mapInArrow(run, schema)


class Index:
    """Runs of (fp, n), each in buckets by fp, sorted and never changed; n counts occurrences up to 2.

    folder holds the runs and, for each batch, its survey and its hits. To open an index again, give its folder and the
    tables of its batches, whose texts are read where windows are verified."""

    def __init__(self, spark: SparkSession, folder: str | None = None, batches: list[DataFrame] | None = None, buckets: int | None = None, seed: int = 0) -> None:
        self.spark, self.seed = spark, seed
        self.folder = folder or f"{shared_dir(spark)}/staged-index-{uuid.uuid4().hex}"
        self.batches: list[DataFrame] = list(batches or [])
        self.buckets = buckets or n_tasks(spark)
        self.runs: list[tuple[int, int]] = []  # first and last batch
        self.tables: dict[tuple[int, int], str] = {}
        if batches:
            marks = [r.mark for r in spark.read.json(f"{self.folder}/marks-*").select("mark").collect()]
            found = sorted({(m.first, m.last, m.buckets, m.seed) for m in marks})
            whole = [(a, z) for a, z, _, _ in found if not any(b <= a and z <= y and (b, y) != (a, z) for b, y, _, _ in found)]
            self.runs, self.buckets, self.seed = whole, found[0][2], found[0][3]
            if len(batches) != whole[-1][1] + 1:
                raise ValueError("the index has another number of batches")

    def _path(self, kind: str, *number: int) -> str:
        return f"{self.folder}/{kind}-" + "-".join(map(str, number))

    def _table(self, run: tuple[int, int]) -> DataFrame:
        """A run with its buckets and order known to Spark."""
        if run not in self.tables:
            self.tables[run] = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[run]} (fp BIGINT, n TINYINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self._path('run', *run)}'")
        return self.spark.table(self.tables[run])

    def _write(self, run: tuple[int, int], counted: DataFrame) -> None:
        self.tables[run] = f"run_{uuid.uuid4().hex}"
        sized = counted.select("fp", F.least("n", F.lit(2)).cast("tinyint").alias("n"))
        sized.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", self._path("run", *run)).format("parquet").saveAsTable(self.tables[run])
        mark = self.spark.range(1).select(F.struct(*[F.lit(v).alias(k) for k, v in zip(("first", "last", "buckets", "seed"), (*run, self.buckets, self.seed), strict=True)]).alias("mark"))
        mark.write.json(self._path("marks", *run))
        self.runs.append(run)

    def _forget(self, run: tuple[int, int]) -> None:
        self.runs.remove(run)
        if run in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
        for kind in ("marks", "run"):
            delete(self.spark, self._path(kind, *run))

    def add(self, docs: DataFrame) -> int:
        """Write a batch as a run, merge-join it with every earlier one, and compact. Returns the batch's number."""
        k = len(self.batches)
        self.batches.append(docs)
        survey(docs, self.seed).write.parquet(self._path("survey", k))
        fps = _each(self.survey(k), "fp long", lambda found, _: pa.RecordBatch.from_arrays([pa.array(found["fp"].copy())], names=["fp"]))
        old = list(self.runs)
        self._write((k, k), fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).repartition(self.buckets, "fp"))
        new = self._table((k, k))
        hits = new.where("n > 1").select("fp")
        for run in old:
            hits = hits.unionByName(new.join(self._table(run).select("fp").hint("merge"), "fp").select("fp"))
        hits.write.parquet(self._path("hits", k))
        if len(self.runs) >= RUNS:
            self.compact()
        return k

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            old = list(self.runs)
            both = lambda x, y: x.join(y.select("fp", F.col("n").alias("m")), "fp", "full").select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            self._write((old[0][0], old[-1][1]), reduce(both, [self._table(r) for r in old]))
            for run in old:
                self._forget(run)

    def survey(self, k: int) -> DataFrame:
        return self.spark.read.parquet(self._path("survey", k))

    def hits(self, since: int = 0) -> DataFrame:
        """(fp): hashes that were found again when one of the batches from since on came."""
        found = self.spark.read.parquet(*[self._path("hits", k) for k in range(since, len(self.batches))])
        return found.distinct()

    def drop(self) -> None:
        """Delete all that the index has written."""
        for run in list(self.runs):
            self._forget(run)
        delete(self.spark, self.folder)

    def report(self, since: int = 0) -> DataFrame:
        """One row per document of the batches from since on, held against the whole index: doc_id, n_words, n_removed,
        kept_sha256."""
        every = reduce(DataFrame.unionByName, [self.survey(k) for k in range(len(self.batches))])
        texts = reduce(DataFrame.unionByName, [d.where("text is not null").select(_identifier(self.seed).alias("th"), d["text"].cast("binary").alias("text")) for d in self.batches])
        groups = staged(every.groupBy("whole").agg(F.count(F.lit(1)).alias("many"), F.min("th").alias("th")), "wholes")
        if not groups.groupBy("th").count().where("count > 1").isEmpty() or not every.groupBy("th").agg(F.min("whole").alias("x"), F.max("whole").alias("y")).where("x <> y").isEmpty():
            raise LookupError("two texts share an identifier; build the index with another seed")
        single = groups.where("many = 1").select("th")
        places = staged(self._places(every, texts, self.hits(since)).join(single, "th"), "places")
        done = _removed(texts, places.groupBy("th").agg(F.collect_list("at").alias("at")))
        copies = staged(groups.where("many > 1").select(F.col("whole").alias("w")), "copies")
        rows = reduce(DataFrame.unionByName, [self.survey(k) for k in range(since, len(self.batches))])
        gone = F.col("w").isNotNull() & (F.col("n_words") >= WINDOW)
        return (
            rows.select("th", "doc_id", "n_words", "whole").join(staged(done, "kept"), "th", "left").join(copies, F.col("whole") == F.col("w"), "left")
            .select(
                "doc_id", "n_words",
                F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
                F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("whole")))).alias("kept_sha256"),
            )
        )

    def _places(self, every: DataFrame, texts: DataFrame, hits: DataFrame) -> DataFrame:
        """(th, at): starts of repeated windows, as the first start * 256 + how many follow on each other."""
        hits = staged(hits, "hits")
        may = sieve(hits, "fp")

        def chosen(found: np.ndarray, th: np.ndarray) -> pa.RecordBatch:
            ok = may(found["fp"])
            found = found[ok]
            at = found["start"].astype(np.int64) * 256 + found["n"]
            return pa.RecordBatch.from_arrays([pa.array(th[ok]), pa.array(found["fp"].copy()), pa.array(found["digest"].copy()), pa.array(at)], names=["th", "fp", "digest", "at"])

        flagged = staged(_each(every, "th long, fp long, digest long, at long", chosen).join(hits, "fp"), "flagged")
        kinds = staged(flagged.groupBy("fp", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("one")), "kinds")
        # Equal hash and equal surroundings: all windows of the pick are repeated.
        whole = kinds.where("n > 1").select(F.col("fp").alias("f"), F.col("digest").alias("d"))
        places = flagged.join(whole, (F.col("fp") == F.col("f")) & (F.col("digest") == F.col("d"))).select("th", "at")
        # Equal hash, other surroundings: the windows of one pick of each kind are compared.
        several = kinds.groupBy(F.col("fp").alias("f")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("f")
        ask = staged(kinds.join(several, F.col("fp") == F.col("f")).select(F.col("fp").bitwiseXOR(F.col("one")).alias("key"), "one"), "asked")
        known, wanted = sieve(ask.select("one").distinct(), "one"), sieve(ask, "key")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                b = b.filter(pa.array(known(b.column(0).to_numpy(zero_copy_only=False))))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                at = 0
                for many, words, ends in _slices(b.column(1).to_pylist()):
                    found, text = picks(words, ends)
                    th = ids[at : at + len(many)][text] if len(text) else np.empty(0, np.int64)
                    ok = wanted(found["fp"] ^ th)
                    found, text, th = found[ok], text[ok], th[ok]
                    n = found["n"].astype(np.int64)
                    start = np.repeat(found["start"].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    place = start + np.repeat(np.concatenate([[0], ends[:-1]])[text], n).astype(np.int64)
                    digests = [pa.array(words.runs(kind, place, place + WINDOW).view(np.int64)) for kind in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(th, n)), pa.array(start * 256 + 1), *digests], names=["th", "at", "d0", "d1"])
                    at += len(many)

        seen = staged(texts.mapInArrow(look, "th long, at long, d0 long, d1 long"), "windows")
        again = staged(seen.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d0", "d1"), "again")
        return places.unionByName(seen.join(again, ["d0", "d1"]).select("th", "at"))


def _removed(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(th, removed, kept) of the texts that have places: how many words go, and the digest of the others."""
    places = staged(places, "spans")
    known = sieve(places, "th")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(known(b.column(0).to_numpy(zero_copy_only=False))))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            out = []
            for r, at, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words, spans = _words(text), np.array(at)
                gone = covered(spans >> 8, spans & 255, len(words))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((r, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = zip(*out, strict=True) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["th", "removed", "kept"])

    some = texts.mapInArrow(near, "th long, text binary")
    return places.join(some, "th").select("th", "at", "text").mapInArrow(remove, "th long, removed long, kept string")


def substring_dedup(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Words are maximal runs without ASCII white space. A word goes if it is in a window whose words also start
    anywhere else, in the same document too; all such occurrences go. A null text has no words; texts shorter than a
    window lose none. Repeated rows repeat each other's windows; a null or repeated doc_id makes no difference. An empty
    table gives an empty result; other columns are ignored.

    With an index docs is its next batch, and windows of the batches before count too; the index keeps it. Without one
    the table is added to an index of its own in BATCHES batches, dealt by text, and all of them are reported."""
    if index is not None:
        return index.report(index.add(docs))
    for seed in range(8):
        own = Index(docs.sparkSession, seed=seed)
        for k in range(BATCHES):
            own.add(docs.where(F.pmod(F.xxhash64("text"), F.lit(BATCHES)) == k))
        try:
            return own.report()
        except LookupError:
            own.drop()
    raise LookupError("two texts share an identifier with every seed")


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
hit AS (SELECT r, i FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM hit),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS k, count(*) AS n FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
