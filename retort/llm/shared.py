"""Helpers that every corpus operator uses: table access, staged tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, if all runs
    on one machine (tests); on a cluster that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        context = spark.sparkContext
        place = context.getCheckpointDir()
        if not place:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="retort-shared-")
            context.setCheckpointDir(place)
    return place.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors don't matter.

    The files stay until the folder is cleared, since the returned DataFrame is lazy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/staged-" in folder:
            delete(df.sparkSession, folder)


SIEVE_BITS = (20, 27)  #: least and greatest logarithm of a sieve's size: 128 KB to 16 MB are broadcast


def sieve(keys: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """For use in Python workers: which of an array of 64-bit hashes may be among the keys (surely, those that are).

    A table of bits by the keys' low bits, sized by the number of keys up to SIEVE_BITS. It spares a later exact join
    most rows that find nothing; where it is full it spares less, and costs time only."""
    bits = min(SIEVE_BITS[1], max(SIEVE_BITS[0], (16 * keys.count()).bit_length()))
    mask = (1 << bits) - 1
    word, bit = F.shiftright(F.col(column).bitwiseAND(mask), 6), F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    got = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2 ** (SIEVE_BITS[1] - 6) rows
    table = np.zeros(1 << (bits - 6), np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    held = keys.sparkSession.sparkContext.broadcast(table.tobytes())

    def may(hashes: np.ndarray) -> np.ndarray:
        flags = np.frombuffer(held.value, np.int64)
        return (flags[(hashes & mask) >> 6] >> (hashes & 63) & 1).astype(bool)

    return may


def hidden(docs: DataFrame) -> None:
    """Names that begin with two underscores are the operators' own where a table keeps its columns."""
    if taken := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns whose names begin with two underscores: {', '.join(taken)}")


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(h, y, t): hash of the doc_id, label and text (UTF-8, null: empty) of at most limit labelled documents, those of
    least h, staged. A doc_id counts once: its least label, and of its texts the one of least hash."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit)
    )
    texts = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).cast("binary").alias("t"))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    return staged(rows.groupBy("doc_id").agg(F.min("h").alias("h"), F.min("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t")).select("h", "y", "t"), "labelled")


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds (distributed union-find).

    edges: columns a, b of one orderable type, in any order, repeats and loops allowed.
    Returns (node, component): every node of a non-loop edge with the least node reachable from it.
    Each round is staged, so the plan stays short; the rounds grow with the logarithm of the longest path.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links = staged(links, f"{label}-cc")
    for _ in range(max_rounds):
        # large-star: each neighbour greater than a node is linked to that node's least neighbour.
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        least = both.groupBy(a.alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(least, a == F.col("n")).select(b.alias("a"), F.col("m").alias("b")).distinct()
        # small-star: each node and its smaller neighbours are linked to the least of them.
        low = large.groupBy(a.alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, a == F.col("n")).select(b.alias("a"), F.col("m").alias("b"))
        after = small.where(a != b).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        after = staged(after, f"{label}-cc")
        # Done when every node has one link and no node that is linked to is itself linked further: stars only.
        done = after.groupBy("a").count().where("count > 1").isEmpty()
        done = done and after.select("a").intersect(after.select("b")).isEmpty()
        remove_staged(links)
        links = after
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = links.select(b.alias("node"), b.alias("component")).distinct()
    return links.select(a.alias("node"), b.alias("component")).unionByName(roots)
