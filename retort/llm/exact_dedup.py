"""Exact deduplication by content-defined chunk recipes; DataFrame functions only.

A text is cut where its own bytes say so: after a least length, at the first place where the hash of the last few bytes
(the low halves of each, as classes) has one value of many. So equal passages give equal chunks wherever they stand, and
whatever they are made of. A chunk's identifier is its 64-bit hash, verified: over all documents, one
identifier must stand for one SHA-256 digest. A document becomes the ordered list of its identifiers, and only those
short lists are shuffled and compared; long texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Bytes: a chunk ends at the first place from MIN_CHUNK on where a hash of the bytes before gives a mark, at MAX_CHUNK
#: at the latest.
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: The hash sorts the low halves of bytes into four classes; a mark is these in order, one in 256 for random bytes. It is
#: looked for in neighbouring bytes and in every second, third and fourth one, as letters of all scripts differ there.
CLASSES = "[159D]", "[26AE]", "[37BF]", "[048C]"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks of a text's UTF-8 bytes, as hexadecimal digits; joined they give it back. An empty text has
    none. A passage whose bytes never give a mark (one letter repeated) is cut at MAX_CHUNK."""
    marks = "|".join(f"(?<={('.' * (2 * stride - 1)).join(('.' + CLASSES[0], *CLASSES[1:]))})" for stride in (1, 2, 3, 4))
    pattern = rf".{{{2 * least}}}(?:..){{0,{most - least}}}?(?:{marks})|.{{1,{2 * most}}}"
    return F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, pieces): pieces is the ordered list of (id, digest) of the text's chunks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    piece = lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(F.unhex(c), 256)).alias("digest"))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"),
        F.transform(chunks(text), piece).alias("pieces"),
    )


def verified(pieces: DataFrame) -> bool:
    """Whether every identifier stands for one chunk content."""
    pairs = pieces.select(F.explode("pieces").alias("p")).select("p.id", "p.digest").distinct()
    return pairs.groupBy("id").count().where("count > 1").limit(1).count() == 0


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. A null text counts as empty; all empty texts form one group.
    Repeated rows (one doc_id twice with one text) are all in their group and all kept if their doc_id is the largest;
    a null doc_id is less than any other. An empty table gives an empty result; other columns are ignored.
    """
    base = staged(recipes(docs, id_col, text_col), "recipes")
    # Should two contents ever share an identifier, the digests themselves serve as identifiers.
    part = "id" if verified(base) else "digest"
    rows = base.select("doc_id", "text_sha256", F.col(f"pieces.{part}").alias("recipe"))
    # Only repeated recipes are joined back; written as a table first, so the join may split a large group.
    groups = (
        rows.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("recipe").alias("same"), "keep", "n")
    )
    groups = staged(groups, "groups")
    return rows.join(groups, F.col("recipe") == F.col("same"), "left").select(
        "doc_id", F.coalesce("keep", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.coalesce("keep", "doc_id")), F.lit(False)).alias("kept"), "text_sha256",
    )


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
