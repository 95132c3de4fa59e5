"""Chat formatting by multi-party perspective rotation; DataFrame functions only.

Every participant of a conversation gets a rendering of the whole dialogue in which that speaker is the assistant and
the others are named users. A rendering is kept as its segments, one per turn, each with its place in the rendering and
the span that counts for the loss, so a conversation of any length stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Speakers that give context but are no participants.
CONTEXT = ("system",)
END = "<|end|>\n"
BLOCK = 256  #: turns summed together before the running sum over a conversation


def rotate(turns: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """turns: conv_id, turn, role, text. A row for each perspective and turn of a conversation.

    Returns conv_id, perspective, turn, role, rendered, seg_start, seg_end, loss_start, loss_end: positions count
    characters from the start of the perspective's rendering; loss_start and loss_end are null unless the perspective's
    own speaker talks, and then span its text and end mark. Turns go by turn, then role and text; repeated rows are
    rendered each. A null text counts as empty, a null role as `unknown`, a null turn comes first, a null conv_id is a
    conversation of its own. A conversation with context only has no participants and no rows.
    """
    t = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    speaks = ~F.col("role").isin(*context) if context else F.lit(True)
    cast = t.where(speaks).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    head = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(~speaks, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user|>"), F.col("role"), F.lit(":\n")))
    )
    seen = t.join(cast, t.conv_id.eqNullSafe(cast.c)).drop("c").select(
        "*", head.alias("head"), F.col("turn").isNotNull().alias("known"), F.floor(F.coalesce("turn", F.lit(0)) / BLOCK).alias("block"),
    ).withColumn("rendered", F.concat("head", "text", F.lit(END))).withColumn("n", F.length("rendered"))
    # Running lengths in two levels: over blocks, and inside each block. Null turns are a block before all others.
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("known", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        seen.groupBy("conv_id", "perspective", "known", "block").agg(F.sum("n").alias("s"))
        .select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("known").alias("k"), F.col("block").alias("b"),
                F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("conv_id", "perspective", "known", "block").orderBy("turn", "role", "text")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = seen.join(base, seen.conv_id.eqNullSafe(base.c) & (F.col("perspective") == base.p) & (F.col("known") == base.k) & (F.col("block") == base.b))
    placed = placed.withColumn("seg_end", F.col("base") + F.sum("n").over(inside))
    return placed.select(
        "conv_id", "perspective", "turn", "role", "rendered",
        (F.col("seg_end") - F.col("n")).alias("seg_start"), "seg_end",
        F.when(own, F.col("seg_end") - F.col("n") + F.length("head")).alias("loss_start"),
        F.when(own, F.col("seg_end")).alias("loss_end"),
    )


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.*, p.perspective,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10)
         WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user|>' || role || ':' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM r),
e AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text
        ROWS UNBOUNDED PRECEDING)::BIGINT AS seg_end FROM s)
SELECT conv_id, perspective, turn, role, rendered, seg_end - length(rendered) AS seg_start, seg_end,
  CASE WHEN role = perspective THEN seg_end - length(rendered) + length(head) END AS loss_start,
  CASE WHEN role = perspective THEN seg_end END AS loss_end
FROM e
"""
