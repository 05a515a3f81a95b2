"""Chat formatting: one rendering of a dialogue per participant.

In each rendering one speaker is the assistant, the others are named users, and the
spans that the assistant speaks are the ones to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _named(speaker: Column, context: tuple[str, ...]) -> Column:
    """How the turn of a speaker begins for everyone else."""
    return F.when(speaker.isin(*context), F.concat(F.lit(OPEN), speaker, F.lit("\n"))).otherwise(F.concat(F.lit(f"{OPEN}user name="), F.coalesce(speaker, F.lit("unknown")), F.lit("\n")))


OWN = f"{OPEN}assistant\n"


def rotate_perspectives(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    context: tuple[str, ...] = ("system",),
    block: int = 64,
) -> DataFrame:
    """One rendering per conversation and participant, in rows of consecutive parts.

    Participants are the speakers other than ``context`` roles, which stay as they are;
    a turn without a speaker is a user named unknown and takes no perspective. A part
    holds the turns whose numbers share ``floor(turn / block)``, so that no row and no task
    has to hold a whole conversation, however long; the parts of a rendering, joined in
    the order of ``part``, are the rendering. ``part_start`` is where a part begins in it,
    and ``mask`` lists the spans to train on as start:end in the whole rendering (code
    points, end exclusive, the closing mark included). Turns are ordered by number,
    speaker and text, null first in the last two and last in the first; equal rows are
    all kept, null texts are empty, and ``<|`` inside texts and names is written ``< |``
    so that no text can end its turn. Conversations whose turns all lack a speaker, or
    are all context, give no row. Null conversation ids are one conversation.
    """
    safe = lambda c: F.replace(c.cast("string"), F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.struct(F.col(conv).alias("id")).alias("conv"),  # a struct is never null, so that null ids meet
        F.coalesce(F.floor(F.col(turn) / block), F.lit(2**62)).cast("long").alias("block"),
        F.col(turn).alias("turn"),
        safe(F.col(speaker)).alias("speaker"),
        F.coalesce(safe(F.col(text)), F.lit("")).alias("text"),
    )
    # from lengths alone: where every part begins in each rendering
    named = F.length(_named(F.col("speaker"), context))
    lengths = rows.groupBy("conv", "block", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.sum(named + F.length("text") + len(CLOSE)).alias("length"), F.sum(len(OWN) - named).alias("more")
    )
    speaks = F.col("speaker").isNotNull() & ~F.coalesce(F.col("speaker").isin(*context), F.lit(False))
    people = rows.where(speaks).select("conv", F.col("speaker").alias("perspective")).distinct()
    parts = lengths.groupBy("conv", "block").agg(F.sum("length").alias("length")).join(people, "conv")
    own = lengths.where(speaks).select("conv", "block", F.col("speaker").alias("perspective"), "more")
    parts = parts.join(own, ["conv", "block", "perspective"], "left").withColumn("length", F.col("length") + F.coalesce("more", F.lit(0)))
    order = Window.partitionBy("conv", "perspective").orderBy("block")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv", "block", "perspective", (F.row_number().over(order) - 1).alias("part"), F.coalesce(before, F.lit(0)).alias("part_start"))
    # the texts move once, to their block
    blocks = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "speaker", "text"))).alias("turns"))
    said = blocks.join(parts, ["conv", "block"])
    me = F.col("perspective")
    head = lambda t: F.when(t["speaker"].eqNullSafe(me), F.lit(OWN)).otherwise(_named(t["speaker"], context))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), t["speaker"].eqNullSafe(me).alias("own")))
    start = F.struct(F.col("part_start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.concat_ws(":", begin, end))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return said.withColumn("pieces", pieces).select(
        F.col("conv.id").alias(conv),
        "perspective",
        "part",
        "part_start",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.array_join(F.aggregate("pieces", start, step)["spans"], ",").alias("mask"),
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id, COALESCE(CAST(FLOOR(turn / 64) AS BIGINT), 4611686018427387904) AS block, turn,
         REPLACE(role, '<|', '< |') AS speaker, COALESCE(REPLACE(text, '<|', '< |'), '') AS txt
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
s AS (
  SELECT t.conv_id, p.perspective, t.block, t.turn, t.speaker, t.txt,
         COALESCE(t.speaker = p.perspective, false) AS own,
         CASE WHEN t.speaker = p.perspective THEN '{OPEN}assistant' || chr(10)
              WHEN t.speaker = 'system' THEN '{OPEN}system' || chr(10)
              ELSE '{OPEN}user name=' || COALESCE(t.speaker, 'unknown') || chr(10) END AS head,
         t.txt || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (
  SELECT *, LENGTH(head) + LENGTH(body) AS len,
         ROW_NUMBER() OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS LAST, speaker NULLS FIRST, txt) AS rn
  FROM s),
e AS (SELECT *, SUM(len) OVER (PARTITION BY conv_id, perspective ORDER BY block, rn) AS till FROM r)
SELECT conv_id, perspective, CAST(DENSE_RANK() OVER (PARTITION BY conv_id, perspective ORDER BY block) - 1 AS INTEGER) AS part,
       CAST(MIN(till - len) AS BIGINT) AS part_start, CAST(COUNT(*) AS INTEGER) AS n_turns, STRING_AGG(head || body, '' ORDER BY rn) AS text,
       COALESCE(STRING_AGG(CAST(till - LENGTH(body) AS BIGINT) || ':' || CAST(till AS BIGINT), ',' ORDER BY rn) FILTER (WHERE own), '') AS mask
FROM e GROUP BY conv_id, perspective, block
"""
