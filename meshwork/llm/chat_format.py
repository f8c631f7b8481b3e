"""Chat formatting: perspective rotation of multi-party conversations.

For every participant the dialogue is rendered with that speaker as assistant and
the others as named users; the mask covers what the speaker says. System turns keep
their role and are nobody's perspective.

A dialogue is rendered in segments of SEGMENT turns, so that a
conversation of any length is spread over many groups of bounded size; the parts of a dialogue
follow each other by ``segment``. Turns repeated word for word are counted
and rendered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.session import table

#: Turns of a segment.
SEGMENT = 256
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(speaker: Column, perspective: Column) -> Column:
    name = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def _safe(text: Column) -> Column:
    """A text can't hold the control marks: their first two characters are set apart."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per conversation, participant and segment.

    (conv_id, perspective, segment, n_turns, n_rows, rendered, mask): ``mask`` holds the spans
    "start-end" of code points in ``rendered`` that the speaker's text and its
    closing mark take, joined by commas; empty if there are none.

    Turns go by number (nulls first), then speaker and text. A null text is empty, a
    null speaker is named "unknown", a null conversation id is a conversation of its own. Rows that repeat
    a turn word for word are rendered once and counted in ``n_rows``. A conversation with
    system turns alone has no row. An empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        _safe(F.coalesce(F.col(speaker), F.lit("unknown"))).alias("speaker"),
        _safe(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    once = rows.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("times"))
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = once.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    header = _header(F.col("speaker"), F.col("perspective"))
    seen = seen.select(
        "conv_id",
        "perspective",
        F.coalesce(F.floor(F.col("turn") / segment), F.lit(-1)).cast("long").alias("segment"),
        F.struct("turn", "speaker", "text", F.char_length(header).alias("skip"), F.concat(header, F.col("text"), F.lit(CLOSE)).alias("said"), "times").alias("t"),
    )
    group = seen.groupBy("conv_id", "perspective", "segment").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = lambda x: x["speaker"] == F.col("perspective")
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["said"]) + 1).alias("at"),
            F.when(own(x), F.array_append(a["spans"], F.concat_ws("-", (a["at"] + x["skip"]).cast("string"), (a["at"] + F.char_length(x["said"])).cast("string")))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return group.select(
        "conv_id",
        "perspective",
        "segment",
        F.size("t").cast("long").alias("n_turns"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["times"]).alias("n_rows"),
        F.concat(F.array_join(F.transform("t", lambda x: x["said"]), "\n"), F.lit("\n")).alias("rendered"),
        F.array_join(spans, ",").alias("mask"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_OP1 = f"""
WITH r AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), o AS (
  SELECT conv_id, turn, speaker, text, count(*) AS times FROM r GROUP BY ALL
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> '{SYSTEM}'
), h AS (
  SELECT o.*, perspective, coalesce(CAST(floor(turn / {SEGMENT}) AS BIGINT), -1) AS segment,
         '{OPEN}' || CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS header
  FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, header || text || '{CLOSE}' AS said,
         coalesce(sum(length(header || text || '{CLOSE}') + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn NULLS FIRST, speaker, text
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM h
)
SELECT conv_id, perspective, segment, count(*) AS n_turns, CAST(sum(times) AS BIGINT) AS n_rows,
       string_agg(said, chr(10) ORDER BY turn NULLS FIRST, speaker, text) || chr(10) AS rendered,
       coalesce(string_agg(CASE WHEN speaker = perspective THEN (before + length(header))::BIGINT || '-' || (before + length(said))::BIGINT END, ',' ORDER BY turn NULLS FIRST, speaker, text), '') AS mask
FROM s GROUP BY ALL
"""
