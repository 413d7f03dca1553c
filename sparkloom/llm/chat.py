"""Chat formatting by perspective rotation: every participant in turn is the assistant. DataFrame functions only.

For each conversation and participant the whole dialogue is rendered, with the others as named users. Each turn is one
row: its segment of the rendered text, where that begins there, and the part of it that the loss counts (the
participant's own words and end mark; nothing in the turns of others). The rendered text is the segments in order;
turns stay rows, so the longest conversation is never gathered in one place. Texts and names cannot forge the
template's marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_columns

# The marks of the template, what they begin with and what that becomes in texts, and the role that is
# nobody's turn.
START, END = "<|im_start|>", "<|im_end|>"
MARK, HARMLESS = "<|", "< |"
SYSTEM = "system"
NAMELESS = "unknown"
#: Turns to a block of those whose lengths are summed first.
BLOCK = 256


def _shown(name: Column) -> Column:
    """A name as it is shown: all but letters, digits and a few marks become _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_.@-]", "_")


def rotate(df: DataFrame) -> DataFrame:
    """conv_id, participant, turn, speaker, role, segment, begin (code points of the rendered text before the segment),
    mask_start, mask_end (code points of segment; 0, 0: masked).

    Turns are in the order of turn (null first), then speaker and text. System turns are kept in every perspective and
    are no participant; a conversation of system turns only has no perspective. A null role is the participant
    `unknown`; a null text is empty. A row of a null conversation is a conversation of its own. Repeated rows are
    rendered each. In texts `<|` becomes `< |`, and in names what is no letter, digit or one of _.@- becomes `_`. Empty
    tables give empty ones; other columns are left out.
    """
    turns = own_columns(df, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit(NAMELESS)).alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(HARMLESS)).alias("text")
    )
    people = turns.where((F.col("speaker") != SYSTEM) & F.col("conv_id").isNotNull()).select("conv_id", F.col("speaker").alias("participant")).distinct()
    alone = turns.where(F.col("conv_id").isNull() & (F.col("speaker") != SYSTEM)).withColumn("participant", F.col("speaker"))
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("participant"), "assistant").otherwise("user")
    head = F.concat(F.lit(START), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), _shown(F.col("speaker")))).otherwise(""), F.lit("\n"))
    long = F.length(head) + F.length("text") + len(END) + 1
    both = turns.join(people, "conv_id").withColumn("role", role).withColumn("long", long).withColumn("block", F.floor(F.col("turn") / BLOCK))
    # begins: lengths are summed by blocks of turns, then within them, so that a long conversation is in no one task
    own = ["conv_id", "participant", "block"]
    blocks = both.groupBy(*own).agg(F.sum("long").alias("all"))
    upto = Window.partitionBy("conv_id", "participant").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(c).alias(f"b_{c}") for c in own], F.coalesce(F.sum("all").over(upto), F.lit(0)).alias("before"))
    named = both.join(blocks, (F.col("conv_id") == F.col("b_conv_id")) & (F.col("participant") == F.col("b_participant")) & F.col("block").eqNullSafe(F.col("b_block")))
    within = Window.partitionBy(*own).orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("begin", F.col("before") + F.coalesce(F.sum("long").over(within), F.lit(0)))
    fields = ["conv_id", "participant", "turn", "speaker", "role", "text", "begin"]
    rows = placed.select(*fields).unionByName(alone.withColumn("role", role).withColumn("begin", F.lit(0).cast("long")).select(*fields))
    mine = F.col("role") == "assistant"
    return rows.select(
        "conv_id",
        "participant",
        "turn",
        "speaker",
        "role",
        F.concat(head, "text", F.lit(END), F.lit("\n")).alias("segment"),
        F.col("begin").cast("long").alias("begin"),
        F.when(mine, F.length(head)).otherwise(0).cast("long").alias("mask_start"),
        F.when(mine, F.length(head) + F.length("text") + len(END)).otherwise(0).cast("long").alias("mask_end"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system' AND conv_id IS NOT NULL),
b AS (
  SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user' END AS role
  FROM (SELECT t.*, participant FROM t JOIN p USING (conv_id) UNION ALL SELECT *, speaker FROM t WHERE conv_id IS NULL AND speaker <> 'system')),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(speaker, '[^\p{L}\p{N}_.@-]', '_', 'g') ELSE '' END || chr(10) AS head FROM b)
SELECT conv_id, participant, turn, speaker, role, head || text || '<|im_end|>' || chr(10) AS segment,
  CASE WHEN conv_id IS NULL THEN 0 ELSE coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS "begin",
  CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END::BIGINT AS mask_start,
  CASE WHEN role = 'assistant' THEN length(head) + length(text) + 10 ELSE 0 END::BIGINT AS mask_end
FROM h
"""
