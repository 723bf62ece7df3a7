"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, everyone else as a
named user, system turns as they are, and a loss mask on the assistant's turns. The result has one row for each
(conversation, perspective, turn): no conversation is gathered in one task, however long. Offsets in the rendered
dialogue are prefix sums in two levels, over blocks of turns and inside each block, so that a conversation that holds a
large share of all rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SYSTEM = "system"
_BLOCK_TURNS = 1024


def _rendered(role: Column, name: Column, text: Column) -> Column:
    label = F.when(role == "user", F.concat(F.lit("user name="), name)).otherwise(role)
    return F.concat(F.lit("<|"), label, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, rendered, start, end, loss_start, loss_end, loss).

    start and end are code-point offsets of the rendered turn in its dialogue; loss_start and loss_end bound the text
    that bears loss, end marker included, and are null where loss is 0. Null texts render as empty, null roles as a
    participant named `unknown`; system turns belong to no participant, and a conversation of system turns alone gives
    no rows. Turns are ordered by (turn, role, text), null turns first; exact repeats of a turn are all rendered. Rows
    with a null conv_id belong to no dialogue and are left out. Extra columns are ignored.
    """
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    people = rows.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = rows.join(people, "conv_id").withColumn("role", role).withColumn("rendered", _rendered(F.col("role"), F.col("speaker"), F.col("text")))
    seen = seen.withColumn("n", F.length("rendered").cast("long")).withColumn("block", F.coalesce(F.floor(F.col("turn") / _BLOCK_TURNS), F.lit(-(1 << 62))))
    key = ["conv_id", "perspective"]
    total = seen.groupBy(*key, "block").agg(F.sum("n").alias("m"))
    ahead = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*key, "block", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("base"))
    order = [F.col("turn").asc_nulls_first(), "speaker", "text"]
    inside = Window.partitionBy(*key, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, [*key, "block"])
    start = F.col("base") + F.col("inside")
    loss = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", "rendered", start.alias("start"), (start + F.col("n")).alias("end"),
        F.when(loss, start + F.lit(len("<|assistant|>\n"))).alias("loss_start"), F.when(loss, start + F.col("n") - 1).alias("loss_end"), loss.cast("int").alias("loss"),
    )


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role FROM t JOIN p USING (conv_id)),
d AS (SELECT *, '<|' || CASE WHEN role = 'user' THEN 'user name=' || speaker ELSE role END || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM r),
o AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM d)
SELECT conv_id, perspective, turn, speaker, role, rendered, s AS "start", (s + length(rendered))::BIGINT AS "end",
  CASE WHEN role = 'assistant' THEN (s + 14)::BIGINT END AS loss_start, CASE WHEN role = 'assistant' THEN (s + length(rendered) - 1)::BIGINT END AS loss_end,
  CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS loss
FROM o
"""
