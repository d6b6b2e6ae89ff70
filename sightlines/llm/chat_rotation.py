"""Chat formatting by perspective rotation.

Every participant of a dialogue is the assistant once: the dialogue is rendered with that speaker's turns as the
assistant's, system turns as they are and all other turns as those of named users. The mask spans hold the texts the
assistant said, which alone are learnt from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Roles that take no part in a dialogue.
SYSTEM = "system"
#: Name of a speaker whose role is null.
UNNAMED = "unknown"
#: Turns of a part: a longer dialogue is rendered in parts, each a row of bounded size.
PART_TURNS = 256

#: Templates in SQL: before the text of a turn, and after it.
_HEAD = (
    "CASE WHEN role = '{system}' THEN '<|system|>' WHEN role = participant THEN '<|assistant|>'"
    " ELSE concat('<|user name=', role, '|>') END"
)
_HEAD = _HEAD.format(system=SYSTEM)
_TAIL = "<|end|>"


def rotated(turns: DataFrame) -> DataFrame:
    """Per conversation, participant and part: conv_id, participant, part, n_turns, n_masked, rendered, mask.

    ``mask`` lists the spans (start-end in code points of ``rendered``, end excluded, comma-joined) that the participant
    said. Turns are ordered by turn, role, text; part k holds the turns numbered from k * PART_TURNS on; parts without a
    turn of the participant are there too. Null turns come in part 0, before the others; null roles are ``unknown``,
    null texts empty, marks of the template inside texts and roles are broken up, repeated rows are repeated turns. Rows with a null conv_id belong to no dialogue; dialogues of
    system turns alone have no participant. Other columns are ignored.
    """
    said = turns.filter("conv_id IS NOT NULL").select(
        "conv_id",
        F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.expr(f"replace(coalesce(role, '{UNNAMED}'), '|', '_')").alias("role"),
        F.expr("replace(coalesce(text, ''), '<|', '< |')").alias("text"),
        F.expr(f"coalesce(greatest(turn, 0) DIV {PART_TURNS}, 0)").alias("part"),
    )
    speakers = said.filter(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("participant")).distinct()
    seen = said.join(speakers, "conv_id").withColumn("head", F.expr(_HEAD))
    seen = seen.withColumn("segment", F.expr(f"concat(head, text, '{_TAIL}')"))
    within = "OVER (PARTITION BY conv_id, participant, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)"
    placed = seen.withColumns(
        {"seq": F.expr(f"row_number() {within}"), "upto": F.expr(f"sum(length(segment)) {within}")}
    )
    start = "upto - length(segment) + length(head)"
    own = f"if(role = participant, concat({start}, '-', {start} + length(text)), NULL)"
    grouped = placed.groupBy("conv_id", "participant", "part").agg(
        F.count("*").alias("n_turns"),
        F.count(F.expr("if(role = participant, 1, NULL)")).alias("n_masked"),
        F.array_sort(F.collect_list(F.expr(f"struct(seq, segment, {own} AS own)"))).alias("turns"),
    )
    return grouped.select(
        "conv_id", "participant", "part", "n_turns", "n_masked",
        F.expr("array_join(turns.segment, '')").alias("rendered"),
        F.expr("array_join(turns.own, ',')").alias("mask"),
    )


def oracle_sql() -> str:
    """The same over ``conversations`` as DuckDB SQL."""
    within = "OVER (PARTITION BY conv_id, participant, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)"
    return f"""
WITH said AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, replace(coalesce(role, '{UNNAMED}'), '|', '_') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text,
         coalesce(greatest(turn, 0) // {PART_TURNS}, 0) AS part
  FROM conversations WHERE conv_id IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, role AS participant FROM said WHERE role <> '{SYSTEM}'),
seen AS (SELECT *, {_HEAD} AS head FROM said JOIN speakers USING (conv_id)),
placed AS (
  SELECT *, head || text || '{_TAIL}' AS segment, row_number() {within} AS seq,
         sum(length(head || text || '{_TAIL}')) {within} - length(text) - length('{_TAIL}') AS start
  FROM seen)
SELECT conv_id, participant, part, count(*) AS n_turns, count(CASE WHEN role = participant THEN 1 END) AS n_masked,
       string_agg(segment, '' ORDER BY seq) AS rendered,
       coalesce(string_agg(CASE WHEN role = participant THEN start::BIGINT || '-' || (start + length(text))::BIGINT END,
                           ',' ORDER BY seq), '') AS mask
FROM placed GROUP BY conv_id, participant, part"""
