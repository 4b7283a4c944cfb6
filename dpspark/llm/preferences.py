"""Preference pairs as chat segments: one prompt, two masked completions.

The prompt is the longest run of leading turns that the chosen and the rejected
conversation share. It is found by aggregation over turns, so neither
conversation is ever gathered in one place, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written; the mark's opening is taken apart where a text has it.
OPEN, CLOSE, END, APART = "<|", "|>\n", "<|end|>\n", "< |"
TRAINED = "assistant"


def _turns(side: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return side.select(F.col("pair_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), text("role").alias("role"), text("text").alias("text")).where("pair_id IS NOT NULL")


def first_differences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, cut): the first turn at which the two sides differ; no row where they never do."""
    # the sum of hashes tells sets of rows at one turn apart whatever their order
    own = F.xxhash64("role", "text").cast("decimal(38,0)")
    sides = _turns(chosen).select("pair_id", "turn", own.alias("c"), F.lit(0).cast("decimal(38,0)").alias("r"), F.lit(1).alias("n"))
    sides = sides.unionByName(_turns(rejected).select("pair_id", "turn", F.lit(0).cast("decimal(38,0)").alias("c"), own.alias("r"), F.lit(-1).alias("n")))
    turns = sides.groupBy("pair_id", "turn").agg(F.sum("c").alias("c"), F.sum("r").alias("r"), F.sum("n").alias("n"))
    return turns.where("c <> r OR n <> 0").groupBy("pair_id").agg(F.min("turn").alias("cut"))


def segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Segments of preference pairs, given as turns (pair_id, turn, role, text) of either side.

    One row per turn: pair_id, part (prompt, chosen or rejected), turn, role,
    header, body, trained. Header and body, in order of turn, make up a part's
    text; only what is trained counts in the loss: bodies of the assistant in
    the two completions.

    A null role or text is empty, a null turn comes first (-1), a null pair_id
    is left out. Rows of one turn are compared as a multiset. A pair that one
    side lacks has an empty prompt and one completion; equal conversations are
    prompt only. Other columns are ignored; empty tables give no row.
    """
    cut = first_differences(chosen, rejected)

    def part(side: DataFrame, name: str) -> DataFrame:
        rows = _turns(side).join(cut, "pair_id", "left")
        shared = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
        rows = rows.withColumn("part", F.when(shared, F.lit("prompt")).otherwise(F.lit(name)))
        return rows if name == "chosen" else rows.where("part <> 'prompt'")

    apart = lambda c: F.replace(c, F.lit(OPEN), F.lit(APART))
    header: Column = F.concat(F.lit(OPEN), apart(F.col("role")), F.lit(CLOSE))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED)
    both = part(chosen, "chosen").unionByName(part(rejected, "rejected"))
    return both.select("pair_id", "part", "turn", "role", header.alias("header"), F.concat(apart(F.col("text")), F.lit(END)).alias("body"), trained.alias("trained"))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs for a table (conv_id, turn, role, text) without preferences of its own.

    Each conversation is chosen; rejected is the same one with its last turn
    taken from its neighbour, whose id differs in the lowest bit (without a
    neighbour: left out).
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    last = turns.groupBy("pair_id").agg(F.max("turn").alias("last"))
    rows = turns.join(last, "pair_id")
    final = rows.where("turn = last").select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), "role", "text")
    other = final.join(last, "pair_id").select("pair_id", F.col("last").alias("turn"), "role", "text")
    return turns, rows.where("turn < last").select("pair_id", "turn", "role", "text").unionByName(other)


SQL = """
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
chosen AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
rejected AS (
  SELECT c.conv_id AS pair_id, c.turn, coalesce(c.role, '') AS role, coalesce(c.text, '') AS text
  FROM conversations c JOIN last l ON l.conv_id = c.conv_id WHERE c.turn < l.last
  UNION ALL
  SELECT own.conv_id, own.last, coalesce(c.role, ''), coalesce(c.text, '')
  FROM conversations c JOIN last l ON l.conv_id = c.conv_id AND c.turn = l.last
  JOIN last own ON own.conv_id = xor(c.conv_id, 1)),
turns AS (
  SELECT pair_id, turn, list_sort(list({'role': role, 'text': text})) AS said, 'c' AS side FROM chosen GROUP BY pair_id, turn
  UNION ALL
  SELECT pair_id, turn, list_sort(list({'role': role, 'text': text})), 'r' FROM rejected GROUP BY pair_id, turn),
cut AS (
  SELECT pair_id, min(turn) AS cut FROM (
    SELECT pair_id, turn FROM turns GROUP BY pair_id, turn
    HAVING count(*) < 2 OR min(said) <> max(said)) GROUP BY pair_id),
parts AS (
  SELECT s.*, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE 'chosen' END AS part FROM chosen s LEFT JOIN cut USING (pair_id)
  UNION ALL
  SELECT s.*, 'rejected' FROM rejected s JOIN cut USING (pair_id) WHERE turn >= cut)
SELECT pair_id, part, turn, role, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS header,
  replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body, part <> 'prompt' AND role = 'assistant' AS trained
FROM parts
"""
