"""Chat formatting with multi-party perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that speaker
as the assistant and all others as named users; the loss mask covers what the
assistant says.  Turns are gathered and rendered in parts of a bounded number of turn
numbers; a dialogue is the parts' texts one after the other, and running offsets carry
their masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Turn numbers in a part, and the roles that set the scene instead of taking part.
PART_TURNS, SCENE = 1024, ("system",)


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS, scene: tuple[str, ...] = SCENE) -> DataFrame:
    """Renders conversations (conv_id, turn, role, text): a row for each conversation and participant, with the whole dialogue.

    A turn reads ``<|system|>`` / ``<|assistant|>`` / ``<|user:NAME|>``, a line feed, the text
    and ``<|end|>`` with a line feed.  Turns follow by (turn, role, text), those without a number
    first; repeated rows are rendered as often as they occur.  A null role is the speaker
    ``unknown``, a null text is empty, null conv_ids are one conversation; a conversation without
    participants (scene only) gives no row, an empty table none.  Returns conv_id, perspective, n_turns, n_own
    (turns of the perspective), n_chars, loss_chars (characters under the mask), text, mask: ``from-to`` code point
    offsets of the masked spans (end exclusive), joined by commas; a span covers a turn's text and its end mark.
    Other columns are ignored.  A dialogue is one value, so it must fit into one (2 GB).
    """
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.floor(F.col("turn") / part_turns).cast("long").alias("part"),
    )
    # A conversation without end is gathered by many tasks before one of them puts its parts together.
    parts = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "turns"))).alias("parts"))
    people = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.filter(F.transform(p["turns"], lambda t: t["role"]), lambda r: ~r.isin(*scene)))))
    both = whole.select("conv_id", "parts", F.explode_outer(people).alias("perspective")).where("perspective IS NOT NULL")

    def rendered(t: Column) -> Column:
        own = t["role"] == F.col("perspective")
        head = F.when(own, F.lit("<|assistant|>\n")).when(t["role"].isin(*scene), F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user:"), t["role"], F.lit("|>\n")))
        return F.struct(own.alias("own"), F.length(head).cast("long").alias("head"), (F.length(t["text"]) + len("<|end|>")).cast("long").alias("body"), F.concat(head, t["text"], F.lit("<|end|>\n")).alias("text"))

    def laid(turns: Column) -> Column:
        """A part's length and the spans of the perspective's own turns in it."""
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,z:bigint>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            begin = acc["at"] + t["head"]
            span = F.struct(begin.alias("a"), (begin + t["body"]).alias("z"))
            return F.struct((begin + t["body"] + 1).alias("at"), F.when(t["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(turns, zero, step)

    shown = both.withColumn("r", F.transform("parts", lambda p: F.transform(p["turns"], rendered))).drop("parts")
    shown = shown.withColumn("m", F.transform("r", laid))
    # Where each part begins.
    ends = F.aggregate(F.transform("m", lambda p: p["at"]), F.array(F.lit(0).cast("long")), lambda acc, size: F.concat(acc, F.array(F.element_at(acc, -1) + size)))
    shown = shown.withColumn("ends", ends)
    spans = F.flatten(F.transform("m", lambda p, i: F.transform(p["spans"], lambda s: F.struct((F.col("ends")[i] + s["a"]).alias("a"), (F.col("ends")[i] + s["z"]).alias("z")))))
    shown = shown.withColumn("spans", spans)
    return shown.select(
        "conv_id",
        "perspective",
        F.aggregate("r", F.lit(0).cast("long"), lambda n, p: n + F.size(p)).alias("n_turns"),
        F.size("spans").cast("long").alias("n_own"),
        F.element_at("ends", -1).alias("n_chars"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["z"] - s["a"]).alias("loss_chars"),
        F.array_join(F.transform("r", lambda p: F.array_join(F.transform(p, lambda t: t["text"]), "")), "").alias("text"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["a"].cast("string"), s["z"].cast("string"))), ",").alias("mask"),
    )


def op10_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
shown AS (
  SELECT s.*, perspective, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head,
         text || '<|end|>' AS body
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(len(head) + len(body) + 1) OVER w - len(body) - 1 AS a, row_number() OVER w AS n
  FROM shown WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       sum(len(head) + len(body) + 1)::BIGINT AS n_chars, coalesce(sum(len(body)) FILTER (own), 0)::BIGINT AS loss_chars,
       string_agg(head || body || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(a::BIGINT::VARCHAR || '-' || (a + len(body))::BIGINT::VARCHAR, ',' ORDER BY n) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective
"""
