"""Operator 7, chat formatting by rotating the perspective among all who take part.

Every speaker of a conversation (a role other than "system") is made the assistant once: their turns become assistant
turns, which are learnt from; all others are users with their names; system turns stay. The rendering is one text, and
the mask lists the stretches of it that are learnt from, in characters: contents of assistant turns and the end marks
behind them, "start-end" from 0, end excluded, joined with commas.

Cases: turns are ordered by turn (null first), then role, then text. A null role is the speaker "unknown"; a null text
is an empty one, whose end mark is still learnt from. Marks that occur in a text are broken up by a blank, and names
keep letters, digits, "_" and "-" only. A conversation of system turns alone has no speaker and gives no row. A row
with a null conv_id is a conversation of its own. Repeated rows are repeated turns. An empty table gives an empty one. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|start|>", "<|end|>"


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, n_learnt, rendered and mask: a row for each speaker of each conversation."""
    d = common.project(conversations, ["conv_id", "turn", "role", "text"])
    name = F.regexp_replace(F.coalesce("role", F.lit("unknown")), r"[^\p{L}\p{N}_-]", "_")
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|", "< |")
    d = d.withColumn("own", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    turns = d.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), safe.alias("text"), F.when(name == "", "unknown").otherwise(name).alias("name")))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.transform(F.filter("turns", lambda t: t["name"] != "system"), lambda t: t["name"])))
    each = turns.select("conv_id", "turns", F.explode(speakers).alias("perspective"))

    def head(t: Column) -> Column:
        return F.concat(F.lit(OPEN), F.when(t["name"] == "system", "system").when(t["name"] == F.col("perspective"), "assistant").otherwise(F.concat(F.lit("user name="), t["name"])), F.lit("\n"))

    def whole(t: Column) -> Column:
        return F.concat(head(t), t["text"], F.lit(f"{CLOSE}\n"))

    def stretch(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(head(t))
        end = start + F.length(t["text"]) + len(CLOSE)
        own = t["name"] == F.col("perspective")
        return F.struct((end + 1).cast("bigint").alias("at"), F.when(own, F.concat(acc["out"], F.array(F.concat_ws("-", start.cast("string"), end.cast("string"))))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    return each.select(
        "conv_id", "perspective", F.size("turns").cast("bigint").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["name"] == F.col("perspective"))).cast("bigint").alias("n_learnt"),
        F.array_join(F.transform("turns", whole), "").alias("rendered"),
        F.array_join(F.aggregate("turns", zero, stretch)["out"], ",").alias("mask"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(common.table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS r, replace(coalesce(text, ''), '<|', '< |') AS text,
         CASE WHEN role = '' THEN 'unknown' ELSE regexp_replace(coalesce(role, 'unknown'), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') END AS name
  FROM conversations),
p AS (SELECT DISTINCT conv_id, own, name AS perspective FROM t WHERE name <> 'system'),
j AS (
  SELECT t.*, p.perspective,
         '{OPEN}' || CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.own IS NOT DISTINCT FROM p.own),
k AS (
  SELECT *, sum(length(head) + length(text) + {len(CLOSE) + 1}) OVER (PARTITION BY conv_id, own, perspective ORDER BY turn NULLS FIRST, r, text, name
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM j)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE name = perspective) AS n_learnt,
       string_agg(head || text || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, r, text, name) AS rendered,
       coalesce(string_agg((upto - length(text) - {len(CLOSE) + 1})::BIGINT || '-' || (upto - 1)::BIGINT, ',' ORDER BY upto) FILTER (WHERE name = perspective), '') AS mask
FROM k GROUP BY conv_id, own, perspective
"""
