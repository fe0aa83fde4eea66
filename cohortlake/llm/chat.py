"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Chat loggers often store a conversation again after every turn, so one conversation is logged as many prefixes of
itself.  Rolling turn-prefix hashes find them: the hash of the first k turns is the running XOR, over the turns in
order, of a 128-bit hash of (position, role, text), so all prefixes of a conversation take one pass.  A conversation whose
whole hash equals a proper prefix hash of another one is removed by an anti-join; of equal conversations the smallest
conv_id stays.  What remains is maximal and is rendered with a chat template.

Shuffles: turns by conv_id (window); one row of 40 bytes a turn, pre-aggregated to distinct prefixes, and one row a
conversation.  A first turn that a third of all conversations share is one distinct prefix after the partial
aggregation, so it makes no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, work_table

TEMPLATE = {"open": "<|", "close": "|>\n", "end": "<|end|>\n"}


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, k, h1, h2): every turn with its position from 1 and the hashes of the prefix that it ends.

    A turn of a null conv_id is a conversation of its own.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    own = Window.partitionBy("conv_id").orderBy(*_order())
    turns = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    first = {"_cl_1": F.xxhash64(F.lit(1), "k", "role", "text"), "_cl_2": F.xxhash64(F.lit(2), "text", "k", "role")}
    alone = turns.where("conv_id is null").withColumn("k", F.lit(1)).withColumns(first).withColumnsRenamed({"_cl_1": "h1", "_cl_2": "h2"}).drop("turn")
    t = turns.where("conv_id is not null").withColumn("k", F.row_number().over(own))
    t = t.withColumns(first)
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumns({"h1": F.bit_xor("_cl_1").over(upto), "h2": F.bit_xor("_cl_2").over(upto)}).drop("_cl_1", "_cl_2", "turn").unionByName(alone)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged, h1, h2) of the conversations that no other one continues; n_logged: equal ones with it.

    Turns are ordered by turn (null last), then role, then text; a null role is ``unknown``, a null text empty; repeated
    rows are turns of their own.  A turn of a null conv_id is a conversation of its own.  An empty table gives an empty result.
    """
    p = work_table(prefixes(turns).select("conv_id", "k", "h1", "h2"), "prefixes")
    whole = p.where("conv_id is not null").groupBy("conv_id").agg(F.max(F.struct("k", "h1", "h2")).alias("w")).select("conv_id", F.col("w.k").alias("k"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    whole = work_table(whole.unionByName(p.where("conv_id is null")), "whole")
    distinct = whole.groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    # proper prefixes: all but the last of each conversation; equal conversations give equal rows
    proper = p.join(whole.select(F.col("conv_id").alias("_cl_id"), F.col("k").alias("_cl_k")), (F.col("conv_id") == F.col("_cl_id")) & (F.col("k") < F.col("_cl_k")), "left_semi")
    proper = proper.select("k", "h1", "h2").distinct()
    return distinct.join(proper, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_logged", "h1", "h2")


def render(turns: DataFrame, kept: DataFrame, template: dict[str, str] = TEMPLATE) -> DataFrame:
    """One row a kept conversation: conv_id, n_turns, n_logged, rendered.

    Template marks inside a turn's text are broken by a zero-width space after ``<`` so that no text can open a turn.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    safe = F.regexp_replace(text, r"<\|", "<\u200b|")
    one = F.concat(F.lit(template["open"]), role, F.lit(template["close"]), safe, F.lit("\n" + template["end"]))
    own = Window.partitionBy("conv_id").orderBy(*_order())
    ids = kept.withColumnRenamed("conv_id", "_cl_id")
    rows = turns.select("conv_id", "turn", "role", "text").join(ids, F.col("conv_id") == F.col("_cl_id"), "inner")
    rows = rows.select("conv_id", "n_turns", "n_logged", F.row_number().over(own).alias("k"), one.alias("one"))
    out = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_logged").alias("n_logged"), F.array_sort(F.collect_list(F.struct("k", "one"))).alias("parts"))
    out = out.select("conv_id", "n_turns", "n_logged", F.array_join(F.transform("parts", lambda p: p["one"]), "").alias("rendered"))
    # turns without a conversation: each stands for all equal ones
    lone = prefixes(turns.where("conv_id is null")).select(F.col("h1").alias("_cl_1"), F.col("h2").alias("_cl_2"), one.alias("rendered")).dropDuplicates(["_cl_1", "_cl_2"])
    lone = kept.where("conv_id is null").join(lone, (F.col("h1") == F.col("_cl_1")) & (F.col("h2") == F.col("_cl_2")))
    return out.unionByName(lone.select("conv_id", "n_turns", "n_logged", "rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    return render(turns, work_table(maximal_conversations(turns), "maximal"))


def op10_snapshot_collapse(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH ids AS (SELECT conv_id AS shown_id, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE 'id ' || conv_id END AS conv_id, turn, role, text FROM conversations),
t AS (
  SELECT conv_id, shown_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, role ASC NULLS FIRST, text ASC NULLS FIRST) AS k FROM ids),
one AS (SELECT conv_id, shown_id, k, CAST(length(role) AS VARCHAR) || ':' || role || CAST(length(text) AS VARCHAR) || ':' || text AS raw,
  '<|' || role || '|>' || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') || chr(10) || '<|end|>' || chr(10) AS shown FROM t),
p AS (SELECT conv_id, shown_id, k, md5(string_agg(raw, '' ORDER BY k) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS h FROM one),
whole AS (SELECT conv_id, shown_id, k, h FROM (SELECT *, max(k) OVER (PARTITION BY conv_id) AS n FROM p) WHERE k = n),
proper AS (SELECT DISTINCT k, h FROM (SELECT *, max(k) OVER (PARTITION BY conv_id) AS n FROM p) WHERE k < n),
d AS (SELECT k, h, arg_min(conv_id, coalesce(shown_id, 9223372036854775807)) AS conv_id, count(*) AS n_logged FROM whole GROUP BY k, h),
kept AS (SELECT conv_id, k AS n_turns, n_logged FROM d WHERE NOT EXISTS (SELECT 1 FROM proper q WHERE q.k = d.k AND q.h = d.h))
SELECT max(o.shown_id) AS conv_id, CAST(max(n_turns) AS BIGINT) AS n_turns, CAST(max(n_logged) AS BIGINT) AS n_logged, string_agg(shown, '' ORDER BY o.k) AS rendered
FROM one o JOIN kept USING (conv_id) GROUP BY o.conv_id
"""
