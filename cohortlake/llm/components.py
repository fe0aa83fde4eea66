"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_work_table, work_table

MAX_ROUNDS = 60


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) for every node of ``links`` (a bigint, b bigint) and of ``known``, an earlier result for other links.

    Contraction: in each round a node is merged into the smallest of itself and its neighbours (with a jump to that
    one's own choice), links are moved to the merged nodes, and links within one are dropped, so what is left shrinks
    by a factor in each round; with ``known``, only new links between its components are looked at.  A node with very
    many neighbours is the skewed side of an equi-join with a unique key, which adaptive execution splits.
    """
    labels = known
    left = links.select(F.col("a").alias("from_"), F.col("b").alias("to_"))
    if known is not None:
        left = _moved(left, known)
    for _ in range(MAX_ROUNDS):
        both = left.where("from_ != to_")
        both = work_table(both.unionAll(both.select("to_", "from_")).distinct(), "links")
        if not both.limit(1).count():
            return labels if labels is not None else both.select(F.col("from_").alias("node"), F.col("to_").alias("comp"))
        near = work_table(both.groupBy("from_").agg(F.least(F.col("from_"), F.min("to_")).alias("into")), "near")
        jump = near.select(F.col("from_").alias("into"), F.col("into").alias("far"))
        parent = work_table(near.join(jump, "into", "left").select(F.col("from_").alias("node"), F.coalesce("far", "into").alias("comp")), "parent")
        drop_work_table(near)
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            old = labels.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
            fresh = parent.join(labels.select("node"), "node", "left_anti")
            labels = work_table(old.unionByName(fresh), "labels")
        left = _moved(both.where("from_ < to_"), parent)  # by this round's choice: a component's name is not one of its rows
    raise RuntimeError("components did not settle")


def _moved(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between the components of their ends; ends without one stay."""
    x, y = labels.select(F.col("node").alias("from_"), F.col("comp").alias("x")), labels.select(F.col("node").alias("to_"), F.col("comp").alias("y"))
    return links.join(x, "from_", "left").join(y, "to_", "left").select(F.coalesce("x", "from_").alias("from_"), F.coalesce("y", "to_").alias("to_")).where("from_ != to_").distinct()
