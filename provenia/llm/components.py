"""Connected components by the least label, in rounds of joins on tables in the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b); component is the least node of those connected.

    In each round a node takes the least label among its neighbours, then the label of its label, so that chains shorten by half.
    Labels and edges are tables that joins read by exchanges, which adaptive execution splits at hubs; least labels are found
    before the shuffle. Ends when no label changes.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = stage(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "labels")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stage(least.join(jump.hint("merge"), "label").select("node", F.col("further").alias("label"), (F.col("further") != F.col("old")).alias("changed")), "labels")
        unstage(labels, least)
        changed = new.filter("changed").limit(1).count()
        labels = new.drop("changed")
        labels.stage_path = new.stage_path
        if not changed:
            unstage(both)
            out = labels.withColumnRenamed("label", "component")
            out.stage_path = labels.stage_path
            return out
