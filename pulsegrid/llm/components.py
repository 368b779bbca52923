"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import written

#: Edges of one node that a task takes at once; nodes of more are dealt over several tasks.
HUB_EDGES = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches.

    Labels move along edges and then jump to their label's label, so rounds grow with the logarithm of the longest
    path. Each round is written; messages to a node are reduced to their least before the shuffle. The edges of a hub are
    salted; a jump looks up each distinct label once, and only labels that change come back.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("least"))
    labels = written(degrees.select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    # at most one hub for each HUB_EDGES edges
    hubs = written(degrees.filter(F.col("n") > HUB_EDGES).select("a", F.ceil(F.col("n") / HUB_EDGES).alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = both.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).alias("salt"))
    while True:
        every = labels.withColumnRenamed("node", "a").join(hubs, "a", "left")
        every = every.select("a", "component", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        sent = dealt.join(every, ["a", "salt"]).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("least"))
        met = written(labels.join(sent, "node", "left").select("node", F.least("component", "least").alias("near"), F.col("component").alias("old")))
        further = met.select(F.col("node").alias("near"), F.col("near").alias("far")).filter("far < near")
        jumps = written(met.select("near").distinct().join(further, "near"))
        stepped = written(met.join(jumps, "near", "left").select("node", F.coalesce("far", "near").alias("component"), "old"))
        labels = stepped.select("node", "component")
        if stepped.filter("component <> old").isEmpty():
            return labels
