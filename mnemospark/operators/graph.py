"""Reachability, ranking and communities over edge tables.

Iterations are joins of the edges with the state of the round before. Every few rounds
the state is written to the shared folder, so plans stay short and a lost executor costs
few rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.vector import cosine
from mnemospark.plans.lineage import cut

#: Rounds between written states.
KEEP = 5


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (src, dst), once each, without self links."""
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def semantic_distance(pairs: DataFrame, edges: DataFrame, vectors: DataFrame, most: int = 10) -> DataFrame:
    """(a, b, distance): 1 - cosine where both have a vector (node, vector), else steps from a to b by ``most``, else 1."""
    side = lambda k: vectors.select(F.col("node").alias(k), F.col("vector").alias(f"v{k}"))
    held = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    steps = reach(edges, pairs.select(F.col("a").alias("node")), most).select(F.col("start").alias("a"), F.col("node").alias("b"), "hops")
    away = F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), 1 - cosine(F.col("va"), F.col("vb"))).otherwise(F.coalesce(F.col("hops") / float(most), F.lit(1.0)))
    return held.join(steps, ["a", "b"], "left").select("a", "b", away.alias("distance"))


def reach(edges: DataFrame, starts: DataFrame, most: int, through: Column | None = None) -> DataFrame:
    """(start, node, hops) of all nodes within ``most`` steps of each start (column node), over edges that ``through`` admits; the start has 0."""
    edges = edges if through is None else edges.where(through)
    front = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0))
    seen = front
    for hop in range(1, most + 1):
        ahead = front.join(edges.select(F.col("src").alias("node"), F.col("dst")), "node").select("start", F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame, most: int = 50) -> DataFrame:
    """(src, dst) of all pairs joined by a path, by doubling paths until none is new."""
    known = cut(edges.select("src", "dst").distinct(), "closure")
    for _ in range(most):
        step = known.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        new = cut(known.unionByName(step).distinct(), "closure")
        if new.count() == known.count():
            return new
        known = new
    return known


def met_by(links: DataFrame, ranks: DataFrame, damping: float) -> DataFrame:
    """Ranks after one round over links (src, dst, n, size)."""
    met = links.join(ranks, F.col("src") == F.col("node"))
    return met.groupBy(F.col("dst").alias("node")).agg((F.lit(1 - damping) / F.first("size") + F.sum(F.col("rank") / F.col("n")) * damping).alias("rank"))


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85, least: float | None = None) -> DataFrame:
    """(node, rank) after ``rounds`` rounds over edges in both directions, or once a round moves ranks by less than ``least`` in all.

    Every node of such a graph passes on all that it has, so ranks sum to 1 in every round
    without being scaled, and a round is one join and one sum by node.
    """
    links = cut(edges.join(edges.groupBy("src").agg(F.count("*").alias("n")), "src").select("src", "dst", "n"), "links")
    ranks = links.select(F.col("src").alias("node")).distinct()
    size = ranks.agg(F.count("*").alias("size"))
    links = links.crossJoin(F.broadcast(size))
    ranks = ranks.crossJoin(F.broadcast(size)).select("node", (F.lit(1.0) / F.col("size")).alias("rank"))
    for i in range(1, rounds + 1):
        ranks = met_by(links, ranks, damping)
        if i % KEEP == 0:
            ranks = cut(ranks, "ranks")
            if least is not None:
                # whether it has settled is asked where ranks are written anyway
                after = met_by(links, ranks, damping)
                moved = after.withColumnRenamed("rank", "next").join(ranks, "node").agg(F.sum(F.abs(F.col("next") - F.col("rank")))).first()[0]
                if moved is None or moved < least:
                    break
    return ranks


def communities(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after rounds of label propagation, all nodes at once: the label most neighbours have, the least of equals."""
    labels = edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for i in range(1, rounds + 1):
        votes = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count("*").alias("n"))
        labels = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
        if i % KEEP == 0:
            labels = cut(labels, "labels")
    return labels


def two_hop(edges: DataFrame, factor: float = 0.8) -> DataFrame:
    """(src, dst, confidence) of friends of friends: the best product of two confidences, times ``factor``."""
    far = edges.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("confidence").alias("c2"))
    paths = edges.join(far, "dst").where("src <> far")
    return paths.groupBy("src", F.col("far").alias("dst")).agg((F.max(F.col("confidence") * F.col("c2")) * factor).alias("confidence"))


def merged(edges: DataFrame, keep: str, gone: str) -> DataFrame:
    """``edges`` with one node's edges moved to another; self links and repeats go, the best confidence stays."""
    name = lambda c: F.when(F.col(c) == gone, keep).otherwise(F.col(c)).alias(c)
    return edges.select(name("src"), name("dst"), "confidence").where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
