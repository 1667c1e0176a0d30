"""Pairs of ideas in a band of similarity, arms of a bandit, bridges and gaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.operators.pairwise import matched_in_blocks
from tarnlight.operators.retrieval import cosine, most_similar, norm
from tarnlight.session import cut, small_parts, union_all


def drift_band(drift: Column) -> tuple[Column, Column]:
    """Lower and upper similarity for a drift from 0 (near) to 1 (far)."""
    high = F.round(0.72 - 0.30 * drift, 6)
    return F.round(high - 0.10, 6), high


def partners(pool: DataFrame, anchors: DataFrame, low: float, high: float, each: int = 1, widen: float = 0.05) -> DataFrame:
    """``(anchor, partner, level, tier, sim)``: up to ``each`` partners of each anchor with a similarity in the band.

    An anchor without any in the band looks in a band wider by ``widen`` on both sides (level 1), and stays without if there is none
    either. Partners of another topic come first (tier 1), then of another source, then the rest; within a tier by id. Any
    number of anchors is worked off in blocks.
    """

    def choose(asked, rows, sims):
        level = np.where((sims >= low) & (sims <= high), 0, np.where((sims >= round(low - widen, 6)) & (sims <= round(high + widen, 6)), 1, 2))
        tier = np.where(asked["topic"][:, None] != rows["topic"][None, :], 1, np.where(asked["source"][:, None] != rows["source"][None, :], 2, 3))
        order = np.argsort(rows["id"].astype(np.int64), kind="stable")
        rank = (level * 4 + tier)[:, order]
        first = np.argsort(rank, axis=1, kind="stable")[:, :each]
        a, b = np.repeat(np.arange(len(rank)), first.shape[1]), order[first.ravel()]
        kept = level[a, b] < 2
        return a[kept], b[kept], (level * 4 + tier)[a[kept], b[kept]].astype(np.int32)

    found = matched_in_blocks(anchors, pool, choose, ("topic", "source"))
    found = found.select(F.col("query").alias("anchor"), F.col("id").alias("partner"), F.floor(F.col("level") / 4).cast("int").alias("level"), (F.col("level") % 4).alias("tier"), "sim")
    by = Window.partitionBy("anchor")
    found = found.withColumns({"best": F.min("level").over(by), "r": F.row_number().over(by.orderBy("level", "tier", "partner"))})
    return found.where((F.col("level") == F.col("best")) & (F.col("r") <= each)).drop("best", "r")


def seed_front(pool: DataFrame, query: DataFrame, count: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Seeds by relevance to a question: the front of the order, 15 for each wanted idea and 50 at least."""
    return most_similar(pool, query, max(15 * count, 50), key, vector)


def arm_counts(hypotheses: DataFrame, now: Column, young_days: int = 14) -> DataFrame:
    """Wins and losses of each unordered pair of topics: decided ones win, old new ones lose, young new ones count as neither."""
    new = F.lower("status") == "new"
    old = F.col("created_at") < now - F.expr(f"interval {young_days} days")
    pairs = hypotheses.where("topic_a is not null and topic_b is not null and status is not null")
    counts = pairs.groupBy(F.least("topic_a", "topic_b").alias("topic_a"), F.greatest("topic_a", "topic_b").alias("topic_b"))
    counts = counts.agg(F.count_if(~new).alias("wins"), F.count_if(new & old).alias("losses"))
    return counts.withColumn("score", F.round((F.col("wins") + 1) / (F.col("wins") + F.col("losses") + 2), 9))


def best_arm(arms: DataFrame, topics: DataFrame) -> DataFrame:
    """The arm with the highest score whose two topics are present."""
    have = topics.select(F.col("topic"))
    present = arms.join(have.withColumnRenamed("topic", "topic_a"), "topic_a", "left_semi").join(have.withColumnRenamed("topic", "topic_b"), "topic_b", "left_semi")
    return present.orderBy(F.desc("score"), "topic_a", "topic_b").limit(1)


def bridge_scores(pairs: DataFrame) -> DataFrame:
    """Balance, novelty and score of candidates with ``cos_a, cos_b, nearest`` (similarity to what is known, 0 if none)."""
    balance = 1 - F.abs(F.col("cos_a") - F.col("cos_b"))
    novelty = 1 - F.greatest(F.coalesce("nearest", F.lit(0.0)), F.lit(0.0))
    paraphrase = F.greatest("cos_a", "cos_b") >= 0.92
    return pairs.withColumns({"balance": F.round(balance, 3), "novelty": F.round(novelty, 3), "paraphrase": paraphrase, "score": F.round((balance + novelty) / 2, 3)})


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``(cluster, centroid, n)`` of unit vectors, summed by position so that no cluster is gathered in one place."""
    # the length once a row, in a projection of its own, or it would be computed for each number
    sized = df.select(cluster, vector, norm(F.col(vector)).alias("length")).where("length > 0")
    unit = sized.select(cluster, "length", F.posexplode(vector).alias("i", "x")).select(cluster, "i", (F.col("x").cast("double") / F.col("length")).alias("x"))
    means = unit.groupBy(cluster, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))


def gaps(df: DataFrame, cluster: str, vector: str, n: int) -> DataFrame:
    """The n least similar pairs of clusters; the centroids of one side are broadcast in parts of at most 1000."""
    c = cut(centroids(df, cluster, vector))
    a, b = c.select(F.col(cluster).alias("a"), F.col("centroid").alias("va")), c.select(F.col(cluster).alias("b"), F.col("centroid").alias("vb"))
    pairs = union_all([a.join(part, F.col("a") < F.col("b")) for part in small_parts(b, 1000)]).select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("sim"))
    return pairs.orderBy("sim", "a", "b").limit(n)
