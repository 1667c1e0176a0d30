"""Concepts from phrases: class TF-IDF, links, degrees, communities, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.operators.retrieval import cosine
from tarnlight.session import cut


def phrase_counts(df: DataFrame, cluster: str, key: str, text: str, longest: int = 2) -> DataFrame:
    """``(cluster, phrase, tf)``: rows of each cluster that have the phrase."""
    own = df.where(F.col(text).isNotNull()).select(cluster, key, T.phrase_words(F.col(text)).alias("own"))
    return own.select(cluster, key, F.explode(T.phrases(F.col("own"), longest)).alias("phrase")).groupBy(cluster, "phrase").agg(F.count("*").alias("tf"))


def class_tfidf(counts: DataFrame, cluster: str, least: int = 3) -> DataFrame:
    """``(cluster, phrase, score)`` over the phrases that occur at least ``least`` times."""
    total = counts.groupBy("phrase").agg(F.sum("tf").alias("f")).where(F.col("f") >= least)
    kept = counts.join(total, "phrase")
    size = kept.groupBy(cluster).agg(F.sum("tf").alias("size"))
    clusters = kept.agg(F.count_distinct(cluster).alias("clusters"))
    scored = kept.join(size, cluster).crossJoin(F.broadcast(clusters))
    return scored.select(cluster, "phrase", F.round(F.col("tf") / F.col("size") * F.log(1 + F.col("clusters") / F.greatest("f", F.lit(1))), 9).alias("score"))


# Weights of phrases of one, two and three words, the ceiling of their share of rows, and the share of capitals of a proper noun.
LENGTH_WEIGHTS, MOST_COMMON, CAPITALS = (1.0, 2.4, 1.8), 0.6, 0.6


def proper_words(df: DataFrame, text: str, share: float = CAPITALS) -> DataFrame:
    """``(word)`` in lower case, of those that mostly begin with a capital where they do not open a sentence."""
    sentences = df.where(F.col(text).isNotNull()).select(F.explode(F.split(text, r"(?<=[.!?])\s+|\n+")).alias("s"))
    inner = sentences.select(T.words(T.plain_quotes(F.col("s"))).alias("w")).where(F.size("w") > 1).select(F.explode(F.slice("w", 2, F.size("w"))).alias("w"))
    counted = inner.groupBy(F.lower("w").alias("word")).agg(F.avg(F.col("w").rlike(r"^\p{Lu}").cast("int")).alias("share"))
    return counted.where(F.col("share") >= share).select("word")


def concepts(df: DataFrame, cluster: str, key: str, text: str, each: int = 5, most: int = 36, front: int = 200) -> DataFrame:
    """``(cluster, phrase, score, place)``: the phrases that tell each cluster from the others, the best first.

    Phrases of one to three words, in as many rows as the floor (3, or one row in 2000) and in no more than ``MOST_COMMON`` of all rows if
    there are several clusters, that do not begin with a proper noun. Of phrases within one another a cluster keeps the better
    one (looked for among its ``front`` best); a phrase that several clusters have stays where it scores best; at most ``most``
    in all and ``each`` a cluster remain. Null texts and clusters are ignored; no rows give none.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(cluster).isNotNull())
    n = rows.count()
    counts = cut(phrase_counts(rows, cluster, key, text, 3))
    size = counts.groupBy(cluster).agg(F.sum("tf").alias("size"))
    clusters = size.count()
    total = counts.groupBy("phrase").agg(F.sum("tf").alias("df"), F.count("*").alias("held"))
    total = total.where(F.col("df") >= max(3, n // 2000))
    if clusters > 1:
        total = total.where(F.col("df") <= max(3, MOST_COMMON * n))
    total = total.withColumn("word", F.split_part("phrase", F.lit(" "), F.lit(1))).join(proper_words(rows, text), "word", "left_anti").drop("word")
    kept = counts.join(total, "phrase")
    size = kept.groupBy(cluster).agg(F.sum("tf").alias("size"))
    words = F.size(F.split("phrase", " "))
    weight = F.element_at(F.array(*[F.lit(w) for w in LENGTH_WEIGHTS]), words)
    scored = kept.join(size, cluster).select(cluster, "phrase", F.round(F.col("tf") / F.col("size") * F.log(1 + F.lit(clusters) / F.col("held")) * weight, 9).alias("score"))
    by = Window.partitionBy(cluster).orderBy(F.desc("score"), "phrase")
    best = scored.withColumn("r", F.row_number().over(by)).where(F.col("r") <= front)
    ordered = F.array_sort(F.collect_list(F.struct("r", "phrase", "score")))
    alone = lambda acc, x: ~F.exists(acc, lambda y: F.contains(y["phrase"], x["phrase"]) | F.contains(x["phrase"], y["phrase"]))
    start = F.array().cast("array<struct<r:int,phrase:string,score:double>>")
    picked = best.groupBy(cluster).agg(ordered.alias("o")).select(cluster, F.explode(F.aggregate("o", start, lambda acc, x: F.when((F.size(acc) < 2 * each) & alone(acc, x), F.array_append(acc, x)).otherwise(acc))).alias("x"))
    once = best_cluster(picked.select(cluster, "x.phrase", "x.score"), cluster)
    top = once.orderBy(F.desc("score"), "phrase").limit(most)
    return top.withColumn("place", F.row_number().over(by)).where(F.col("place") <= each)


def concept_links(found: DataFrame, df: DataFrame, themes: DataFrame, cluster: str, key: str, text: str, near: float = 0.64) -> DataFrame:
    """``(source, target, relationship, strength)`` between the concepts of ``concepts``; ``themes`` has a row ``(cluster, centroid)`` per cluster.

    Each concept belongs to its cluster's first one (strength: share of its score); concepts of the same rows co-occur (their
    number, from three on, the 1.5 strongest per concept and 40 at most); first concepts of clusters with a cosine of ``near`` are related. There are at most three
    links per concept, the weakest co-occurrences being dropped.
    """
    found = cut(found)
    n = found.count()
    anchor = found.where("place = 1").select(cluster, F.col("phrase").alias("anchor"), F.col("score").alias("top"))
    part = found.where("place > 1").join(anchor, cluster).select(F.col("phrase").alias("source"), F.col("anchor").alias("target"), F.lit("part of theme").alias("relationship"), F.round(F.least(F.lit(1.0), F.col("score") / F.col("top")), 2).alias("strength"))
    own = df.where(F.col(text).isNotNull()).select(key, T.phrase_words(F.col(text)).alias("own"))
    seen = own.select(key, F.explode(T.phrases(F.col("own"), 3)).alias("source")).join(F.broadcast(found.select(F.col("phrase").alias("source"))), "source", "left_semi")
    pairs = seen.join(seen.withColumnRenamed("source", "target"), key).where("source < target").groupBy("source", "target").agg(F.count("*").cast("double").alias("strength")).where("strength >= 3")
    pairs = pairs.orderBy(F.desc("strength"), "source", "target").limit(int(min(1.5 * max(1, n), 40)))
    sides = [anchor.join(themes, cluster).select(F.col("anchor").alias(name), F.col("centroid").alias(f"v_{name}")) for name in ("source", "target")]
    related = sides[0].join(sides[1], F.col("source") < F.col("target")).withColumn("strength", F.round(cosine(F.col("v_source"), F.col("v_target")), 2)).where(F.col("strength") >= near)
    firm = cut(part.union(related.select("source", "target", F.lit("related theme"), "strength")))
    room = max(0, 3 * max(1, n) - firm.count())
    return firm.union(pairs.orderBy(F.desc("strength"), "source", "target").limit(room).select("source", "target", F.lit("co-occurs with"), "strength"))


def best_cluster(scores: DataFrame, cluster: str) -> DataFrame:
    """Each phrase in the cluster where it scores best."""
    by = Window.partitionBy("phrase").orderBy(F.desc("score"), cluster)
    return scores.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def communities(edges: DataFrame, a: str, b: str, sweeps: int = 14) -> DataFrame:
    """``(node, label)`` by synchronous label propagation; ties go to the smaller label.

    All nodes change at once, so results may differ from a sequential sweep. Every sweep is a join and a grouping.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    for _ in range(sweeps):
        votes = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        by = Window.partitionBy("u").orderBy(F.desc("n"), "label")
        new = cut(votes.withColumn("r", F.row_number().over(by)).where("r = 1").select(F.col("u").alias("node"), "label"))
        same = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        labels = new
        if same:
            break
    return labels


def spherical_clusters(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """``(key, cluster)`` by k-means on directions; with no more rows than clusters every row is its own."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if rows.count() <= k:
        return rows.select(key, F.dense_rank().over(Window.orderBy(key)).cast("int").alias("cluster"))
    model = KMeans(k=k, distanceMeasure="cosine", maxIter=20, seed=seed).fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster"))
