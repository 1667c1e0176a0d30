"""Keyword, vector and fused retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.session import cut

K1, B, LEAST_IDF, RRF = 1.2, 0.75, 1e-6, 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is null or has length 0, or the widths differ."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def most_similar(df: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, sim)`` of the k vectors nearest to the one query vector, which is a single broadcast row."""
    q = query.select(F.col(vector).alias("_q")).limit(1)
    sims = df.crossJoin(F.broadcast(q)).select(key, F.round(cosine(F.col(vector), F.col("_q")), 9).alias("sim"))
    return sims.where("sim is not null").orderBy(F.desc("sim"), key).limit(k)


def _times(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(term)))


def bm25(df: DataFrame, terms: list[str], key: str, text: str, every: bool = True) -> DataFrame:
    """``(key, score)`` of the rows with all (or any) of the terms.

    One pass builds per row its length and the counts of the few asked terms; only these narrow rows are kept, and both the
    corpus statistics, which are one aggregate row, and the scores are taken from them.
    """
    counted = df.select(key, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    counted = cut(counted.select(key, F.size("_t").alias("dl"), *[_times("_t", t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    parts = []
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"tf{i}")
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    present = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    hit = reduce(Column.__and__ if every else Column.__or__, present)
    return counted.where(hit).crossJoin(F.broadcast(stats)).select(key, F.round(reduce(Column.__add__, parts), 12).alias("score"))


def ranked(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The best k with ``rank`` from 1; the window runs over these k rows only."""
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(lists: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """``(key, score)``: reciprocal ranks of all lists, each with its weight, summed."""
    parts = [df.select(key, (F.lit(float(w)) / (F.lit(RRF) + F.col("rank"))).alias("part"), F.lit(n).alias("list"), "rank") for n, (df, w) in enumerate(lists)]
    both = reduce(DataFrame.unionByName, parts)
    first = F.min(F.when(F.col("list") == 0, F.col("rank")))
    return both.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"), first.alias("first_rank"))


def hybrid_search(documents: DataFrame, vectors: DataFrame, query: DataFrame, terms: list[str], k: int = 10, pool: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best of keyword and vector search together; ties go to the better vector rank, then the smaller key."""
    semantic = ranked(most_similar(vectors, query, pool, key, "embedding"), key, "sim", pool)
    keyword = ranked(bm25(documents, terms, key, text), key, "score", pool)
    fused = fuse([(semantic, 1.0), (keyword, 1.0)], key)
    best = fused.orderBy(F.desc("score"), F.asc_nulls_last("first_rank"), key).limit(k)
    return documents.join(F.broadcast(best), key)


def gated(hits: DataFrame, least: float, column: str = "sim") -> DataFrame:
    return hits.where(F.col(column) >= least)
