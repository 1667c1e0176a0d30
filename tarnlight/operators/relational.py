"""Filters, joins, versions and upserts of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.session import cut


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row per key of a table in which rows may be written twice with equal columns."""
    return df.dropDuplicates(list(key))


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every argument that is not None; no argument keeps all rows."""
    tests = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def live(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("superseded_by").isNull())


def in_scope(df: DataFrame, project: str) -> DataFrame:
    """Rows of a project and rows of none."""
    return df.where((F.col("project") == project) | F.col("project").isNull())


def in_order(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows whose key is wanted, with ``pos``, their place in the caller's list; the list is the caller's own."""
    places = df.sparkSession.createDataFrame([(v, n) for n, v in enumerate(wanted, 1)], f"{key} {df.schema[key].dataType.simpleString()}, pos int")
    return df.join(F.broadcast(places), key)


def containing(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in which any column has the text, in any case; % and _ in it are wildcards."""
    return df.where(reduce(Column.__or__, [F.col(c).ilike(f"%{needle}%") for c in columns]))


def with_context(chunks: DataFrame, sources: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with the title of their source and, where there is one, their vector."""
    titles = sources.select(F.col("id").alias("source_id"), "title")
    vectors = embeddings.select(F.col("chunk_id").alias("id"), "embedding")
    return chunks.join(titles, "source_id").join(vectors, "id", "left")


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def latest_version(versions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The current rows of an append-only table of versions."""
    return first_per_group(versions, [key], order)


def upsert_keep(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer upsert: each column of the new row, or where it is null that of the old one."""
    columns = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])


def without(df: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Rows that do not refer to a deleted key."""
    return df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def unordered(a: Column, b: Column, low: str = "first", high: str = "second") -> list[Column]:
    """A pair in a fixed order."""
    return [F.least(a, b).alias(low), F.greatest(a, b).alias(high)]


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows with running totals within their group, however many rows one group holds; ``sums`` names them.

    Rows are sorted by range over group and order, summed within each part, and moved on by the sums of the group's
    earlier parts; what meets in one task per group is one row per part.
    """
    spread = cut(df.withColumns({f"_of_{name}": value for name, value in sums.items()}).repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    parts = spread.groupBy(group, "_part").agg(*[F.sum(f"_of_{name}").alias(f"_sum_{name}") for name in sums])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_own"), *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums])
    upto = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = spread.join(offsets, F.col("_part").eqNullSafe(F.col("_own")) & F.col(group).eqNullSafe(F.col("_group")))
    totals = {name: F.sum(f"_of_{name}").over(upto) + F.col(f"_before_{name}") for name in sums}
    return joined.withColumns(totals).select(*df.columns, *sums)


def numbered(df: DataFrame, group: str, order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 within their group, however many rows one group holds."""
    return running(df, group, order, {name: F.lit(1)})
