"""Atomic memories: statistics, entities, duplicates, blocks for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.operators.pairwise import nearest
from tarnlight.operators.relational import live


def live_by(memories: DataFrame, column: str, missing: str) -> DataFrame:
    """Number of live memories per value, with a name for null."""
    return live(memories).groupBy(F.coalesce(column, F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def retrieval_totals(memories: DataFrame) -> DataFrame:
    """One row: retrievals over all rows, live rows, and live rows never retrieved."""
    is_live = F.col("superseded_by").isNull()
    return memories.agg(
        F.sum("retrieval_count").cast("long").alias("total_retrievals"), F.count_if(is_live).alias("live"), F.count_if(is_live & (F.col("retrieval_count") == 0)).alias("never_retrieved")
    )


def stale(memories: DataFrame, now: Column, weeks: int) -> DataFrame:
    """Live, never retrieved, and not updated for so many weeks."""
    return live(memories).where((F.col("retrieval_count") == 0) & (F.col("updated_at") < now - F.expr(f"interval {weeks * 7} days")))


def entity_counts(entities: DataFrame, memories: DataFrame) -> DataFrame:
    """Live memories per entity."""
    return entities.join(live(memories).select(F.col("id").alias("memory_id")), "memory_id").groupBy("entity").agg(F.count("*").alias("n"))


def entity_category(entities: DataFrame, memories: DataFrame) -> DataFrame:
    """The most frequent category of each entity's live memories; ties go to the first by name."""
    own = live(memories).select(F.col("id").alias("memory_id"), F.lower(F.coalesce("category", F.lit("(none)"))).alias("category"))
    counts = entities.join(own, "memory_id").groupBy("entity", "category").agg(F.count("*").alias("n"))
    by = Window.partitionBy("entity").orderBy(F.desc("n"), "category")
    return counts.withColumn("r", F.row_number().over(by)).where("r = 1").select("entity", "category", "n")


def entity_pairs(entities: DataFrame, memories: DataFrame, least: int) -> DataFrame:
    """Entities mentioned together in at least ``least`` live memories; pairs meet within a memory, which mentions few."""
    own = entities.join(live(memories).select(F.col("id").alias("memory_id")), "memory_id")
    other = own.select("memory_id", F.col("entity").alias("entity_b"))
    pairs = own.withColumnRenamed("entity", "entity_a").join(other, "memory_id").where("entity_a < entity_b")
    return pairs.groupBy("entity_a", "entity_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def entity_graph(entities: DataFrame, memories: DataFrame, nodes: int = 60, least: int = 1) -> DataFrame:
    """Edges between the most frequent entities."""
    top = entity_counts(entities, memories).orderBy(F.desc("n"), "entity").limit(nodes).select("entity")
    edges = entity_pairs(entities.join(top, "entity", "left_semi"), memories, least)
    return edges


def write_decision(store: DataFrame, new: DataFrame, duplicate: float = 0.95, supersede: float = 0.8) -> DataFrame:
    """``(id, decision, target, sim)`` of new rows against the store, by the single nearest row.

    The nearest row decides even if it is no longer live: then the new row is inserted. Any number of new rows is worked off in blocks.
    """
    best = nearest(new.select("id", "vector"), store.select("id", "vector")).select(F.col("query").alias("new_id"), "id", "sim")
    best = best.join(store.select("id", F.col("superseded_by").isNull().alias("is_live")), "id").select("new_id", F.struct("id", "is_live", "sim").alias("b"))
    kind = F.when(F.col("b.is_live") & (F.col("b.sim") >= duplicate), "duplicate").when(F.col("b.is_live") & (F.col("b.sim") >= supersede), "supersede").otherwise("insert")
    joined = new.select(F.col("id").alias("new_id")).join(best, "new_id", "left")
    target = F.when(kind != "insert", F.col("b.id"))
    return joined.select(F.col("new_id").alias("id"), F.coalesce(kind, F.lit("insert")).alias("decision"), target.alias("target"))


def prefix_and_tail(memories: DataFrame, project: str, head: int = 8, tail: int = 4) -> DataFrame:
    """The oldest rows of a project's live memories, which stay the same between prompts, and the newest of the rest."""
    own = live(memories).where((F.col("project") == project) | F.col("project").isNull())
    first = own.orderBy(F.col("project").isNull(), "id").limit(head)
    rest = own.join(F.broadcast(first.select("id")), "id", "left_anti").orderBy(F.desc("id")).limit(tail)
    return first.select("id", F.lit("prefix").alias("part")).union(rest.select("id", F.lit("tail").alias("part")))


def within_budget(lines: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Lines of each group up to the first that would exceed the budget of characters.

    A line costs at least 1, so no more than ``budget`` lines of a group are ever needed; the rest is dropped before the shuffle.
    """
    by = Window.partitionBy(group).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    first = lines.withColumn("r", F.row_number().over(by)).where(F.col("r") <= budget + 1).drop("r")
    used = first.withColumn("used", F.sum(F.length(text) + 1).over(upto))
    return used.withColumn("over", F.max((F.col("used") > budget).cast("int")).over(upto)).where("over = 0").drop("over")
