"""Roll-ups of the usage ledger, of transcripts and of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens_of(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")


def block_changes(blocks: DataFrame, group: str, block: str) -> DataFrame:
    """Per group the times its block changed: distinct blocks less one, not below zero."""
    return blocks.groupBy(group).agg(F.greatest(F.count_distinct(block) - 1, F.lit(0)).alias("changes"))


def usage(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Lines that count: of equal keys the last one; lines without a key all count."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    keyed = lines.where(F.col(key).isNotNull()).withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")
    return keyed.unionByName(lines.where(F.col(key).isNull()))


def due(decisions: DataFrame, today: Column) -> DataFrame:
    """Open decisions whose day of review has come."""
    return decisions.where((F.col("status") == "open") & (F.col("review_by") <= today))


def decision_errors(row: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows with ``errors``, the names of the fields that are invalid; an empty list is a valid decision."""
    checks = {
        "situation": F.coalesce(F.trim("situation") == "", F.lit(True)),
        "game": ~F.coalesce(F.col("game").isin(kinds), F.lit(False)),
        "prediction": F.coalesce(F.trim("prediction") == "", F.lit(True)),
        "falsifier": F.coalesce(F.trim("falsifier") == "", F.lit(True)),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 100), F.lit(False)),
        "review_by": F.to_date("review_by").isNull(),
    }
    return row.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])))


def plan_rows(plans: DataFrame, today: Column) -> DataFrame:
    """The valid actions of each plan as experiments that share its id, with a day of review."""
    rows = plans.select("plan_id", "domain", F.posexplode(checked_actions("actions")).alias("n", "a"))
    return rows.select("plan_id", "domain", "n", F.col("a.action").alias("title"), "a.horizon", F.date_add(today, F.col("a.days")).alias("review_date"))


HORIZONS = ["today", "this_week", "this_month", "this_quarter"]


def checked_actions(actions: str | Column, most: int = 5, latest: int = 90) -> Column:
    """The valid actions of a plan, in order and at most ``most``: with a text and a known horizon (``this_week`` if none is given).

    Days until the review are kept between 1 and ``latest``; none given means 7. A plan without actions is valid and has none.
    """
    good = F.filter(actions, lambda a: F.coalesce(F.trim(a["action"]) != "", F.lit(False)) & F.coalesce(a["horizon"], F.lit("this_week")).isin(HORIZONS))
    clean = F.transform(good, lambda a: F.struct(F.trim(a["action"]).alias("action"), F.coalesce(a["horizon"], F.lit("this_week")).alias("horizon"), F.greatest(F.lit(1), F.least(F.lit(latest), F.coalesce(a["due_offset_days"], F.lit(7)))).alias("days")))
    return F.slice(clean, 1, most)


def score_once(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """``(id, outcome, refused)``: the first score of an open decision stands, every other one is refused.

    ``decisions`` has ``id, outcome`` (null while open), ``scores`` has ``id, at, outcome``; scores of unknown decisions are ignored.
    """
    tried = scores.where("outcome is not null").groupBy("id").agg(F.min_by("outcome", F.struct("at", "outcome")).alias("first"), F.count("*").alias("n"))
    joined = decisions.select("id", "outcome").join(tried, "id", "left")
    accepted = F.col("outcome").isNull() & F.col("first").isNotNull()
    return joined.select("id", F.coalesce("outcome", "first").alias("outcome"), (F.coalesce("n", F.lit(0)) - accepted.cast("int")).cast("long").alias("refused"))


def atom_errors(rules: DataFrame, kinds: list[str], maps: DataFrame) -> DataFrame:
    """Rules with ``errors``: required fields that are missing, a kind that is not listed, a map that is not known.

    ``rules`` has ``id, statement, decision_rule, kind, map``, ``maps`` a column ``map``.
    """
    known = maps.select("map").where("map is not null").distinct().withColumn("known", F.lit(True))
    joined = rules.join(known, "map", "left")
    checks = {
        "statement": F.coalesce(F.trim("statement") == "", F.lit(True)), "decision_rule": F.coalesce(F.trim("decision_rule") == "", F.lit(True)),
        "kind": ~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "map": F.col("known").isNull(),
    }
    return joined.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))).drop("known")
