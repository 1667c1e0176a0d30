import math

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.operators import brainstorm, ledger, memory, relational, retrieval


def test_fuse_exact(spark):
    a = spark.createDataFrame([(101, 1), (102, 2), (103, 3)], "id long, rank int")
    b = spark.createDataFrame([(103, 1), (101, 2)], "id long, rank int")
    got = {r.id: r.score for r in retrieval.fuse([(a, 1.0), (b, 1.0)], "id").collect()}
    assert got == {101: round(1 / 61 + 1 / 62, 9), 103: round(1 / 63 + 1 / 61, 9), 102: round(1 / 62, 9)}


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.707, 0.707]), (4, None), (5, [0.0, 0.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>")
    got = {r.vec_id: r.sim for r in retrieval.most_similar(df, q, 10).collect()}
    assert set(got) == {1, 2, 3} and got[1] == 1 and got[2] == 0 and abs(got[3] - math.sqrt(0.5)) < 1e-6


def test_bm25_needs_all_terms_and_survives_nulls(spark):
    df = spark.createDataFrame([(1, "quick fox"), (2, "quick"), (3, None), (4, ""), (5, "fox quick fox")], "id long, text string")
    assert {r.id for r in retrieval.bm25(df, ["quick", "fox"], "id", "text").collect()} == {1, 5}
    assert retrieval.bm25(df, ["missing"], "id", "text").count() == 0
    assert retrieval.bm25(df.limit(0), ["quick"], "id", "text").count() == 0


def test_write_decisions(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 1.0], 9)], "id long, vector array<float>, superseded_by long")
    new = spark.createDataFrame([(10, [0.9, 0.436]), (11, [0.96, 0.28]), (12, [0.0, 1.0]), (13, [-1.0, -1.0])], "id long, vector array<float>")
    got = {r.id: (r.decision, r.target) for r in memory.write_decision(store, new).collect()}
    assert got == {10: ("supersede", 1), 11: ("duplicate", 1), 12: ("insert", None), 13: ("insert", None)}
    assert {r.decision for r in memory.write_decision(store.limit(0), new).collect()} == {"insert"}


def test_drift_bands(spark):
    low, high = brainstorm.drift_band(F.col("d"))
    got = [(r[0], r[1]) for r in spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "d double").select(low, high).collect()]
    assert got == [(0.62, 0.72), (0.47, 0.57), (0.32, 0.42)]


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("a", 1, "xxxx"), ("a", 2, "x" * 20), ("a", 3, "x")], "g string, n int, t string")
    assert [r.n for r in memory.within_budget(df, "g", "n", "t", 10).collect()] == [1]


def test_decision_errors_and_due(spark):
    schema = "situation string, game string, prediction string, falsifier string, confidence int, review_by string"
    df = spark.createDataFrame([("s", "g", "p", "f", 50, "2026-01-01"), (" ", "x", None, "f", 101, "2026-01-01")], schema)
    got = [r.errors for r in ledger.decision_errors(df, ["g"]).orderBy("situation").collect()]
    assert got == [["situation", "game", "prediction", "confidence"], []]
    days = spark.sql("select * from values ('open', date'2026-01-01'), ('open', date'2026-01-02'), ('done', date'2026-01-01') t(status, review_by)")
    assert ledger.due(days, F.lit("2026-01-01").cast("date")).count() == 1


def test_plan_rows(spark):
    schema = "plan_id int, domain string, actions array<struct<action:string,horizon:string,due_offset_days:int>>"
    df = spark.createDataFrame([(1, "d", [("a", None, 3), ("b", "someday", 1), ("", "today", 1), ("c", "today", None)]), (2, "d", [])], schema)
    got = [(r.title, r.horizon, str(r.review_date)) for r in ledger.plan_rows(df, F.lit("2026-01-01").cast("date")).collect()]
    assert got == [("a", "this_week", "2026-01-04"), ("c", "today", "2026-01-08")]


def test_upsert_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    new = spark.createDataFrame([("a", None, 9), ("c", 5, None)], "k string, x int, y int")
    assert sorted(map(tuple, relational.upsert_keep(old, new, "k").collect())) == [("a", 1, 9), ("b", 3, 4), ("c", 5, None)]


@pytest.mark.parametrize(("name", "want"), [("report-final.pdf", None), ("A Study | site.com", "A Study"), ("ab", None), ("Untitled", None), ("x_y", None), ("Real Title", "Real Title")])
def test_clean_field(spark, name, want):
    assert spark.createDataFrame([(name,)], "v string").select(T.clean_field(F.col("v"))).first()[0] == want


def test_phrases(spark):
    df = spark.createDataFrame([("The concept graph of the notes can't wait",)], "t string").select(T.phrase_words(F.col("t")).alias("own"))
    got = df.select(T.phrases(F.col("own"))).first()[0]
    assert "concept graph" in got and "the" not in got and not any("can't" in p or p.startswith("the ") or p.endswith(" of") for p in got)


def test_reranker_orders_the_first_and_survives_failure(spark):
    from tarnlight.operators.plugs import reranked

    df = spark.createDataFrame([(1, "x", 1), (2, "a b", 2), (3, "a", 3), (4, "a b", 4)], "id int, text string, rank int")
    assert [r.id for r in reranked(df, "a b", "text", "rank", top=3).orderBy("place").collect()] == [2, 3, 1, 4]
    assert [r.id for r in reranked(df, "a b", "text", "rank", scorer=lambda q, t: 1 / 0).orderBy("place").collect()] == [1, 2, 3, 4]


def test_embedder(spark):
    from tarnlight.operators.plugs import embedded

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.embedding for r in embedded(df, "id", "text").collect()}
    assert set(got) == {1, 3} and abs(sum(x * x for x in got[1]) - 1) < 1e-5


def test_load_checked_writes_all_or_nothing(spark, tmp_path):
    from tarnlight.operators.plugs import load_checked

    df = spark.createDataFrame([(1,), (None,)], "id long")
    with pytest.raises(ValueError):
        load_checked(df, F.col("id").isNull(), str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
    load_checked(df.where("id is not null"), F.col("id").isNull(), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_concepts_and_links(spark):
    from tarnlight.operators import graph

    cards = ["Index cards help a reader of Velmorberg remember chapters.", "Good index cards hold one claim.", "We sort index cards by claim.", "Sorted index cards show a gap."]
    bread = ["Sour dough needs warm water.", "Feed sour dough each evening.", "Cold sour dough rises slowly in Velmorberg.", "Old sour dough tastes of Velmorberg."]
    rows = [(i, "cards", t) for i, t in enumerate(cards)] + [(10 + i, "bread", t) for i, t in enumerate(bread)] + [(20, "cards", None), (21, None, "index cards")]
    df = spark.createDataFrame(rows, "id long, topic string, body string")
    found = graph.concepts(df, "topic", "id", "body")
    got = {(r.topic, r.phrase): r.place for r in found.collect()}
    assert got == {("cards", "index cards"): 1, ("bread", "sour dough"): 1}
    themes = spark.createDataFrame([("cards", [1.0, 0.0]), ("bread", [0.8, 0.6])], "topic string, centroid array<double>")
    links = [tuple(r) for r in graph.concept_links(found, df, themes, "topic", "id", "body").collect()]
    assert links == [("index cards", "sour dough", "related theme", 0.8)]
    assert graph.concepts(df.limit(0), "topic", "id", "body").count() == 0


def test_partners_widen_and_prefer_other_topics(spark):
    rows = [(1, [1.0, 0.0], "a", "s"), (2, [0.3, 0.954], "a", "s"), (3, [0.31, 0.951], "b", "s"), (4, [0.0, 1.0], "b", "t"), (5, None, "b", "t")]
    pool = spark.createDataFrame(rows, "id long, vector array<double>, topic string, source string")
    one = brainstorm.partners(pool, pool.where("id = 1"), 0.2, 0.42, 1).collect()
    assert [(r.anchor, r.partner, r.level, r.tier) for r in one] == [(1, 3, 0, 1)]
    wide = brainstorm.partners(pool, pool.where("id = 1"), 0.32, 0.42, 2).collect()
    assert [(r.partner, r.level) for r in wide] == [(3, 1), (2, 1)]
    assert brainstorm.partners(pool, pool.where("id = 1"), 0.6, 0.7).count() == 0


def test_blocks_change_nothing(spark):
    from tarnlight.operators import pairwise

    rows = [(i, [float((i * 7) % 11) - 5, float((i * 5) % 13) - 6, 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    whole = {tuple(r) for r in pairwise.nearest(df, df).collect()}
    first = lambda a, b, s: ([], [], [])
    assert pairwise.matched_in_blocks(df, df, first, block=16).count() == 0
    old, pairwise.BLOCK = pairwise.BLOCK, 16
    pairwise.matched_in_blocks.__defaults__ = ((), 16)
    try:
        assert {tuple(r) for r in pairwise.nearest(df, df).collect()} == whole and len(whole) == 60
    finally:
        pairwise.BLOCK, pairwise.matched_in_blocks.__defaults__ = old, ((), old)


def test_plans_scores_and_atoms(spark):
    acts = "array<struct<action:string,horizon:string,due_offset_days:int>>"
    df = spark.createDataFrame([(1, [("a", None, None), (" ", "today", 1), ("b", "someday", 1), ("c", "today", 400)]), (2, [])], f"id int, actions {acts}")
    got = {r.id: [tuple(x) for x in r.a] for r in df.select("id", ledger.checked_actions("actions").alias("a")).collect()}
    assert got == {1: [("a", "this_week", 7), ("c", "today", 90)], 2: []}
    decisions = spark.createDataFrame([(1, None), (2, "right"), (3, None)], "id int, outcome string")
    scores = spark.createDataFrame([(1, 2, "wrong"), (1, 1, "right"), (2, 1, "wrong"), (9, 1, "x")], "id int, at int, outcome string")
    assert {tuple(r) for r in ledger.score_once(decisions, scores).collect()} == {(1, "right", 1), (2, "right", 1), (3, None, 0)}
    rules = spark.createDataFrame([(1, "s", "d", "k", "m"), (2, " ", None, "x", None)], "id int, statement string, decision_rule string, kind string, map string")
    maps = spark.createDataFrame([("m",), (None,)], "map string")
    assert {r.id: r.errors for r in ledger.atom_errors(rules, ["k"], maps).collect()} == {1: [], 2: ["statement", "decision_rule", "kind", "map"]}


def test_small_parts_hold_every_row_once(spark):
    from tarnlight.session import small_parts

    df = spark.range(95).select(F.lit("same").alias("x"))
    parts = small_parts(df, 10)
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 95 and max(sizes) <= 10 and parts[0].columns == ["x"]
    assert [p.count() for p in small_parts(df.limit(0), 10)] == [0]


def test_gaps_of_many_clusters(spark, monkeypatch):
    from tarnlight.operators import brainstorm

    df = spark.range(12).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"), F.array(F.col("id").cast("double") + 1, F.lit(3.0)).alias("v"))
    whole = brainstorm.gaps(df, "c", "v", 100).collect()
    own = brainstorm.small_parts
    monkeypatch.setattr(brainstorm, "small_parts", lambda d, most: own(d, 4))
    assert brainstorm.gaps(df, "c", "v", 100).collect() == whole and len(whole) == 66
