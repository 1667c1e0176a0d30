"""Retrieval, memory search, graphs and brainstorming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.operators import brainstorm as B
from tarnlight.operators import graph as G
from tarnlight.operators import ledger as L
from tarnlight.operators import memory as M
from tarnlight.operators import relational as R
from tarnlight.operators import retrieval as S
from tarnlight.operators.pairwise import nearest as nearest_row
from tarnlight.plans.base import CHUNKS, MEMORIES, NOW, Catalogue
from tarnlight.plans.catalog import _bm25_sql, chunks, memories
from tarnlight.session import read

catalogue = Catalogue()
add = catalogue.add

COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
E_COS = COSINE.format(a="a.embedding", b="b.embedding")
NEAREST = f"SELECT b.vec_id, round({E_COS}, 9) AS sim FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) ORDER BY sim DESC, b.vec_id LIMIT"
TERMS = ["review", "queue"]
USABLE = f"(SELECT * FROM {MEMORIES} WHERE len(embedding_blob) = 96 AND list_count(list_filter(embedding_blob, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_count(list_filter(embedding_blob, lambda x: x <> 0)) > 0)"


def one_vector(spark, folder):
    return read(spark, folder, "embeddings").orderBy("vec_id").limit(1)


def usable(spark, folder):
    v = F.col("embedding_blob")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return memories(spark, folder).where((F.size(v) == 96) & F.coalesce(good, F.lit(False)))


@add("V1", f"SELECT a.id, round({COSINE.format(a='a.embedding_blob', b='q.embedding_blob')}, 6) AS sim FROM {USABLE} a, (SELECT * FROM {USABLE} ORDER BY id LIMIT 1) q")
def cosine_rows(spark, folder):
    """Cosine of every usable row with one vector; unusable rows are skipped."""
    m = usable(spark, folder).select("id", "embedding_blob")
    q = F.broadcast(m.orderBy("id").limit(1).select(F.col("embedding_blob").alias("q")))
    return m.crossJoin(q).select("id", F.round(S.cosine(F.col("embedding_blob"), F.col("q")), 6).alias("sim"))


@add("V2", f"{NEAREST} 50")
@add("T2", f"{NEAREST} 50")
def nearest(spark, folder):
    return S.most_similar(read(spark, folder, "embeddings"), one_vector(spark, folder), 50)


@add("V4", _bm25_sql(TERMS, CHUNKS, "id", "text", " ORDER BY score DESC, id LIMIT 50")[1:-1])
@add("T1", _bm25_sql(TERMS, CHUNKS, "id", "text", " ORDER BY score DESC, id LIMIT 50")[1:-1])
def keyword_search(spark, folder):
    return S.bm25(chunks(spark, folder), TERMS, "id", "text").orderBy(F.desc("score"), "id").limit(50)


@add("V5", _bm25_sql(["weekly", "index", "review"], MEMORIES, "id", "fact", " ORDER BY score DESC, id LIMIT 30")[1:-1].replace(" AND tf", " OR tf"))
def memory_keywords(spark, folder):
    """Any of the terms counts."""
    return S.bm25(memories(spark, folder), ["weekly", "index", "review"], "id", "fact", every=False).orderBy(F.desc("score"), "id").limit(30)


DOCS = _bm25_sql(TERMS, "documents", "doc_id", "text", " ORDER BY score DESC, doc_id LIMIT 50")
FUSED = f"""WITH v AS ({NEAREST} 50), s AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM v), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {DOCS}),
 u AS (SELECT doc_id, 1.0 / (60 + rank) AS part, rank AS r FROM s UNION ALL SELECT doc_id, 1.0 / (60 + rank), NULL FROM k),
 f AS (SELECT doc_id, round(sum(CAST(part AS DOUBLE)), 9) AS score, min(r) AS first_rank FROM u GROUP BY 1)"""


@add("V6", f"{FUSED} SELECT doc_id, score FROM f")
@add("J7", f"{FUSED} SELECT doc_id, score FROM f")
@add("W1", f"{FUSED} SELECT doc_id, score FROM f")
def fused_ranks(spark, folder):
    d = read(spark, folder, "documents")
    v = S.most_similar(read(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id"), one_vector(spark, folder), 50, "doc_id")
    k = S.bm25(d, TERMS, "doc_id", "text")
    return S.fuse([(S.ranked(v, "doc_id", "sim", 50), 1.0), (S.ranked(k, "doc_id", "score", 50), 1.0)], "doc_id").select("doc_id", "score")


HYBRID = f"{FUSED} SELECT f.doc_id, f.score, d.source FROM (SELECT * FROM f ORDER BY score DESC, first_rank NULLS LAST, doc_id LIMIT 10) f JOIN documents d ON d.doc_id = f.doc_id"


@add("V7", HYBRID)
@add("T4", HYBRID)
def hybrid(spark, folder):
    vectors = read(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return S.hybrid_search(read(spark, folder, "documents"), vectors, one_vector(spark, folder), TERMS).select("doc_id", "score", "source")


@add("V9", f"""WITH q AS (SELECT * FROM {USABLE} ORDER BY id LIMIT 1), v AS (SELECT a.id, round({COSINE.format(a='a.embedding_blob', b='q.embedding_blob')}, 9) AS sim FROM {USABLE} a, q ORDER BY sim DESC, a.id LIMIT 60),
 s AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (SELECT * FROM v WHERE sim >= 0.2)), k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {_bm25_sql(['weekly', 'review'], MEMORIES, 'id', 'fact', ' ORDER BY score DESC, id LIMIT 60').replace(' AND tf', ' OR tf')}),
 e AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM (SELECT DISTINCT memory_id AS id FROM memory_entities WHERE entity IN ('backlog', 'draft'))),
 u AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS part FROM s UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM k UNION ALL SELECT id, 0.5::DOUBLE / (60 + rank) FROM e), f AS (SELECT id, sum(part) AS score FROM u GROUP BY 1)
 SELECT f.id, round(f.score + CASE WHEN m.project = 'fern' THEN 0.01 ELSE 0 END, 9) AS score FROM f JOIN {MEMORIES} m ON m.id = f.id WHERE m.superseded_by IS NULL AND (m.project = 'fern' OR m.project IS NULL) ORDER BY score DESC, f.id LIMIT 20""")
def memory_search(spark, folder):
    """Three signals; liveness and project are tested after fusion, so such rows take up places of the signals."""
    m = memories(spark, folder)
    u = usable(spark, folder)
    q = u.orderBy("id").limit(1)
    near = S.gated(S.most_similar(u, q, 60, "id", "embedding_blob"), 0.2)
    words = S.bm25(m, ["weekly", "review"], "id", "fact", every=False)
    hits = read(spark, folder, "memory_entities").where(F.col("entity").isin("backlog", "draft")).select(F.col("memory_id").alias("id")).distinct()
    exact = R.numbered(hits.withColumn("all", F.lit(1)), "all", ["id"], "rank")
    fused = S.fuse([(S.ranked(near, "id", "sim", 60), 1.0), (S.ranked(words, "id", "score", 60), 1.0), (exact, 0.5)], "id").select("id", "score")
    kept = R.in_scope(R.live(m.select("id", "project", "superseded_by")).join(fused, "id"), "fern")
    return kept.select("id", F.round(F.col("score") + F.when(F.col("project") == "fern", 0.01).otherwise(0.0), 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)


WRITE = f"""WITH n AS (SELECT id, embedding_blob AS v FROM {USABLE} WHERE id % 20 = 0), s AS (SELECT n.id AS new_id, m.id, m.superseded_by IS NULL AS live, round({COSINE.format(a='n.v', b='m.embedding_blob')}, 6) AS sim
 FROM n, {USABLE} m WHERE m.id % 20 <> 0), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, id) = 1)
 SELECT new_id AS id, CASE WHEN live AND sim >= 0.95 THEN 'duplicate' WHEN live AND sim >= 0.8 THEN 'supersede' ELSE 'insert' END AS decision, CASE WHEN live AND sim >= 0.8 THEN id END AS target FROM b"""


@add("V10", WRITE)
def write_decisions(spark, folder):
    """Every twentieth memory is new, the others are the store."""
    u = usable(spark, folder).select("id", F.col("embedding_blob").alias("vector"), "superseded_by")
    return M.write_decision(u.where("id % 20 <> 0"), u.where("id % 20 = 0"))


HYPOTHESES = "(SELECT * FROM hypotheses WHERE len(embedding_blob) = 96 AND list_count(list_filter(embedding_blob, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_count(list_filter(embedding_blob, lambda x: x <> 0)) > 0)"


def usable_hypotheses(spark, folder):
    v = F.col("embedding_blob")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return read(spark, folder, "hypotheses").where((F.size(v) == 96) & F.coalesce(good, F.lit(False))).select("id", v.alias("vector")).dropDuplicates(["id"])


@add("J10", f"""WITH h AS (SELECT * FROM {HYPOTHESES} QUALIFY row_number() OVER (PARTITION BY id) = 1)
 SELECT a.id, b.id AS near, round({COSINE.format(a='a.embedding_blob', b='b.embedding_blob')}, 6) AS sim FROM h a, h b WHERE a.id % 20 = 0 AND b.id % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sim DESC, b.id) = 1""")
def nearest_in_store(spark, folder):
    """The nearest stored hypothesis of every twentieth one."""
    h = usable_hypotheses(spark, folder)
    return nearest_row(h.where("id % 20 = 0"), h.where("id % 20 <> 0")).select(F.col("query").alias("id"), F.col("id").alias("near"), "sim")


@add("V11", """SELECT s.topic_a AS concept, count(*) AS links FROM (SELECT topic_a FROM hypotheses WHERE topic_a ILIKE '%note%' OR topic_b ILIKE '%note%' OR topic_a ILIKE '%map%' OR topic_b ILIKE '%map%') s GROUP BY 1""")
def concept_context(spark, folder):
    """Links that touch a concept matching any word of the question."""
    h = read(spark, folder, "hypotheses")
    hit = R.containing(h, "note", "topic_a", "topic_b").select("id").union(R.containing(h, "map", "topic_a", "topic_b").select("id")).distinct()
    return h.join(hit, "id", "left_semi").groupBy(F.col("topic_a").alias("concept")).agg(F.count("*").alias("links"))


@add("V12", f"SELECT c.id, printf('[%d] %s (%s)', c.id, s.title, coalesce(c.location, '-')) AS block FROM {CHUNKS} c JOIN sources s ON s.id = c.source_id")
def context_blocks(spark, folder):
    s = read(spark, folder, "sources").select(F.col("id").alias("source_id"), "title")
    return chunks(spark, folder).join(s, "source_id").select("id", F.format_string("[%d] %s (%s)", F.col("id"), F.col("title"), F.coalesce("location", F.lit("-"))).alias("block"))


@add("V13")
def clusters(spark, folder):
    return G.spherical_clusters(read(spark, folder, "embeddings"), "vec_id", "embedding", 8)


@add("V14")
def concepts(spark, folder):
    """The phrases that tell each topic from the others."""
    return G.concepts(read(spark, folder, "documents"), "topic", "doc_id", "text")


@add("V15")
def theme_labels(spark, folder):
    """A topic's best phrase, one of several words first; a label that two topics share gets a number."""
    best = R.first_per_group(concepts(spark, folder), ["topic"], [F.desc(F.col("phrase").contains(" ").cast("int")), F.desc("score"), F.col("phrase")])
    n = F.row_number().over(S.Window.partitionBy("phrase").orderBy("topic"))
    return best.select("topic", F.when(n == 1, F.col("phrase")).otherwise(F.concat("phrase", F.lit(" ("), n.cast("string"), F.lit(")"))).alias("label"))


@add("V16")
def definitions(spark, folder):
    """For each topic the sentence with most of its phrases; long and short sentences lose."""
    top = concepts(spark, folder).select("topic", "phrase")
    d = read(spark, folder, "documents").where("topic is not null and text is not null")
    sentences = d.select("topic", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence")).where(F.length("sentence").between(20, 600)).distinct()
    hits = sentences.join(top, "topic").where(F.instr(F.lower("sentence"), F.col("phrase")) > 0).groupBy("topic", "sentence").agg(F.count("*").alias("n"), F.min(F.instr(F.lower("sentence"), F.col("phrase"))).alias("at"))
    score = F.col("n") + F.when(F.col("at") < 60, 0.5).otherwise(0.0) - F.when(F.length("sentence").between(40, 220), 0.0).otherwise(1.0)
    return R.first_per_group(hits.withColumn("score", score), ["topic"], [F.desc("score"), F.col("sentence")]).select("topic", F.left("sentence", F.lit(300)).alias("definition"), "score")


@add("V17")
def concept_edges(spark, folder):
    """Links of the concepts: within a theme, by common documents, and between themes whose vectors are near."""
    d = read(spark, folder, "documents").dropDuplicates(["doc_id"])
    vectors = read(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id").join(d.where("topic is not null").select("doc_id", "topic"), "doc_id")
    return G.concept_links(concepts(spark, folder), d, B.centroids(vectors, "topic", "embedding"), "topic", "doc_id", "text")


BAND = "SELECT id, drift, round(round(0.72 - 0.30 * drift, 6) - 0.10, 6) AS low, round(0.72 - 0.30 * drift, 6) AS high FROM hypotheses WHERE drift IS NOT NULL"


@add("V19", BAND)
def drift_bands(spark, folder):
    low, high = B.drift_band(F.col("drift"))
    return read(spark, folder, "hypotheses").where("drift is not null").select("id", "drift", low.alias("low"), high.alias("high"))


PARTNERS = f"""WITH p AS (SELECT e.vec_id AS id, e.embedding, coalesce(d.topic, '') AS topic, coalesce(d.source, '') AS source FROM embeddings e JOIN (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id) = 1) d ON d.doc_id = e.vec_id), a AS (SELECT * FROM p WHERE id % 20 = 0),
 s AS (SELECT a.id AS anchor, b.id AS partner, CASE WHEN a.topic <> b.topic THEN 1 WHEN a.source <> b.source THEN 2 ELSE 3 END AS tier, round({E_COS}, 6) AS sim FROM a, p b WHERE a.id <> b.id),
 l AS (SELECT *, CASE WHEN sim BETWEEN 0.2 AND 0.42 THEN 0 ELSE 1 END AS level FROM s WHERE sim BETWEEN 0.15 AND 0.47)
 SELECT anchor, partner, level, tier, sim FROM l QUALIFY level = min(level) OVER (PARTITION BY anchor) AND row_number() OVER (PARTITION BY anchor ORDER BY level, tier, partner) <= 3"""
NARROW = PARTNERS.replace("0.2 AND 0.42", "0.36 AND 0.42").replace("0.15 AND 0.47", "0.31 AND 0.47")


def idea_pool(spark, folder):
    d = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("source", F.lit("")).alias("source"))
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(d, "id")


@add("V20", PARTNERS)
def partners(spark, folder):
    """Partners of every twentieth vector."""
    pool = idea_pool(spark, folder)
    return B.partners(pool, pool.where("id % 20 = 0"), 0.2, 0.42, 3)


@add("J9", NARROW)
def narrow_partners(spark, folder):
    """A band so narrow that anchors have to look beyond it."""
    pool = idea_pool(spark, folder)
    return B.partners(pool, pool.where("id % 20 = 0"), 0.36, 0.42, 3)


@add("T10", f"{NEAREST} 90")
def seed_order(spark, folder):
    """Seeds for six ideas: 90 of them."""
    return B.seed_front(read(spark, folder, "embeddings"), one_vector(spark, folder), 6)


@add("V21")
def collisions(spark, folder):
    """Pairs of ideas in the band; their sum is compared with both and with the ledger (vectors whose id ends the other half of a twenty)."""
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    pairs = partners(spark, folder).select(F.least("anchor", "partner").alias("a"), F.greatest("anchor", "partner").alias("b")).distinct()
    both = pairs.join(vectors.withColumnsRenamed({"v": "a", "vector": "va"}), "a").join(vectors.withColumnsRenamed({"v": "b", "vector": "vb"}), "b")
    both = both.withColumn("id", F.xxhash64("a", "b")).withColumn("idea", F.zip_with("va", "vb", lambda x, y: x + y))
    known = nearest_row(both.select("id", F.col("idea").alias("vector")), vectors.where("v % 20 = 10").select(F.col("v").alias("id"), "vector")).select(F.col("query").alias("id"), F.col("sim").alias("nearest"))
    rows = both.join(known, "id", "left").select("a", "b", S.cosine(F.col("idea"), F.col("va")).alias("cos_a"), S.cosine(F.col("idea"), F.col("vb")).alias("cos_b"), "nearest")
    return B.bridge_scores(rows).orderBy(F.desc("score"), "a", "b").limit(20).select("a", "b", "score")


@add("V22", f"""WITH h AS (SELECT * FROM {HYPOTHESES} QUALIFY row_number() OVER (PARTITION BY id) = 1), n AS (SELECT b.id, greatest(0.0, max(round({COSINE.format(a='a.embedding_blob', b='b.embedding_blob')}, 6))) AS near FROM h b, h a WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY 1),
 s AS (SELECT d.id, d.drift AS x, coalesce(nullif(d.realized_sim, 'nan'), 0) AS y, coalesce(n.near, 0.0) AS near FROM hypotheses d LEFT JOIN n ON n.id = d.id WHERE d.drift IS NOT NULL)
 SELECT id, round(1 - abs(x - y), 3) AS balance, round(1 - near, 3) AS novelty, greatest(x, y) >= 0.92 AS paraphrase, round((1 - abs(x - y) + 1 - near) / 2 + 1e-9, 5) AS score FROM s""")
def bridge_scores(spark, folder):
    """Novelty is what is left of the greatest similarity to the ledger, every twentieth hypothesis."""
    h = usable_hypotheses(spark, folder)
    known = nearest_row(h, h.where("id % 20 = 0")).select(F.col("query").alias("id"), F.col("sim").alias("nearest"))
    rows = read(spark, folder, "hypotheses").where("drift is not null").join(known, "id", "left")
    scored = B.bridge_scores(rows.select("id", F.col("drift").alias("cos_a"), F.coalesce(F.nanvl("realized_sim", F.lit(0.0)), F.lit(0.0)).alias("cos_b"), "nearest"))
    exact = (1 - F.abs(F.col("cos_a") - F.col("cos_b")) + 1 - F.greatest(F.coalesce("nearest", F.lit(0.0)), F.lit(0.0))) / 2 + 1e-9
    return scored.select("id", "balance", "novelty", "paraphrase", F.round(exact, 5).alias("score"))


@add("V23", f"""WITH a AS (SELECT least(topic_a, topic_b) AS topic_a, greatest(topic_a, topic_b) AS topic_b, count(*) FILTER (WHERE lower(status) <> 'new') AS wins,
 count(*) FILTER (WHERE lower(status) = 'new' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAYS) AS losses FROM hypotheses WHERE topic_a IS NOT NULL AND topic_b IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT DISTINCT replace(topic, '_', ' ') AS topic FROM documents WHERE topic IS NOT NULL)
 SELECT topic_a, topic_b, wins, losses, round((wins + 1.0) / (wins + losses + 2), 9) AS score FROM a WHERE topic_a IN (SELECT topic FROM t) AND topic_b IN (SELECT topic FROM t) ORDER BY score DESC, topic_a, topic_b LIMIT 1""")
def best_arm(spark, folder):
    arms = B.arm_counts(read(spark, folder, "hypotheses"), F.lit(NOW).cast("timestamp_ntz"))
    topics = read(spark, folder, "documents").where("topic is not null").select(F.translate("topic", "_", " ").alias("topic")).distinct()
    return B.best_arm(arms, topics)


GAPS = """WITH u AS (SELECT label, i, x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM (SELECT label, embedding, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
 m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1)
 SELECT a.label AS a, b.label AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS sim FROM c a, c b WHERE a.label < b.label ORDER BY sim, a.label, b.label LIMIT 10"""


@add("V24", GAPS)
@add("T8", GAPS)
def gaps(spark, folder):
    return B.gaps(read(spark, folder, "embeddings"), "label", "embedding", 10)


@add("V25", f"""WITH l AS (SELECT e.memory_id, e.entity FROM memory_entities e JOIN {MEMORIES} m ON m.id = e.memory_id AND m.superseded_by IS NULL), t AS (SELECT entity FROM l GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 60), k AS (SELECT * FROM l WHERE entity IN (SELECT entity FROM t))
 SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n FROM k a JOIN k b ON a.memory_id = b.memory_id AND a.entity < b.entity GROUP BY 1, 2""")
def entity_graph(spark, folder):
    return M.entity_graph(read(spark, folder, "memory_entities"), memories(spark, folder))


@add("V26")
def communities(spark, folder):
    return G.communities(entity_graph(spark, folder), "entity_a", "entity_b")


ACTIONS = """WITH a AS (SELECT id, 1 AS pos, trim(kill_test) AS action, 'today' AS horizon, CASE WHEN drift > 0.2 THEN 3 END AS days FROM hypotheses UNION ALL SELECT id, 2, trim(snippet_a), lower(status), 400 FROM hypotheses
 UNION ALL SELECT id, 3, trim(notes), NULL, NULL FROM hypotheses UNION ALL SELECT id, 4, trim(snippet_b), 'this_month', 0 FROM hypotheses),
 g AS (SELECT id, pos, action, coalesce(horizon, 'this_week') AS horizon, greatest(1, least(90, coalesce(days, 7))) AS days FROM a WHERE action <> '' AND coalesce(horizon, 'this_week') IN ('today', 'this_week', 'this_month', 'this_quarter'))"""


def plans(spark, folder):
    """Hypotheses as plans of four actions, some without a text, with no or an unknown horizon, and with days out of range."""
    act = lambda action, horizon, days: F.struct(F.col(action).alias("action"), horizon.cast("string").alias("horizon"), days.cast("int").alias("due_offset_days"))
    none = F.lit(None)
    actions = F.array(act("kill_test", F.lit("today"), F.when(F.col("drift") > 0.2, 3)), act("snippet_a", F.lower("status"), F.lit(400)), act("notes", none, none), act("snippet_b", F.lit("this_month"), F.lit(0)))
    return read(spark, folder, "hypotheses").select(F.col("id").alias("plan_id"), F.col("topic_a").alias("domain"), actions.alias("actions"))


@add("M14", f"{ACTIONS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS n, action AS title, horizon, CAST(DATE '2026-03-01' + CAST(days AS INTEGER) AS VARCHAR) AS review FROM g")
def plan_rows(spark, folder):
    """The valid actions of each plan as experiments."""
    rows = L.plan_rows(plans(spark, folder), F.lit("2026-03-01").cast("date"))
    return rows.select(F.col("plan_id").alias("id"), "n", "title", "horizon", F.col("review_date").cast("string").alias("review"))


@add("C24", f"{ACTIONS} SELECT h.id, count(g.pos) AS kept, coalesce(max(days), 0) AS latest, coalesce(string_agg(horizon, ',' ORDER BY pos), '') AS horizons FROM hypotheses h LEFT JOIN g ON g.id = h.id GROUP BY h.id")
def checked_plans(spark, folder):
    """What is left of each plan after validation; a plan without a valid action stays, and is empty."""
    rows = plans(spark, folder).select(F.col("plan_id").alias("id"), L.checked_actions("actions").alias("a"))
    return rows.select("id", F.size("a").cast("long").alias("kept"), F.coalesce(F.array_max(F.transform("a", lambda a: a["days"])), F.lit(0)).alias("latest"), F.array_join(F.transform("a", lambda a: a["horizon"]), ",").alias("horizons"))


@add("C1")
def chunked(spark, folder):
    from tarnlight.sources.blocks import chunks_of

    return chunks_of(read(spark, folder, "documents"), "doc_id", "text")
