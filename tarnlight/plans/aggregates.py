"""Aggregations, ranks, top lists, set operations and changes of the stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.operators import brainstorm as B
from tarnlight.operators import graph as G
from tarnlight.operators import ledger as L
from tarnlight.operators import memory as M
from tarnlight.operators import relational as R
from tarnlight.operators.pairwise import nearest
from tarnlight.operators.plugs import embedded as embed
from tarnlight.plans.base import CHUNKS, MEMORIES, NOW, RECALL, Catalogue
from tarnlight.plans.catalog import chunks, memories, now, recall
from tarnlight.session import read, small_parts, union_all

catalogue = Catalogue()
add = catalogue.add


@add("A1", f"SELECT s.id, count(c.id) AS chunks FROM sources s LEFT JOIN {CHUNKS} c ON c.source_id = s.id GROUP BY s.id")
def chunks_per_source(spark, folder):
    counts = chunks(spark, folder).groupBy("source_id").agg(F.count("id").alias("chunks"))
    return read(spark, folder, "sources").select("id").join(counts.withColumnRenamed("source_id", "id"), "id", "left").select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@add("A2", f"SELECT count(*) AS n FROM {CHUNKS}")
def total(spark, folder):
    return chunks(spark, folder).agg(F.count("*").alias("n"))


@add("A3", f"SELECT coalesce(category, '(none)') AS category, count(*) AS n FROM {MEMORIES} WHERE superseded_by IS NULL GROUP BY 1")
def live_by_category(spark, folder):
    return M.live_by(memories(spark, folder), "category", "(none)")


@add("A4", f"SELECT coalesce(project, '(global)') AS project, count(*) AS n FROM {MEMORIES} WHERE superseded_by IS NULL GROUP BY 1 ORDER BY n DESC, project LIMIT 5")
def live_by_project(spark, folder):
    return M.live_by(memories(spark, folder), "project", "(global)").orderBy(F.desc("n"), "project").limit(5)


@add("A5", f"SELECT CAST(sum(retrieval_count) AS BIGINT) AS total_retrievals, count(*) FILTER (WHERE superseded_by IS NULL) AS live, count(*) FILTER (WHERE superseded_by IS NULL AND retrieval_count = 0) AS never_retrieved FROM {MEMORIES}")
def retrieval_totals(spark, folder):
    return M.retrieval_totals(memories(spark, folder))


@add("A6", f"SELECT e.entity, count(*) AS n FROM memory_entities e JOIN {MEMORIES} m ON m.id = e.memory_id AND m.superseded_by IS NULL GROUP BY 1")
def entity_counts(spark, folder):
    return M.entity_counts(read(spark, folder, "memory_entities"), memories(spark, folder))


@add("A7", f"""SELECT entity, category, n FROM (SELECT e.entity, lower(coalesce(m.category, '(none)')) AS category, count(*) AS n FROM memory_entities e
 JOIN {MEMORIES} m ON m.id = e.memory_id AND m.superseded_by IS NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, category) = 1""")
def entity_category(spark, folder):
    return M.entity_category(read(spark, folder, "memory_entities"), memories(spark, folder))


@add("A8", f"""SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n FROM memory_entities a JOIN memory_entities b ON a.memory_id = b.memory_id AND a.entity < b.entity
 JOIN {MEMORIES} m ON m.id = a.memory_id AND m.superseded_by IS NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def entity_pairs(spark, folder):
    return M.entity_pairs(read(spark, folder, "memory_entities"), memories(spark, folder), 2)


@add("A9", """WITH b AS (SELECT user_id, greatest(count(DISTINCT props) - 1, 0) AS changes FROM events WHERE event_type = 'view' GROUP BY 1),
 t AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, CAST(floor(sum(value) FILTER (WHERE event_type = 'view') / 4) AS BIGINT) AS tokens FROM events)
 SELECT t.views, t.clicks, t.tokens, (SELECT CAST(sum(changes) AS BIGINT) FROM b) AS changes FROM t""")
def ledger_rollup(spark, folder):
    e = read(spark, folder, "events")
    view = F.col("event_type") == "view"
    totals = e.agg(F.count_if(view).alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"), L.tokens_of(F.sum(F.when(view, F.col("value")))).alias("tokens"))
    changes = L.block_changes(e.where(view), "user_id", "props").agg(F.sum("changes").alias("changes"))
    return totals.crossJoin(F.broadcast(changes))


@add("A10", """SELECT user_id, count(*) AS calls, round(count(*) FILTER (WHERE event_type = 'click') * 1.0 / nullif(count(*) FILTER (WHERE event_type IN ('click', 'view')), 0), 6) AS read_share,
 round(sum(CASE WHEN event_type = 'click' THEN value * 1.15 ELSE value * 0.1 END), 5) AS avoided FROM events GROUP BY 1""")
def cache_metrics(spark, folder):
    click = F.col("event_type") == "click"
    share = F.count_if(click) / F.nullif(F.count_if(F.col("event_type").isin("click", "view")), F.lit(0))
    return read(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.round(share, 6).alias("read_share"), F.round(F.sum(F.when(click, F.col("value") * 1.15).otherwise(F.col("value") * 0.1)), 5).alias("avoided"))


@add("A11", """WITH k AS (SELECT * FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
 SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY 1""")
@add("W5", """WITH k AS (SELECT * FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
 SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY 1""")
def transcript_usage(spark, folder):
    """Of equal keys the last line counts."""
    lines = read(spark, folder, "events").where(F.col("event_type").isin("click", "view"))
    return L.usage(lines, "user_id", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@add("A14", f"""SELECT least(topic_a, topic_b) AS topic_a, greatest(topic_a, topic_b) AS topic_b, count(*) FILTER (WHERE lower(status) <> 'new') AS wins,
 count(*) FILTER (WHERE lower(status) = 'new' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAYS) AS losses,
 round((count(*) FILTER (WHERE lower(status) <> 'new') + 1.0) / (count(*) FILTER (WHERE lower(status) <> 'new') + count(*) FILTER (WHERE lower(status) = 'new' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAYS) + 2), 9) AS score
 FROM hypotheses WHERE topic_a IS NOT NULL AND topic_b IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2""")
@add("A15", f"""SELECT least(topic_a, topic_b) AS topic_a, greatest(topic_a, topic_b) AS topic_b, count(*) FILTER (WHERE lower(status) <> 'new') AS wins,
 count(*) FILTER (WHERE lower(status) = 'new' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAYS) AS losses,
 round((count(*) FILTER (WHERE lower(status) <> 'new') + 1.0) / (count(*) FILTER (WHERE lower(status) <> 'new') + count(*) FILTER (WHERE lower(status) = 'new' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAYS) + 2), 9) AS score
 FROM hypotheses WHERE topic_a IS NOT NULL AND topic_b IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2""")
def arm_counts(spark, folder):
    return B.arm_counts(read(spark, folder, "hypotheses"), now())


@add("A16", "SELECT len(embedding_blob) AS width, count(*) AS n FROM hypotheses WHERE embedding_blob IS NOT NULL GROUP BY 1 ORDER BY n DESC, width LIMIT 1")
def majority_width(spark, folder):
    """The signature of most vectors; rows without one do not vote."""
    return read(spark, folder, "hypotheses").where("embedding_blob is not null").groupBy(F.size("embedding_blob").cast("long").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1)


@add("A17", """SELECT label, topic, CAST(sum(n) OVER (PARTITION BY label) AS BIGINT) AS size FROM (SELECT e.label, coalesce(d.topic, '(none)') AS topic, count(*) AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY 1, 2)
 QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, topic) = 1""")
def cluster_labels(spark, folder):
    d = read(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("topic", F.lit("(none)")).alias("topic"))
    counts = read(spark, folder, "embeddings").select("vec_id", "label").join(d, "vec_id").groupBy("label", "topic").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("label").agg(F.sum("n").alias("size"))
    return R.first_per_group(counts, ["label"], [F.desc("n"), F.col("topic")]).join(sizes, "label").select("label", "topic", "size")


V64 = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@add("A18", f"SELECT b.vec_id, greatest(0.0, max(round({V64}, 6))) AS nearest FROM embeddings b, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a WHERE a.vec_id <> b.vec_id GROUP BY 1")
def nearest_to_ledger(spark, folder):
    """Greatest similarity to what the ledger holds (every twentieth vector), never below 0."""
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(e, e.where("id % 20 = 0")).select(F.col("query").alias("vec_id"), F.greatest("sim", F.lit(0.0)).alias("nearest"))


@add("A19", "SELECT coalesce(topic_a, '_unmapped') AS map, row_number() OVER (PARTITION BY coalesce(topic_a, '_unmapped') ORDER BY id) AS place, id FROM hypotheses")
def rules_by_map(spark, folder):
    """The rows of each map in order; as numbered rows, for one map may hold a third of them."""
    rows = read(spark, folder, "hypotheses").select(F.coalesce("topic_a", F.lit("_unmapped")).alias("map"), "id")
    return R.numbered(rows, "map", ["id"], "place").select("map", "place", "id")


@add("A20", """WITH t AS (SELECT DISTINCT topic, replace(topic, '_', ' ') AS term FROM documents WHERE topic IS NOT NULL),
 h AS (SELECT r.id, t.topic, count(*) AS hits FROM hypotheses r JOIN t ON contains(lower(r.text), t.term) GROUP BY 1, 2)
 SELECT r.id, coalesce(b.topic, 'general') AS domain FROM hypotheses r LEFT JOIN (SELECT id, topic FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, topic) = 1) b ON b.id = r.id""")
def domains(spark, folder):
    """The domain of which most terms occur in a text; the terms are broadcast in parts of a checked size."""
    terms = read(spark, folder, "documents").where("topic is not null").select("topic", F.translate("topic", "_", " ").alias("term")).distinct()
    h = read(spark, folder, "hypotheses").select("id", "text")
    holds = union_all([h.join(part, F.lower("text").contains(F.col("term"))) for part in small_parts(terms)])
    hits = holds.groupBy("id", "topic").agg(F.count("*").alias("hits"))
    best = R.first_per_group(hits, ["id"], [F.desc("hits"), F.col("topic")]).select("id", "topic")
    return h.select("id").join(best, "id", "left").select("id", F.coalesce("topic", F.lit("general")).alias("domain"))


@add("A21", "SELECT lower(status) AS status, count(*) AS n FROM hypotheses GROUP BY 1")
def load_summary(spark, folder):
    return read(spark, folder, "hypotheses").groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("n"))


@add("A22", f"SELECT lower(trim(session_id)) AS session, count(*) FILTER (WHERE lower(trim(role)) IN ('assistant', 'ai', 'bot')) AS turns FROM {RECALL} GROUP BY 1")
def turns(spark, folder):
    return recall(spark, folder).groupBy(F.lower(F.trim("session_id")).alias("session")).agg(F.count_if(F.lower(F.trim("role")).isin("assistant", "ai", "bot")).alias("turns"))


@add("A23", "SELECT node, count(*) AS degree FROM (SELECT chunk_a AS node FROM hypotheses UNION ALL SELECT chunk_b FROM hypotheses) GROUP BY 1")
def degrees(spark, folder):
    return G.degrees(read(spark, folder, "hypotheses"), "chunk_a", "chunk_b")


@add("A12", """WITH p AS (SELECT d.topic, d.doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(d.text), '[a-z]{4,}'), lambda w: length(w) >= 6))) AS phrase FROM documents d WHERE d.topic IS NOT NULL AND d.text IS NOT NULL)
 SELECT topic, phrase, count(*) AS tf FROM p GROUP BY 1, 2""")
def word_counts(spark, folder):
    """Rows of each cluster that have a word: the input of the class TF-IDF."""
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: F.length(w) >= 6))
    return read(spark, folder, "documents").where("topic is not null and text is not null").select("topic", F.explode(own).alias("phrase")).groupBy("topic", "phrase").agg(F.count("*").alias("tf"))


@add("A13", """WITH p AS (SELECT d.topic, d.doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(d.text), '[a-z]{4,}'), lambda w: length(w) >= 6))) AS phrase FROM documents d WHERE d.topic IS NOT NULL AND d.text IS NOT NULL),
 c AS (SELECT topic, phrase, count(*) AS tf FROM p GROUP BY 1, 2), f AS (SELECT phrase, sum(tf) AS f FROM c GROUP BY 1 HAVING sum(tf) >= 3), k AS (SELECT c.*, f.f FROM c JOIN f USING (phrase)),
 s AS (SELECT topic, sum(tf) AS size FROM k GROUP BY 1) SELECT k.topic, k.phrase, round(k.tf / s.size * ln(1 + (SELECT count(DISTINCT topic) FROM k) / greatest(k.f, 1)), 9) AS score FROM k JOIN s USING (topic)""")
def class_tfidf(spark, folder):
    return G.class_tfidf(word_counts(spark, folder), "topic")


@add("W3", """WITH p AS (SELECT d.topic, d.doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(d.text), '[a-z]{4,}'), lambda w: length(w) >= 6))) AS phrase FROM documents d WHERE d.topic IS NOT NULL AND d.text IS NOT NULL),
 c AS (SELECT topic, phrase, count(*) AS tf FROM p GROUP BY 1, 2), f AS (SELECT phrase, sum(tf) AS f FROM c GROUP BY 1 HAVING sum(tf) >= 3), k AS (SELECT c.*, f.f FROM c JOIN f USING (phrase)),
 s AS (SELECT topic, sum(tf) AS size FROM k GROUP BY 1), x AS (SELECT k.topic, k.phrase, round(k.tf / s.size * ln(1 + (SELECT count(DISTINCT topic) FROM k) / greatest(k.f, 1)), 9) AS score FROM k JOIN s USING (topic))
 SELECT topic, phrase, score FROM x QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY score DESC, topic) = 1""")
def best_cluster(spark, folder):
    return G.best_cluster(class_tfidf(spark, folder), "topic")


@add("W2", f"SELECT source_id, id FROM {CHUNKS} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id) <= 3")
def first_chunks(spark, folder):
    return R.first_per_group(chunks(spark, folder).select("source_id", "chunk_index", "id"), ["source_id"], [F.col("chunk_index"), F.col("id")], 3).select("source_id", "id")


@add("W4", f"""WITH o AS (SELECT id, project FROM {MEMORIES} WHERE superseded_by IS NULL AND (project = 'fern' OR project IS NULL)), p AS (SELECT id FROM o ORDER BY project IS NULL, id LIMIT 8)
 SELECT id, 'prefix' AS part FROM p UNION ALL SELECT id, 'tail' FROM (SELECT id FROM o WHERE id NOT IN (SELECT id FROM p) ORDER BY id DESC LIMIT 4)""")
@add("T7", f"""WITH o AS (SELECT id, project FROM {MEMORIES} WHERE superseded_by IS NULL AND (project = 'fern' OR project IS NULL)), p AS (SELECT id FROM o ORDER BY project IS NULL, id LIMIT 8)
 SELECT id, 'prefix' AS part FROM p UNION ALL SELECT id, 'tail' FROM (SELECT id FROM o WHERE id NOT IN (SELECT id FROM p) ORDER BY id DESC LIMIT 4)""")
def prefix_and_tail(spark, folder):
    """Rows with a project first."""
    return M.prefix_and_tail(memories(spark, folder), "fern")


@add("W6", f"""WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {CHUNKS} WHERE text IS NOT NULL)
 SELECT id, max(section) AS sections FROM (SELECT id, CAST(sum(CASE WHEN regexp_matches(line, '^\\s*(?i:chapter|section|part|book)\\s+\\w+') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS section FROM l) GROUP BY 1""")
def sections_per_chunk(spark, folder):
    from tarnlight.sources.blocks import text_sections

    return text_sections(chunks(spark, folder), "id", "text").groupBy("id").agg(F.max("section").alias("sections"))


@add("W7", f"""SELECT id, project FROM (SELECT id, project, max(CASE WHEN used > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY id) AS over FROM
 (SELECT id, project, sum(length(fact) + 1) OVER (PARTITION BY project ORDER BY id) AS used FROM {MEMORIES} WHERE project IS NOT NULL AND superseded_by IS NULL)) WHERE over = 0""")
def character_budget(spark, folder):
    return M.within_budget(R.live(memories(spark, folder)).where("project is not null"), "project", "id", "fact", 600).select("id", "project")


@add("W8", f"SELECT id, session FROM (SELECT id, lower(trim(session_id)) AS session, row_number() OVER (PARTITION BY lower(trim(session_id)) ORDER BY id) AS r FROM {RECALL}) WHERE r > 40")
@add("R4", f"SELECT id, session FROM (SELECT id, lower(trim(session_id)) AS session, row_number() OVER (PARTITION BY lower(trim(session_id)) ORDER BY id) AS r FROM {RECALL}) WHERE r > 40")
def unseen_suffix(spark, folder):
    """Messages of each session beyond its watermark."""
    r = recall(spark, folder).select("id", F.lower(F.trim("session_id")).alias("session"))
    return R.numbered(r, "session", ["id"]).where("n > 40").select("id", "session")


@add("T5", f"SELECT id FROM {MEMORIES} WHERE superseded_by IS NULL ORDER BY retrieval_count DESC, updated_at DESC, id LIMIT 25")
def most_retrieved(spark, folder):
    return R.live(memories(spark, folder)).orderBy(F.desc("retrieval_count"), F.desc("updated_at"), "id").limit(25).select("id")


@add("T6", "SELECT id, title FROM sources ORDER BY created_at DESC, id LIMIT 20")
def newest_sources(spark, folder):
    return read(spark, folder, "sources").orderBy(F.desc("created_at"), "id").limit(20).select("id", "title")


@add("T9", """WITH m AS (SELECT id FROM hypotheses WHERE text ILIKE '%habit%'), l AS (SELECT h.id AS link, m.id FROM hypotheses h JOIN m ON m.id = h.id) SELECT link FROM l ORDER BY link LIMIT 5""")
def matched_links(spark, folder):
    """Limits apply after everything has been matched."""
    h = read(spark, folder, "hypotheses")
    m = R.containing(h, "habit", "text").select("id")
    return h.join(m, "id", "left_semi").select(F.col("id").alias("link")).orderBy("link").limit(5)


@add("T12", "SELECT id, coalesce(realized_sim, 0.0) AS score FROM hypotheses WHERE realized_sim IS NULL OR NOT isnan(realized_sim) ORDER BY score DESC, id LIMIT 30")
def bridges_by_score(spark, folder):
    h = read(spark, folder, "hypotheses").where("realized_sim is null or not isnan(realized_sim)")
    return h.select("id", F.coalesce("realized_sim", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(30)


@add("T13", """SELECT phrase, f FROM (SELECT phrase, count(*) AS f FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: length(w) >= 6))) AS phrase FROM documents WHERE topic IS NOT NULL AND text IS NOT NULL) GROUP BY 1) ORDER BY f DESC, phrase LIMIT 100""")
def vocabulary(spark, folder):
    return word_counts(spark, folder).groupBy("phrase").agg(F.sum("tf").alias("f")).orderBy(F.desc("f"), "phrase").limit(100)


@add("T14")
def sampled_chunks(spark, folder):
    """A repeatable sample: the 8000 smallest hashes of the id."""
    return chunks(spark, folder).orderBy(F.xxhash64("id", F.lit(42)), "id").limit(8000).select("id")


@add("X1", f"SELECT kind, count(*) AS n FROM (SELECT coalesce(topic, '(none)') AS kind FROM documents UNION ALL SELECT '__memory__' FROM {MEMORIES}) GROUP BY 1")
def pool(spark, folder):
    d = read(spark, folder, "documents").select(F.coalesce("topic", F.lit("(none)")).alias("kind"))
    return d.unionByName(memories(spark, folder).select(F.lit("__memory__").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@add("X2", f"SELECT id FROM {MEMORIES} WHERE id NOT IN (SELECT memory_id FROM memory_entities)")
def fresh(spark, folder):
    return memories(spark, folder).select("id").join(read(spark, folder, "memory_entities").select(F.col("memory_id").alias("id")), "id", "left_anti")


@add("X3", "SELECT DISTINCT id FROM (SELECT chunk_a AS id FROM hypotheses UNION ALL SELECT chunk_b FROM hypotheses)")
def union_of_ids(spark, folder):
    h = read(spark, folder, "hypotheses")
    return h.select(F.col("chunk_a").alias("id")).union(h.select("chunk_b")).distinct()


@add("X4", "SELECT h.id, (h.topic_a IN (SELECT replace(topic, '_', ' ') FROM documents WHERE topic IS NOT NULL) AND h.topic_b IN (SELECT replace(topic, '_', ' ') FROM documents WHERE topic IS NOT NULL)) AS present FROM hypotheses h WHERE topic_a IS NOT NULL AND topic_b IS NOT NULL")
def arm_present(spark, folder):
    """Both topics of an arm among the topics there are."""
    have = read(spark, folder, "documents").where("topic is not null").select(F.translate("topic", "_", " ").alias("topic")).distinct()
    h = read(spark, folder, "hypotheses").where("topic_a is not null and topic_b is not null").select("id", "topic_a", "topic_b")
    for side in ("topic_a", "topic_b"):
        h = h.join(have.select(F.col("topic").alias(side), F.lit(True).alias(f"has_{side}")), side, "left")
    return h.select("id", (F.coalesce("has_topic_a", F.lit(False)) & F.coalesce("has_topic_b", F.lit(False))).alias("present"))


@add("X5", """SELECT id, min(pos) AS pos FROM (SELECT id, 1 AS pos FROM sources WHERE title ILIKE '%lessons%' UNION ALL SELECT id, 2 FROM sources WHERE title ILIKE '%manual%' UNION ALL SELECT id, 3 FROM sources WHERE title ILIKE '%revisited%') GROUP BY 1""")
def first_match_order(spark, folder):
    asked = spark.createDataFrame([("lessons", 1), ("manual", 2), ("revisited", 3)], "word string, pos int")
    s = read(spark, folder, "sources")
    return s.join(F.broadcast(asked), F.lower("title").contains(F.col("word"))).groupBy("id").agg(F.min("pos").alias("pos"))


@add("X6", "SELECT memory_id, count(DISTINCT lower(trim(entity))) AS n FROM memory_entities WHERE trim(entity) <> '' GROUP BY 1")
def entity_sets(spark, folder):
    e = read(spark, folder, "memory_entities").select("memory_id", F.lower(F.trim("entity")).alias("e")).where("e <> ''")
    return e.groupBy("memory_id").agg(F.count_distinct("e").alias("n"))


@add("M1", """SELECT coalesce(o.topic, n.topic) AS topic, coalesce(n.v, o.v) AS v FROM (SELECT topic_a AS topic, min(snippet_a) AS v FROM hypotheses WHERE topic_a IS NOT NULL GROUP BY 1) o
 FULL OUTER JOIN (SELECT topic_b AS topic, max(CASE WHEN lower(status) = 'kept' THEN snippet_b END) AS v FROM hypotheses WHERE topic_b IS NOT NULL GROUP BY 1) n ON o.topic = n.topic""")
def upsert(spark, folder):
    """New values win where they are not null: what first topics say is stored, what kept second topics say is new."""
    h = read(spark, folder, "hypotheses")
    old = h.where("topic_a is not null").groupBy(F.col("topic_a").alias("topic")).agg(F.min("snippet_a").alias("v"))
    new = h.where("topic_b is not null").groupBy(F.col("topic_b").alias("topic")).agg(F.max(F.when(F.lower("status") == "kept", F.col("snippet_b"))).alias("v"))
    return R.upsert_keep(old, new, "topic")


@add("M3", f"SELECT session, id, content FROM (SELECT lower(trim(session_id)) AS session, id, content FROM {RECALL}) QUALIFY row_number() OVER (PARTITION BY session ORDER BY id DESC) = 1")
def last_write_wins(spark, folder):
    r = recall(spark, folder).select(F.lower(F.trim("session_id")).alias("session"), "id", "content")
    return r.groupBy("session").agg(F.max_by(F.struct("id", "content"), "id").alias("r")).select("session", "r.id", "r.content")


@add("M4", f"SELECT c.id FROM {CHUNKS} c WHERE c.source_id NOT IN (SELECT id FROM sources WHERE file_path LIKE 'inbox/%')")
def cascade(spark, folder):
    """What is left of the chunks when sources are deleted."""
    gone = read(spark, folder, "sources").where(F.col("file_path").startswith("inbox/"))
    return R.without(chunks(spark, folder), gone, "source_id", "id").select("id")


@add("M6", f"SELECT m.id, CASE WHEN m.superseded_by IS NULL AND e.id IS NOT NULL THEN e.by_id ELSE m.superseded_by END AS superseded_by FROM {MEMORIES} m LEFT JOIN (SELECT id, id + 1 AS by_id FROM {MEMORIES} WHERE fact LIKE 'Prefers%') e ON e.id = m.id")
def supersede(spark, folder):
    """A version row is set only where the memory is still live."""
    m = memories(spark, folder)
    events = m.where(F.col("fact").startswith("Prefers")).select("id", (F.col("id") + 1).alias("by_id"))
    return m.select("id", "superseded_by").join(events, "id", "left").select("id", F.coalesce("superseded_by", "by_id").alias("superseded_by"))


@add("M8", f"SELECT id FROM {MEMORIES} WHERE NOT (superseded_by IS NULL AND retrieval_count = 0 AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 56 DAYS)")
def prune(spark, folder):
    m = memories(spark, folder)
    return m.join(M.stale(m, now(), 8).select("id"), "id", "left_anti").select("id")


@add("M9", f"SELECT m.id, m.retrieval_count + coalesce(r.n, 0) AS retrieval_count, CAST(CASE WHEN r.n > 0 THEN TIMESTAMP '{NOW}' ELSE m.last_retrieved_at END AS VARCHAR) AS last_retrieved_at FROM {MEMORIES} m LEFT JOIN (SELECT memory_id, count(*) AS n FROM memory_entities GROUP BY 1) r ON r.memory_id = m.id")
def counted_reads(spark, folder):
    """Counters and times from an append-only log of reads; here each mention stands for a read of now."""
    log = read(spark, folder, "memory_entities").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"))
    at = F.when(F.col("n") > 0, F.lit(NOW).cast("timestamp_ntz")).otherwise(F.col("last_retrieved_at").cast("timestamp_ntz"))
    return memories(spark, folder).join(log, "id", "left").select("id", (F.col("retrieval_count") + F.coalesce("n", F.lit(0))).alias("retrieval_count"), at.cast("string").alias("last_retrieved_at"))


@add("M5", f"SELECT id, category, project FROM (SELECT id, 1 AS version, category, project FROM {MEMORIES} UNION ALL SELECT id, 2, 'goal', project FROM {MEMORIES} WHERE project = 'kiln') QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def update_as_version(spark, folder):
    """A partial update is a new version; the latest version of each key is current."""
    base = memories(spark, folder).select("id", F.lit(1).alias("version"), "category", "project")
    new = base.where("project = 'kiln'").select("id", F.lit(2).alias("version"), F.lit("goal").alias("category"), "project")
    return R.latest_version(base.union(new), "id", [F.desc("version")]).select("id", "category", "project")


@add("M7", f"SELECT id, CASE WHEN project = 'kiln' THEN concat('Now: ', fact) ELSE fact END AS fact, CASE WHEN project = 'kiln' THEN 64 ELSE len(embedding_blob) END AS width FROM {MEMORIES} WHERE fact IS NOT NULL")
def updated_memories(spark, folder):
    """Facts of a project are reworded; only these are embedded again, and no duplicate is looked for."""
    m = memories(spark, folder).where("fact is not null").select("id", "fact", "embedding_blob", F.coalesce(F.col("project") == "kiln", F.lit(False)).alias("changed"))
    new = m.where("changed").select("id", F.concat(F.lit("Now: "), F.col("fact")).alias("fact"))
    embedded = embed(new, "id", "fact").select("id", F.size("embedding").alias("width")).join(new, "id").select("id", "fact", "width")
    width = F.when(F.col("embedding_blob").isNotNull(), F.size("embedding_blob"))
    return m.where("not changed").select("id", "fact", width.alias("width")).union(embedded)


@add("M10", f"""WITH s AS (SELECT id, updated_at AS moment, lower(status) AS outcome FROM hypotheses WHERE status IS NOT NULL UNION ALL SELECT id, TIMESTAMP '{NOW}', 'late' FROM hypotheses WHERE notes IS NOT NULL),
 t AS (SELECT id, arg_min(outcome, (moment, outcome)) AS earliest, count(*) AS n FROM s GROUP BY 1), d AS (SELECT id, CASE WHEN realized_sim IS NOT NULL AND NOT isnan(realized_sim) THEN 'scored' END AS outcome FROM hypotheses)
 SELECT d.id, coalesce(d.outcome, t.earliest) AS outcome, coalesce(t.n, 0) - CASE WHEN d.outcome IS NULL AND t.earliest IS NOT NULL THEN 1 ELSE 0 END AS refused FROM d LEFT JOIN t ON t.id = d.id""")
def scored_once(spark, folder):
    """The first score of an open decision stands; scores of decided ones and second scores are refused."""
    h = read(spark, folder, "hypotheses")
    scores = h.where("status is not null").select("id", F.col("updated_at").cast("timestamp_ntz").alias("at"), F.lower("status").alias("outcome"))
    scores = scores.union(h.where("notes is not null").select("id", F.lit(NOW).cast("timestamp_ntz"), F.lit("late")))
    done = F.when(F.col("realized_sim").isNotNull() & ~F.isnan("realized_sim"), F.lit("scored"))
    return L.score_once(h.select("id", done.alias("outcome")), scores)


@add("M15", f"""SELECT b.id FROM (SELECT id, lower(trim(session_id)) AS s, content, created_at FROM {RECALL}) b
 WHERE EXISTS (SELECT 1 FROM (SELECT id, lower(trim(session_id)) AS s, content, created_at FROM {RECALL}) a WHERE a.s = b.s AND a.content = b.content AND (a.created_at, a.id) < (b.created_at, b.id) AND a.created_at > b.created_at - INTERVAL 600 SECONDS)""")
def repeated_submissions(spark, folder):
    """Submissions of which the session sent the same text less than 600 seconds before; the nearest one before decides."""
    r = recall(spark, folder).where("content is not null and session_id is not null and created_at is not null")
    by = F.lag("created_at").over(Window.partitionBy(F.lower(F.trim("session_id")), "content").orderBy("created_at", "id"))
    return r.withColumn("before", by).where("before > created_at - interval 600 seconds").select("id")


@add("C4", """WITH s AS (SELECT id, regexp_replace(regexp_extract(file_path, '([^/]+)$', 1), '\\.[A-Za-z0-9]+$', '') AS stem FROM sources WHERE file_path IS NOT NULL)
 SELECT id, lower(CASE WHEN regexp_matches(stem, '^[0-9a-f]{16,}$') THEN 'Untitled (' || left(stem, 8) || '…)' ELSE trim(regexp_replace(regexp_replace(regexp_replace(stem, '[_-]+', ' ', 'g'), '^\\d{6,}\\s*', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')) END) AS title FROM s""")
def titles_from_paths(spark, folder):
    return read(spark, folder, "sources").where("file_path is not null").select("id", F.lower(T.title_from_path(F.col("file_path"))).alias("title"))


@add("C2", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def digests(spark, folder):
    return read(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@add("C3", f"SELECT id, left(sha1(fact), 12) AS block FROM {MEMORIES} WHERE fact IS NOT NULL")
def block_hashes(spark, folder):
    return memories(spark, folder).where("fact is not null").select("id", F.substring(F.sha1("fact"), 1, 12).alias("block"))


@add("C7", "SELECT doc_id, length(text) AS n, length(translate(text, '‘’“”', '''''\"\"')) AS m, (length(text) - length(replace(translate(text, '‘’', ''''''), '''', ''))) AS quotes FROM documents WHERE text IS NOT NULL")
def quotes(spark, folder):
    t = F.translate("text", "‘’", "''")
    return read(spark, folder, "documents").where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"), F.length(T.plain_quotes(F.col("text"))).cast("long").alias("m"), (F.length("text") - F.length(F.replace(t, F.lit("'"), F.lit("")))).cast("long").alias("quotes"))


@add("C9", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]+')) AS words FROM documents WHERE text IS NOT NULL")
def word_totals(spark, folder):
    return read(spark, folder, "documents").where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"))


@add("C10")
def phrase_totals(spark, folder):
    return G.phrase_counts(read(spark, folder, "documents"), "topic", "doc_id", "text", 3)


@add("C11", f"SELECT id, regexp_matches(fact, '^[A-Z]') AS capital FROM {MEMORIES} WHERE fact IS NOT NULL")
def capitals(spark, folder):
    return memories(spark, folder).where("fact is not null").select("id", F.col("fact").rlike("^[A-Z]").alias("capital"))


@add("C13", "SELECT doc_id, left(text, 300) AS head, right(text, 700) AS tail FROM documents WHERE text IS NOT NULL")
@add("C14", "SELECT doc_id, left(text, 300) AS head, right(text, 700) AS tail FROM documents WHERE text IS NOT NULL")
def snippets(spark, folder):
    return read(spark, folder, "documents").where("text is not null").select("doc_id", F.left("text", F.lit(300)).alias("head"), F.right("text", F.lit(700)).alias("tail"))


@add("C15", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def estimated_tokens(spark, folder):
    return read(spark, folder, "documents").where("text is not null").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@add("C16", "SELECT id, regexp_replace(file_path, '[^A-Za-z0-9]', '-', 'g') AS slug FROM sources WHERE file_path IS NOT NULL")
def slugs(spark, folder):
    return read(spark, folder, "sources").where("file_path is not null").select("id", T.slug(F.col("file_path")).alias("slug"))


@add("C5", "SELECT id, coalesce(nullif(trim(title), ''), file_path, 'Untitled') AS title, nullif(trim(author), '') AS author FROM sources")
def metadata_order(spark, folder):
    """Given title, else file name; an author is never invented."""
    return read(spark, folder, "sources").select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "file_path", F.lit("Untitled")).alias("title"), F.nullif(F.trim("author"), F.lit("")).alias("author"))


@add("C17", "SELECT id, split_part(file_path, '/', 1) AS project FROM sources WHERE file_path IS NOT NULL")
def project_of_path(spark, folder):
    return read(spark, folder, "sources").where("file_path is not null").select("id", F.split_part("file_path", F.lit("/"), F.lit(1)).alias("project"))


@add("C18", """WITH t AS (SELECT DISTINCT topic FROM documents WHERE topic IS NOT NULL), p AS (SELECT id, unnest(string_split(lower(replace(file_path, ' ', '_')), '/')) AS part FROM sources WHERE file_path IS NOT NULL)
 SELECT p.id, min(t.topic) AS topic FROM p JOIN t ON lower(t.topic) = p.part OR starts_with(p.part, lower(t.topic) || '.') OR starts_with(p.part, lower(t.topic) || '-') GROUP BY 1""")
def topic_of_path(spark, folder):
    """The first topic by name that a component of the path is, whatever the case; a file name counts without what follows a dot or dash."""
    part = F.explode(F.split(F.lower(F.replace("file_path", F.lit(" "), F.lit("_"))), "/"))
    parts = read(spark, folder, "sources").where("file_path is not null").select("id", part.alias("part"))
    starts = F.array_distinct(F.concat(F.array("part"), F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("part"), F.lit(1))), lambda i: F.substr("part", i, F.lit(1)).isin(".", "-")), lambda i: F.substr("part", F.lit(1), i - 1))))
    topics = read(spark, folder, "documents").where("topic is not null").select("topic", F.lower("topic").alias("part")).distinct()
    return parts.select("id", F.explode(starts).alias("part")).distinct().join(topics, "part").groupBy("id").agg(F.min("topic").alias("topic"))


@add("C19", "SELECT doc_id, regexp_matches(topic, '^[A-Za-z0-9_-]+$') AS valid FROM documents WHERE topic IS NOT NULL")
def valid_topics(spark, folder):
    return read(spark, folder, "documents").where("topic is not null").select("doc_id", F.col("topic").rlike("^[A-Za-z0-9_-]+$").alias("valid"))


@add("C20", f"SELECT id, CASE WHEN lower(trim(category)) = '' THEN '' WHEN lower(trim(category)) IN ('fact', 'preference', 'goal', 'event', 'decision') THEN lower(trim(category)) WHEN category IS NOT NULL THEN 'fact' END AS category FROM {MEMORIES}")
def known_categories(spark, folder):
    return memories(spark, folder).select("id", T.known_category(F.col("category")).alias("category"))


@add("C21", f"SELECT id, CASE WHEN regexp_matches(fact, '\\b(?i:prefers?|always|never|don''t)\\b') THEN 'preference' ELSE 'fact' END AS category FROM {MEMORIES} WHERE fact IS NOT NULL")
def categories_of_text(spark, folder):
    return memories(spark, folder).where("fact is not null").select("id", T.category_of(F.col("fact")).alias("category"))


@add("C22", f"SELECT id, trim(regexp_replace(regexp_extract(content, '^\\s*(?i:remind me)\\s+(.+)$', 1), '\\s+', ' ', 'g')) AS captured FROM {RECALL} WHERE regexp_matches(content, '^\\s*(?i:remind me)\\s+(.+)$')")
def captured_requests(spark, folder):
    asked = F.regexp_extract("content", r"^\s*(?i:remind me)\s+(.+)$", 1)
    return recall(spark, folder).where(F.col("content").rlike(r"^\s*(?i:remind me)\s+(.+)$")).select("id", F.trim(F.regexp_replace(asked, r"\s+", " ")).alias("captured"))


@add("C25", f"SELECT id, json_extract_string(content, '$.topic') AS topic, CAST(json_extract(content, '$.hits') AS BIGINT) AS hits FROM {RECALL} WHERE content LIKE '{{%' AND json_valid(content)")
def block_text(spark, folder):
    parsed = F.from_json("content", "hits bigint, topic string")
    return recall(spark, folder).where(F.col("content").startswith("{")).select("id", parsed.alias("p")).where("p is not null").select("id", "p.topic", "p.hits")


@add("C26", f"SELECT id, CAST(CAST(created_at AS DATE) + 7 AS VARCHAR) AS review, date_diff('day', CAST(created_at AS DATE), DATE '2026-03-01') AS age FROM {MEMORIES}")
def dates(spark, folder):
    day = F.to_date("created_at")
    return memories(spark, folder).select("id", F.date_add(day, 7).cast("string").alias("review"), F.date_diff(F.lit("2026-03-01").cast("date"), day).cast("long").alias("age"))


@add("C27", "SELECT id, round(sqrt(drift), 4) AS drift FROM hypotheses WHERE drift IS NOT NULL")
def rounded(spark, folder):
    return read(spark, folder, "hypotheses").where("drift is not null").select("id", F.round(F.sqrt("drift"), 4).alias("drift"))


@add("C30", "SELECT id, concat_ws(' ', text, topic_a, topic_b) AS query FROM hypotheses")
def expanded_queries(spark, folder):
    return read(spark, folder, "hypotheses").select("id", F.concat_ws(" ", "text", "topic_a", "topic_b").alias("query"))


@add("C28", """SELECT id, CASE WHEN coalesce(trim(text), '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(lower(status) IN ('new', 'kept', 'killed'), false) THEN 0 ELSE 1 END + CASE WHEN coalesce(trim(snippet_a), '') = '' THEN 1 ELSE 0 END
 + CASE WHEN coalesce(trim(kill_test), '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(drift BETWEEN 0 AND 100, false) THEN 0 ELSE 1 END AS errors FROM hypotheses""")
def validated(spark, folder):
    h = read(spark, folder, "hypotheses")
    rows = h.select("id", F.col("text").alias("situation"), F.lower("status").alias("game"), F.col("snippet_a").alias("prediction"), F.col("kill_test").alias("falsifier"), F.col("drift").alias("confidence"), F.lit("2026-03-01").alias("review_by"))
    return L.decision_errors(rows, ["new", "kept", "killed"]).select("id", F.size("errors").alias("errors"))


@add("C29", """SELECT h.id, CASE WHEN coalesce(trim(text), '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(trim(kill_test), '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(lower(status) IN ('new', 'kept', 'testing'), false) THEN 0 ELSE 1 END
 + CASE WHEN h.topic_a IS NOT NULL AND h.topic_a IN (SELECT replace(topic, '_', ' ') FROM documents WHERE topic IS NOT NULL) THEN 0 ELSE 1 END AS errors FROM hypotheses h""")
def checked_rules(spark, folder):
    """Hypotheses as rules: a statement, a test, a listed status and a topic that the documents know."""
    h = read(spark, folder, "hypotheses").select("id", F.col("text").alias("statement"), F.col("kill_test").alias("decision_rule"), F.lower("status").alias("kind"), F.col("topic_a").alias("map"))
    maps = read(spark, folder, "documents").select(F.translate("topic", "_", " ").alias("map"))
    return L.atom_errors(h, ["new", "kept", "testing"], maps).select("id", F.size("errors").alias("errors"))


@add("R6", f"SELECT m.id FROM {MEMORIES} m LEFT JOIN (SELECT coalesce(project, '') AS p, max(created_at) AS mark FROM {MEMORIES} WHERE superseded_by IS NOT NULL GROUP BY 1) w ON w.p = coalesce(m.project, '') WHERE m.created_at > coalesce(w.mark, TIMESTAMP '1970-01-01')")
def since_watermark(spark, folder):
    """Rows newer than the high watermark of their project: the newest of those that were compacted before."""
    m = memories(spark, folder).select("id", "created_at", "superseded_by", F.coalesce("project", F.lit("")).alias("p"))
    mark = m.where("superseded_by is not null").groupBy("p").agg(F.max("created_at").alias("mark"))
    return m.join(mark, "p", "left").where("mark is null and created_at is not null or created_at > mark").select("id")


@add("R7", "SELECT DISTINCT memory_id, lower(entity) AS entity FROM memory_entities")
def suppressed_repeats(spark, folder):
    return read(spark, folder, "memory_entities").select("memory_id", F.lower("entity").alias("entity")).dropDuplicates(["memory_id", "entity"])
