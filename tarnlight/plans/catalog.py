"""Scans, filters and joins of the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.operators import ledger
from tarnlight.operators import memory as M
from tarnlight.operators import relational as R
from tarnlight.operators.retrieval import bm25, cosine, most_similar
from tarnlight.plans.base import CHUNKS, MEMORIES, NOW, RECALL, Catalogue
from tarnlight.session import read

catalogue = Catalogue()
add = catalogue.add
now = lambda: F.lit(NOW).cast("timestamp_ntz")


def memories(spark, folder):
    return R.once(read(spark, folder, "atomic_memories"), "id")


def chunks(spark, folder):
    return R.once(read(spark, folder, "chunks"), "id")


def recall(spark, folder):
    return R.once(read(spark, folder, "memory_recall"), "id")


@add("S3", f"""WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {CHUNKS} WHERE text IS NOT NULL),
 f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(?i:chapter|section|part|book)\\s+\\w+') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS section FROM l)
 SELECT id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM f GROUP BY id, section""")
def sections_of_text(spark, folder):
    """Plain text cut at chapter headings; a heading stays in its section."""
    from tarnlight.sources.blocks import text_sections

    s = text_sections(chunks(spark, folder), "id", "text")
    return s.groupBy("id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@add("S9", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
 f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\*+\\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
 SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM f GROUP BY doc_id, section""")
def sections_of_org(spark, folder):
    from tarnlight.sources.blocks import ORG_HEADING, text_sections

    s = text_sections(read(spark, folder, "documents"), "doc_id", "text", ORG_HEADING)
    return s.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@add("S4")
def markdown_blocks(spark, folder):
    from tarnlight.sources.blocks import markdown

    return markdown(read(spark, folder, "documents"), "doc_id", "text")


@add("S10", """WITH t AS (SELECT id, trim(regexp_replace(trim(author), '\\s*[|–-]\\s*[A-Za-z0-9-]+\\.(com|org|net)\\s*$', '')) AS a FROM sources)
 SELECT id, CASE WHEN NOT (length(a) < 3 OR length(a) > 200 OR lower(a) IN ('untitled','unknown','none','null','title','author','various','n/a','microsoft word','document') OR regexp_matches(a, '[_*]')
 OR regexp_matches(a, '^\\S+\\.(?i:pdf|epub|docx?|txt|md|html?)$')) THEN a END AS author FROM t""")
def clean_authors(spark, folder):
    return read(spark, folder, "sources").select("id", T.clean_field(F.col("author")).alias("author"))


@add("S11", f"SELECT json_extract_string(tool_calls, '$[0].name') AS tool, count(*) AS calls, CAST(sum(CAST(json_extract(tool_calls, '$[0].k') AS BIGINT)) AS BIGINT) AS k FROM {RECALL} WHERE json_valid(tool_calls) GROUP BY 1")
def tool_calls(spark, folder):
    """JSON of each line read with a schema; lines that are no JSON are skipped."""
    calls = F.from_json("tool_calls", "array<struct<name:string,k:bigint>>")
    rows = recall(spark, folder).select(calls.alias("c")).where("c is not null")
    return rows.groupBy(F.col("c")[0]["name"].alias("tool")).agg(F.count("*").alias("calls"), F.sum(F.col("c")[0]["k"]).alias("k"))


@add("S12", "SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def ledger_scan(spark, folder):
    props = F.from_json("props", "k bigint")
    return read(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(props["k"]).alias("k"))


@add("S15", "SELECT coalesce(topic, '(none)') AS topic, count(*) AS documents, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def topic_catalogue(spark, folder):
    return read(spark, folder, "documents").groupBy(F.coalesce("topic", F.lit("(none)")).alias("topic")).agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))


@add("S16", f"SELECT c.id, c.source_id, s.title, c.chunk_index, length(c.text) AS chars, e.vec_id IS NOT NULL AS has_vector FROM {CHUNKS} c JOIN sources s ON s.id = c.source_id LEFT JOIN embeddings e ON e.vec_id = c.id")
@add("J1", f"SELECT c.id, c.source_id, s.title, c.chunk_index, length(c.text) AS chars, e.vec_id IS NOT NULL AS has_vector FROM {CHUNKS} c JOIN sources s ON s.id = c.source_id LEFT JOIN embeddings e ON e.vec_id = c.id")
def chunks_in_context(spark, folder):
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    joined = R.with_context(chunks(spark, folder), read(spark, folder, "sources"), vectors)
    return joined.select("id", "source_id", "title", "chunk_index", F.length("text").alias("chars"), F.col("embedding").isNotNull().alias("has_vector"))


@add("F1", f"SELECT id, fact FROM {MEMORIES} WHERE project = 'atlas' AND agent_id = 'planner'")
def filter_given(spark, folder):
    return R.where_given(memories(spark, folder), project="atlas", agent_id="planner", run_id=None).select("id", "fact")


@add("F2", f"SELECT id FROM {MEMORIES} WHERE superseded_by IS NULL")
def filter_live(spark, folder):
    return R.live(memories(spark, folder)).select("id")


@add("F3", f"SELECT id, project FROM {MEMORIES} WHERE project = 'fern' OR project IS NULL")
def filter_scope(spark, folder):
    return R.in_scope(memories(spark, folder), "fern").select("id", "project")


@add("F4", "SELECT id, title, CASE id WHEN 17 THEN 1 WHEN 3 THEN 2 WHEN 42 THEN 3 WHEN 8 THEN 4 END AS pos FROM sources WHERE id IN (17, 3, 42, 8)")
def filter_list_in_order(spark, folder):
    return R.in_order(read(spark, folder, "sources"), "id", [17, 3, 42, 8]).select("id", "title", "pos").orderBy("pos")


@add("F5", "SELECT id, title FROM sources WHERE title ILIKE '%notes%' OR author ILIKE '%notes%' OR file_path ILIKE '%notes%'")
def filter_containing(spark, folder):
    return R.containing(read(spark, folder, "sources"), "notes", "title", "author", "file_path").select("id", "title")


@add("F6", f"SELECT id, 0.0::DOUBLE AS score FROM {CHUNKS} WHERE text ILIKE '%review queue%' ORDER BY id LIMIT 20")
def keyword_fallback(spark, folder):
    """Plain substring search, used where keyword search cannot read the query."""
    return R.containing(chunks(spark, folder), "review queue", "text").select("id", F.lit(0.0).alias("score")).orderBy("id").limit(20)


@add("F7", f"SELECT id FROM {MEMORIES} WHERE substr(fact, 1, 7) = 'Prefers'")
def filter_prefix(spark, folder):
    return memories(spark, folder).where(F.col("fact").startswith("Prefers")).select("id")


@add("F8", "SELECT id, realized_sim FROM hypotheses WHERE realized_sim BETWEEN 0.55 AND 0.65")
def filter_band(spark, folder):
    return read(spark, folder, "hypotheses").where(F.col("realized_sim").between(0.55, 0.65)).select("id", "realized_sim")


@add("F9", f"""WITH l AS (SELECT id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM {CHUNKS} WHERE text IS NOT NULL)
 SELECT id FROM l WHERE len(lines) <= 2 OR list_sum(list_transform(lines, lambda x: length(trim(x)))) / len(lines) >= 30""")
def filter_prose(spark, folder):
    return chunks(spark, folder).where(T.is_prose(F.col("text"))).select("id")


@add("F10", f"SELECT 'chunk' AS kind, count(*) AS n FROM {CHUNKS} WHERE length(text) >= 200 UNION ALL SELECT 'memory', count(*) FROM {MEMORIES} WHERE length(fact) >= 60")
def filter_length(spark, folder):
    c = chunks(spark, folder).where(F.length("text") >= 200).agg(F.count("*").alias("n")).select(F.lit("chunk").alias("kind"), "n")
    return c.union(memories(spark, folder).where(F.length("fact") >= 60).agg(F.count("*").alias("n")).select(F.lit("memory").alias("kind"), "n"))


COS64 = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


@add("F11", f"SELECT b.vec_id, {COS64} AS sim FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) AND {COS64} >= 0.2")
def filter_gate(spark, folder):
    e = read(spark, folder, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("sim")).where("sim >= 0.2")


@add("F12", "SELECT id, lower(status) AS status FROM hypotheses WHERE lower(status) = 'testing' AND CAST(updated_at AS DATE) <= DATE '2026-03-01'")
def filter_due(spark, folder):
    h = read(spark, folder, "hypotheses").select("id", F.lower("status").alias("status"), F.to_date("updated_at").alias("review_by"))
    return ledger.due(h.withColumn("status", F.when(F.col("status") == "testing", "open")), F.lit("2026-03-01").cast("date")).select("id", F.lit("testing").alias("status"))


@add("F13", f"SELECT id FROM {MEMORIES} WHERE superseded_by IS NULL AND retrieval_count = 0 AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 56 DAYS")
def filter_stale(spark, folder):
    return M.stale(memories(spark, folder), now(), 8).select("id")


@add("F14", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[_{}=\\\\]|://|self\\.|def |import ')")
def filter_no_code(spark, folder):
    return read(spark, folder, "documents").where(~T.looks_like_code(F.col("text"))).select("doc_id")


@add("F15", f"SELECT id, regexp_matches(content, '\\b(?i:latest|recent|recently|last|today|yesterday|newest|now|current|this week)\\b') AS recent FROM {RECALL} WHERE content IS NOT NULL AND lower(trim(role)) = 'user'")
def recency_flag(spark, folder):
    return recall(spark, folder).where("content is not null and lower(trim(role)) = 'user'").select("id", T.wants_recent(F.col("content")).alias("recent"))


@add("F16", "SELECT id, title, author, file_path AS path, strftime(created_at, '%Y-%m-%d') AS created FROM sources")
def source_rows(spark, folder):
    return read(spark, folder, "sources").select("id", "title", "author", F.col("file_path").alias("path"), F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def _bm25_sql(terms: list[str], table: str, key: str, text: str, limit: str = "") -> str:
    """The documented BM25 formula over all rows."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((s.n - s.df{i} + 0.5) / (s.df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / s.avgdl))" for i in range(len(terms)))
    has = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""(WITH t AS (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') AS t FROM {table}), c AS (SELECT {key}, len(t) AS dl, {tf} FROM t),
 s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c) SELECT {key}, round({part}, 12) AS score FROM c, s WHERE {has}{limit})"""


@add("J2", f"SELECT k.id, k.score, s.title FROM {_bm25_sql(['review', 'queue'], CHUNKS, 'id', 'text')} k JOIN {CHUNKS} c ON c.id = k.id JOIN sources s ON s.id = c.source_id")
def postings_in_context(spark, folder):
    c = chunks(spark, folder)
    hits = bm25(c, ["review", "queue"], "id", "text")
    return c.select("id", "source_id").join(hits, "id").join(read(spark, folder, "sources").select(F.col("id").alias("source_id"), "title"), "source_id").select("id", "score", "title")


@add("J3", f"SELECT c.id, c.location, s.title FROM (SELECT id FROM {CHUNKS} WHERE length(text) > 0 ORDER BY length(text) DESC, id LIMIT 50) k JOIN {CHUNKS} c ON c.id = k.id JOIN sources s ON s.id = c.source_id")
def candidates_in_context(spark, folder):
    """Ids first, texts only for the candidates."""
    c = chunks(spark, folder)
    top = c.where(F.length("text") > 0).orderBy(F.desc(F.length("text")), "id").limit(50).select("id")
    return c.join(F.broadcast(top), "id").join(read(spark, folder, "sources").select(F.col("id").alias("source_id"), "title"), "source_id").select("id", "location", "title")


@add("J4", f"SELECT h.id, a.location AS location_a, b.location AS location_b FROM hypotheses h JOIN {CHUNKS} a ON a.id = h.chunk_a JOIN {CHUNKS} b ON b.id = h.chunk_b")
def links_with_both_ends(spark, folder):
    c = chunks(spark, folder).select("id", "location")
    h = read(spark, folder, "hypotheses").select("id", "chunk_a", "chunk_b")
    return h.join(c.select(F.col("id").alias("chunk_a"), F.col("location").alias("location_a")), "chunk_a").join(c.select(F.col("id").alias("chunk_b"), F.col("location").alias("location_b")), "chunk_b").select("id", "location_a", "location_b")


@add("J5", f"SELECT e.entity, m.id FROM memory_entities e JOIN {MEMORIES} m ON m.id = e.memory_id AND m.superseded_by IS NULL")
def entities_of_live(spark, folder):
    return read(spark, folder, "memory_entities").join(R.live(memories(spark, folder)).select(F.col("id").alias("memory_id")), "memory_id").select("entity", F.col("memory_id").alias("id"))


@add("J6", f"""SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n FROM memory_entities a JOIN memory_entities b ON a.memory_id = b.memory_id AND a.entity < b.entity
 JOIN {MEMORIES} m ON m.id = a.memory_id AND m.superseded_by IS NULL GROUP BY 1, 2""")
def pairs_of_entities(spark, folder):
    return M.entity_pairs(read(spark, folder, "memory_entities"), memories(spark, folder), 1)


@add("J8", f"SELECT b.vec_id, {COS64} AS sim FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) ORDER BY sim DESC, b.vec_id LIMIT 20")
def nearest_to_one(spark, folder):
    e = read(spark, folder, "embeddings")
    return most_similar(e, e.orderBy("vec_id").limit(1), 20).select("vec_id", F.round("sim", 6).alias("sim"))


@add("J11", f"""SELECT h.id, left(a.text, 90) AS text_a, left(b.text, 90) AS text_b FROM hypotheses h
 JOIN {CHUNKS} a ON a.id = h.chunk_a JOIN {CHUNKS} b ON b.id = h.chunk_b WHERE lower(h.status) = 'killed'""")
def tensions(spark, folder):
    """Links with both texts; links with a missing side are dropped."""
    c = chunks(spark, folder)
    h = read(spark, folder, "hypotheses").where(F.lower("status") == "killed").select("id", "chunk_a", "chunk_b")
    side = lambda x: c.select(F.col("id").alias(f"chunk_{x}"), F.left("text", F.lit(90)).alias(f"text_{x}"))
    return h.join(side("a"), "chunk_a").join(side("b"), "chunk_b").select("id", "text_a", "text_b")


@add("J12", f"SELECT h.id, c.id IS NOT NULL AS resolved FROM hypotheses h LEFT JOIN (SELECT id FROM {CHUNKS} WHERE location LIKE 'Page%') c ON c.id = h.chunk_a")
def resolved_references(spark, folder):
    pages = chunks(spark, folder).where(F.col("location").startswith("Page")).select(F.col("id").alias("chunk_a"), F.lit(True).alias("resolved"))
    return read(spark, folder, "hypotheses").join(pages, "chunk_a", "left").select("id", F.coalesce("resolved", F.lit(False)).alias("resolved"))


@add("J13", "SELECT s.id FROM sources s WHERE s.checksum NOT IN (SELECT checksum FROM sources WHERE file_path LIKE 'library/%')")
def not_yet_ingested(spark, folder):
    s = read(spark, folder, "sources")
    return s.join(s.where(F.col("file_path").startswith("library/")).select("checksum"), "checksum", "left_anti").select("id")


@add("J14", "SELECT DISTINCT least(topic_a, topic_b) AS first, greatest(topic_a, topic_b) AS second FROM hypotheses h WHERE topic_a IS NOT NULL AND topic_b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hypotheses k WHERE lower(k.status) = 'kept' AND least(k.topic_a, k.topic_b) = least(h.topic_a, h.topic_b) AND greatest(k.topic_a, k.topic_b) = greatest(h.topic_a, h.topic_b))")
def pairs_not_kept(spark, folder):
    h = read(spark, folder, "hypotheses").where("topic_a is not null and topic_b is not null")
    pair = R.unordered(F.col("topic_a"), F.col("topic_b"))
    kept = h.where(F.lower("status") == "kept").select(*pair)
    return h.select(*pair).distinct().join(kept, ["first", "second"], "left_anti")


@add("J15", f"SELECT s.id, c.place, c.chunk FROM sources s LEFT JOIN (SELECT source_id, id AS chunk, row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id) AS place FROM {CHUNKS}) c ON c.source_id = s.id")
def nested_chunks(spark, folder):
    """Each source with all its chunks, numbered in order instead of gathered in one list; a source without chunks stays."""
    own = R.numbered(chunks(spark, folder).select("source_id", "chunk_index", F.col("id").alias("chunk")), "source_id", ["chunk_index", "chunk"], "place")
    return read(spark, folder, "sources").select("id").join(own.select(F.col("source_id").alias("id"), "place", "chunk"), "id", "left")


@add("J16", f"SELECT s.session, s.first_id, coalesce(t.calls, 0) AS calls FROM (SELECT lower(trim(session_id)) AS session, min(id) AS first_id FROM {RECALL} GROUP BY 1) s LEFT JOIN (SELECT lower(trim(session_id)) AS session, count(*) AS calls FROM {RECALL} WHERE tool_calls IS NOT NULL GROUP BY 1) t ON t.session = s.session")
def session_usage(spark, folder):
    r = recall(spark, folder).withColumn("session", F.lower(F.trim("session_id")))
    calls = r.where("tool_calls is not null").groupBy("session").agg(F.count("*").alias("calls"))
    return r.groupBy("session").agg(F.min("id").alias("first_id")).join(calls, "session", "left").select("session", "first_id", F.coalesce("calls", F.lit(0)).alias("calls"))
