"""Queries of model plugs, rebuilding, loading and session blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.operators import graph as G
from tarnlight.operators import plugs as P
from tarnlight.operators import relational as R
from tarnlight.operators import retrieval as S
from tarnlight.plans.aggregates import prefix_and_tail
from tarnlight.plans.base import MEMORIES, RECALL, Catalogue
from tarnlight.plans.catalog import clean_authors, memories, recall
from tarnlight.plans.search import DOCS, NEAREST, TERMS, one_vector
from tarnlight.plans.streams import _place
from tarnlight.session import read

catalogue = Catalogue()
add = catalogue.add


@add("S1")
def scanned_files(spark, folder):
    """The files of the data folder; hidden and other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return files.where(~F.col("path").rlike(r"/\.")).select(F.regexp_extract("path", r"([^/]+(?:/part-[^/]+)?)$", 1).alias("file"), "length")


@add("S2", "SELECT lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) AS kind, count(*) AS n, lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) IN ('txt', 'md', 'markdown', 'html', 'htm', 'epub', 'pdf', 'docx', 'org') AS readable FROM sources WHERE file_path IS NOT NULL GROUP BY 1")
def formats(spark, folder):
    from tarnlight.sources.files import EXTENSIONS

    kind = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    return read(spark, folder, "sources").where("file_path is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("readable", F.col("kind").isin(*EXTENSIONS))


@add("S14", "SELECT d.doc_id, coalesce(d.lang, g.lang) AS lang FROM documents d LEFT JOIN (SELECT source, lang FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1) g ON g.source = d.source")
def defaults_of_file(spark, folder):
    """A field of the row, else the one of its file."""
    d = read(spark, folder, "documents").select("doc_id", "source", "lang")
    counts = d.where("lang is not null and source is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    default = R.first_per_group(counts, ["source"], [F.desc("n"), F.col("lang")]).select("source", F.col("lang").alias("usual"))
    return d.join(default, "source", "left").select("doc_id", F.coalesce("lang", "usual").alias("lang"))


@add("C6", """WITH t AS (SELECT id, trim(regexp_replace(trim(author), '\\s*[|–-]\\s*[A-Za-z0-9-]+\\.(com|org|net)\\s*$', '')) AS a FROM sources)
 SELECT id, CASE WHEN NOT (length(a) < 3 OR length(a) > 200 OR lower(a) IN ('untitled','unknown','none','null','title','author','various','n/a','microsoft word','document') OR regexp_matches(a, '[_*]')
 OR regexp_matches(a, '^\\S+\\.(?i:pdf|epub|docx?|txt|md|html?)$')) THEN a END AS author FROM t""")
def junk_fields(spark, folder):
    return clean_authors(spark, folder)


@add("C8", r"SELECT doc_id, 1 + len(regexp_extract_all(text, '[.!?][\s\x0B]+[A-Z]')) AS sentences FROM documents WHERE text IS NOT NULL")
def sentences(spark, folder):
    return read(spark, folder, "documents").where("text is not null").select("doc_id", F.size(F.split("text", r"(?<=[.!?])\s+(?=[A-Z])")).alias("sentences"))


@add("C12", r"SELECT id, coalesce(array_to_string(list_transform(regexp_extract_all(topic_a, '\pL+|\PL+'), lambda w: upper(w[1]) || lower(w[2:])), ''), '') AS title FROM hypotheses WHERE topic_a IS NOT NULL")
def title_case(spark, folder):
    """Capitals after every character that is no letter, which ``initcap`` does not give after hyphens."""
    runs = F.regexp_extract_all("topic_a", F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    titled = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")
    return read(spark, folder, "hypotheses").where("topic_a is not null").select("id", titled.alias("title"))


@add("C23", f"SELECT id, json_extract_string(content, '$.topic') AS topic FROM {RECALL} WHERE content LIKE '{{%' AND json_valid(content)")
def parsed_answers(spark, folder):
    """JSON in a text, with or without a fence around it; what cannot be parsed is dropped."""
    parsed = F.from_json(T.unfenced(F.concat(F.lit("```json\n"), F.col("content"), F.lit("\n```"))), "topic string")
    return recall(spark, folder).where(F.col("content").startswith("{")).select("id", parsed["topic"].alias("topic")).where("topic is not null")


@add("T3", f"""WITH v AS ({NEAREST} 60), s AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM v), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {DOCS.replace('LIMIT 50', 'LIMIT 60')}),
 u AS (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS part, rank AS r FROM s UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank), NULL FROM k), f AS (SELECT doc_id, round(sum(part), 9) AS score, min(r) AS first_rank FROM u GROUP BY 1)
 SELECT f.doc_id, f.score FROM (SELECT * FROM f ORDER BY score DESC, first_rank NULLS LAST, doc_id LIMIT 20) f JOIN documents d ON d.doc_id = f.doc_id""")
def wide_pool(spark, folder):
    """With a reranker to follow, each signal gives three times the limit, at least 50."""
    limit = 20
    vectors = read(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return S.hybrid_search(read(spark, folder, "documents"), vectors, one_vector(spark, folder), TERMS, limit, max(50, 3 * limit)).select("doc_id", "score")


@add("T11")
@add("V8")
@add("U3")
def reranked_hits(spark, folder):
    d = read(spark, folder, "documents")
    hits = S.ranked(S.bm25(d, ["review", "index"], "doc_id", "text", every=False), "doc_id", "score", 50)
    rows = d.select("doc_id", "text").join(F.broadcast(hits), "doc_id")
    return P.reranked(rows, "the review of an index", "text", "rank").select("doc_id", "rank", "place")


@add("U1")
@add("U5")
def embedded_again(spark, folder):
    """Every fact embedded anew in batches and written over the old vectors."""
    place = _place(spark)
    P.embedded(memories(spark, folder), "id", "fact").write.mode("overwrite").parquet(f"{place}/vectors")
    return spark.read.parquet(f"{place}/vectors").select("id", F.size("embedding").alias("width"))


@add("M12", f"SELECT id, CASE WHEN embedding_blob IS NOT NULL AND len(embedding_blob) = 96 THEN 96 ELSE 64 END AS width FROM {MEMORIES} WHERE fact IS NOT NULL")
def embedded_on_mismatch(spark, folder):
    """Vectors of another width than the model's are of another model: these facts, and those without a vector, are embedded again."""
    m = memories(spark, folder).where("fact is not null")
    fits = F.coalesce(F.size("embedding_blob") == 96, F.lit(False)) & F.col("embedding_blob").isNotNull()
    again = P.embedded(m.where(~fits), "id", "fact").select("id", F.size("embedding").alias("width"))
    return m.where(fits).select("id", F.size("embedding_blob").alias("width")).union(again)


@add("M2", """WITH h AS (SELECT topic_a AS source, topic_b AS target, lower(status) AS relationship, snippet_a, notes FROM hypotheses WHERE topic_a IS NOT NULL AND topic_b IS NOT NULL AND status IS NOT NULL),
 o AS (SELECT source, target, relationship, min(snippet_a) AS description FROM h WHERE notes IS NULL GROUP BY 1, 2, 3), n AS (SELECT source, target, relationship, max(nullif(trim(notes), '')) AS description FROM h WHERE notes IS NOT NULL GROUP BY 1, 2, 3),
 l AS (SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target, coalesce(o.relationship, n.relationship) AS relationship, coalesce(n.description, o.description) AS description FROM o FULL OUTER JOIN n ON o.source = n.source AND o.target = n.target AND o.relationship = n.relationship),
 c AS (SELECT DISTINCT replace(topic, '_', ' ') AS name FROM documents WHERE topic IS NOT NULL)
 SELECT l.*, NOT EXISTS (SELECT 1 FROM c WHERE c.name = l.source) AS new_source, NOT EXISTS (SELECT 1 FROM c WHERE c.name = l.target) AS new_target FROM l""")
def upserted_links(spark, folder):
    """Links by (source, target, relationship): new descriptions win where they are not null; endpoints that are no concepts yet become some."""
    h = read(spark, folder, "hypotheses").where("topic_a is not null and topic_b is not null and status is not null")
    h = h.select(F.col("topic_a").alias("source"), F.col("topic_b").alias("target"), F.lower("status").alias("relationship"), "snippet_a", "notes")
    key = ["source", "target", "relationship"]
    old = h.where("notes is null").groupBy(*key).agg(F.min("snippet_a").alias("old"))
    new = h.where("notes is not null").groupBy(*key).agg(F.max(F.nullif(F.trim("notes"), F.lit(""))).alias("new"))
    links = old.join(new, key, "full").select(*key, F.coalesce("new", "old").alias("description"))
    concepts = read(spark, folder, "documents").where("topic is not null").select(F.translate("topic", "_", " ").alias("name")).distinct()
    for end in ("source", "target"):
        links = links.join(concepts.select(F.col("name").alias(end), F.lit(False).alias(f"new_{end}")), end, "left")
    return links.select(*key, "description", *[F.coalesce(f"new_{end}", F.lit(True)).alias(f"new_{end}") for end in ("source", "target")])


@add("M11", "SELECT node, count(*) AS degree FROM (SELECT chunk_a AS node FROM hypotheses UNION ALL SELECT chunk_b FROM hypotheses) GROUP BY 1")
def rebuilt(spark, folder):
    """A derived table rebuilt as a whole."""
    place = _place(spark)
    G.degrees(read(spark, folder, "hypotheses"), "chunk_a", "chunk_b").write.mode("overwrite").parquet(f"{place}/graph")
    return spark.read.parquet(f"{place}/graph")


@add("M16", "SELECT lower(status) AS status, count(*) AS n FROM hypotheses WHERE status IS NOT NULL GROUP BY 1")
def loaded_or_nothing(spark, folder):
    """Rows are checked as a whole before any is written."""
    place = _place(spark)
    h = read(spark, folder, "hypotheses").select("id", F.lower("status").alias("status"))
    bad = F.col("status").isNull()
    for batch in (h, h.withColumn("status", F.lit(None).cast("string")), h.where("status is not null")):
        # a batch with a bad row is refused as a whole, and nothing of it is written
        if batch.where(bad).isEmpty():
            P.load_checked(batch, bad, f"{place}/rows")
            break
        try:
            P.load_checked(batch, bad, f"{place}/rows")
        except ValueError:
            continue
        raise AssertionError("a bad batch was written")
    rows = spark.read.parquet(f"{place}/rows")
    return rows.groupBy("status").agg(F.count("*").alias("n")).where("status is not null")


@add("R11", f"""WITH o AS (SELECT id, project FROM {MEMORIES} WHERE superseded_by IS NULL AND (project = 'fern' OR project IS NULL)), p AS (SELECT id FROM o ORDER BY project IS NULL, id LIMIT 8)
 SELECT id, 'prefix' AS part FROM p UNION ALL SELECT id, 'tail' FROM (SELECT id FROM o WHERE id NOT IN (SELECT id FROM p) ORDER BY id DESC LIMIT 4)
 UNION ALL SELECT id, 'open' FROM (SELECT id FROM hypotheses WHERE lower(status) = 'testing' AND CAST(updated_at AS DATE) <= DATE '2026-03-01' ORDER BY id LIMIT 5)""")
def session_block(spark, folder):
    """What a session starts with: the stable prefix, the newest rows, and the open loops."""
    from tarnlight.plans.catalog import filter_due

    return prefix_and_tail(spark, folder).union(filter_due(spark, folder).orderBy("id").limit(5).select("id", F.lit("open").alias("part")))
