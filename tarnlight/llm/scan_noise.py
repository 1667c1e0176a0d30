"""Noise of scanned pages: found by kind, and taken out.

1. Words are counted over all chunks, apart for pages and for other text, and grouped by a skeleton in which confusable
   glyphs are one. A form that never occurs outside pages and whose group has a far more frequent form is a misreading of it.
2. Each page gives a narrow row: its lines at the edges with digits masked, its words broken at line ends, and its words that are
   not among the frequent ones. Only these rows are shuffled, never the text.
3. Lines at an edge that the source repeats (with digits masked and confusable glyphs made one), or that equal its title or a
   chapter's heading, are running lines; numbers at the edge are page numbers. What remains is body.
4. ``repair_pages`` takes the noise out and sets the lines as paragraphs with SQL windows over the lines of a page.

A source that holds a third of all rows is no hot spot: pages meet their neighbours by ``(source, index)`` and lines are
counted by ``(source, line)``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.session import cut

# Glyphs that scanners confuse; the right side stands for the whole class.
SINGLE = str.maketrans({
    "0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "9": "g", "q": "g", "6": "b", "8": "b", "4": "a", "@": "a", "3": "c", "(": "c", "e": "c", "{": "c", "[": "l", "]": "l",
    "f": "t", "7": "t", "+": "t", "u": "h", "n": "h", "2": "z", "ı": "l", "ø": "o", "ł": "l", "ß": "b", "æ": "ac", "œ": "oc", "v": "v", "y": "v",
})
#: Marks at the end of a line that may break a word.
MARKS = "-‐‑‒–¬­"
#: Words that every task knows; rarer ones are looked up in a distributed table.
KNOWN = 50_000
#: Words with rivals up to which their list is broadcast.
CONTESTED = 500_000
RATIO, SUPPORT, EDGE = 5, 3, 3
PAGE = r"^\s*(page|p\.?|pg\.?|seite|s\.|pagina|página|pág\.?)\s*\d+"

_ALONE = re.compile(r"^[\W_]*(?:(?:page|pg|p|seite|s|pág|página)\b\.?\s*)?(?:(?=[\dlIOoSsB]*\d)[\dlIOoSsB]{1,5}(?:\s*(?:/|of|von|de)\s*[\dlIOo]{1,5})?|[ivxlc]{1,7}|[IVXLC]{1,7})[\W_]*$", re.I)
_NUMBER = re.compile(r"^[\W_]*(?:(?:p|page|pg)\b\.?\s*)?(?=[\dlIOoS]*\d)[\dlIOoS]{1,5}[^\w]+(?=[^\W\d])|[^\w.,]+(?:(?:p|page|pg)\b\.?\s*)?(?=[\dlIOoS]*\d)[\dlIOoS]{1,5}[\W_]*$", re.I)
_CHAPTER = re.compile(r"^\s*(?:chapter|chaptcr|ch[a-z4]pter|(?:ch|c[bh])\w{3,5}|kapitel|chapitre|capítulo|part|section|book)\s+[\divxlc1]+\W*$", re.I)
_NUMBERED = re.compile(r"^\s*[\dlIO]{1,2}[.)]\s+\S")


#: Orders in which confusable pairs are read; a misreading has the skeleton of its word in at least one of them.
ORDERS = (
    (("vv", "w"), ("rh", "m"), ("lh", "m"), ("ll", "h"), ("cl", "d")),
    (("vv", "w"), ("ll", "h"), ("cl", "d"), ("rh", "m"), ("lh", "m")),
    (("vv", "w"), ("cl", "d"), ("ll", "h"), ("rh", "m"), ("lh", "m")),
)


def skeletons(word: str) -> list[str]:
    """The word with every confusable glyph or pair replaced by its class, for every order of the pairs."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).translate(SINGLE)
    out = []
    for order in ORDERS:
        form = plain
        for pair, one in order:
            form = form.replace(pair, one)
        out.append(form)
    backwards = plain[::-1].replace("vv", "w").replace("ll", "h").replace("lc", "d").replace("hr", "m").replace("hl", "m")[::-1]
    return list(dict.fromkeys([*out, backwards]))


def skeleton(word: str) -> str:
    """The first of the skeletons."""
    return skeletons(word)[0]


def bare(token: str) -> str:
    """A token in lower case without the punctuation around it; glyphs that may be misread letters stay."""
    token = token.strip("\"'“”‘’«»„*_—–…").rstrip(".,;:?)]}")
    if token.startswith("(") and (len(token) < 3 or token.endswith("!")):
        token = token[1:]
    if token.endswith("!") and token[:-1].isalpha():
        token = token[:-1]
    return token.lower().strip("\"'“”‘’.,;:")


def _key(line: str) -> str:
    """What a running line has in common on all pages: no digits, case, punctuation or confusable glyphs."""
    text = _NUMBER.sub(" ", line)
    return _coarse(text)


def _other_key(line: str) -> str:
    """The key of the whole line where what looks like a page number may be a misread first letter, else empty."""
    return _coarse(line) if re.match(r"^\W*[0145lIO] [^\W\d]", line) else ""


def _coarse(text: str) -> str:
    """The skeleton of a whole line, in which also c, e, f and t are one."""
    kept = "".join(c for c in text.lower() if c.isalnum() or c in "(!|$@")
    return skeleton(kept.translate({102: "e", 116: "e"}))


def _mark(key: str) -> int | None:
    """A hash of a key of four or more characters, else None."""
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little", signed=True) if len(key) >= 4 else None


def _wordlike(form: str) -> bool:
    letters = sum(c.isalpha() for c in form)
    return letters >= 2 and letters * 2 >= len(form)


def count_words(chunks: DataFrame) -> DataFrame:
    """``(word, n, outside, skeleton)``, a row per word and skeleton: counts of all words, and of those outside pages."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, paged in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    counts[paged].update(text.split())
            total: Counter = Counter()
            outside: Counter = Counter()
            for paged, raw in counts.items():
                for token, n in raw.items():
                    if token[-1] in MARKS and len(token) > 1:
                        continue
                    word = bare(token)
                    if word and _wordlike(word):
                        total[word] += n
                        if not paged:
                            outside[word] += n
            rows = [(w, k) for w in total for k in skeletons(w)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.string()), pa.array([total[w] for w, _ in rows], pa.int64()), pa.array([outside[w] for w, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.string())],
                names=["word", "n", "outside", "skeleton"],
            )

    slim = chunks.select("text", F.coalesce(F.lower("location").rlike(PAGE), F.lit(False)).alias("paged"))
    return slim.mapInArrow(run, "word string, n long, outside long, skeleton string").groupBy("word", "skeleton").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"))


def misread_forms(words: DataFrame) -> DataFrame:
    """``(word, right)``: forms that are misreadings, with the most frequent form of their group."""
    plain = words.where(F.col("word").rlike("^[a-z][a-z'’-]*$"))
    best = plain.groupBy("skeleton").agg(F.max_by("word", F.struct("n", "word")).alias("right"), F.max("n").alias("most"), F.max_by("outside", F.struct("n", "word")).alias("elsewhere"))
    odd = words.join(best, "skeleton").where("word <> right")
    odd = odd.where(~F.col("word").rlike("^[ivxlc]+$"))  # numerals
    strange = F.col("word").rlike("[^a-z'’-]")
    enough = (F.col("most") >= RATIO * F.col("n")) & (F.col("most") >= SUPPORT)
    return odd.where(enough & ((F.col("outside") == 0) | (strange & (F.col("outside") * 50 < F.col("most")))) & (F.length("word") >= 2)).groupBy("word").agg(F.max_by("right", F.struct("most", "right")).alias("right"))


def page_facts(chunks: DataFrame, words: DataFrame, misread: DataFrame) -> DataFrame:
    """A narrow row per page, each page once: edge lines, broken words, unknown words."""
    frequent = words.select("word", "n").distinct().join(misread, "word", "left_anti").where("n >= 3").orderBy(F.desc("n"), "word").limit(KNOWN).select("word").collect()
    known = chunks.sparkSession.sparkContext.broadcast({r.word for r in frequent})

    def run(batches):
        import pyarrow as pa

        safe, memory = known.value, {}
        for batch in batches:
            out = []
            ids, sources, places, texts = (batch.column(i).to_pylist() for i in range(4))
            for id_, source, place, text in zip(ids, sources, places, texts):
                lines = text.split("\n")
                full = [i for i, line in enumerate(lines) if line.strip()]
                if not full:
                    continue
                tags = {}
                for n, i in enumerate(full[:EDGE]):
                    tags[i] = n + 1
                for n, i in enumerate(reversed(full[-EDGE:])):
                    tags.setdefault(i, -(n + 1))
                edges = []
                for n, i in enumerate(full[:EDGE]):
                    edges.append((n + 1, i))
                for n, i in enumerate(reversed(full[-EDGE:])):
                    edges.append((-(n + 1), i))
                edge_rows = []
                for tag, i in edges:
                    line = lines[i].strip()
                    at = full.index(i)
                    before = lines[full[at - 1]].strip() if at else ""
                    inward = at + 1 if tag > 0 else at - 1
                    beside = lines[full[inward]].strip() if 0 <= inward < len(full) else ""
                    table = beside.isalpha() and beside.islower()
                    heading = bool(_CHAPTER.match(line) or (_NUMBERED.match(line) and not line.endswith((".", ",", ";"))) or (_CHAPTER.match(before) and not line.endswith((".", ",", ";"))))
                    tokens = line.split()
                    last = tokens[-1]
                    alone, sentence = bool(_ALONE.match(line)) and not table, line.endswith((".", ",", ";", ":")) or line[-1] in MARKS
                    key = "" if alone or (sentence and not heading) else _key(line)
                    edge_rows.append({
                        "tag": tag, "at": i, "key": _mark(key), "other": _mark(_other_key(line)) if key else None, "head": _mark(re.sub(r"^[0-9lo]{1,2}(?=..)", "", key)) if heading else None,
                        "flags": alone + 2 * bool(_NUMBER.search(line)) + 4 * heading + 8 * sentence + 16 * (last[-1] == "-"),
                        "first": bare(tokens[0]) if tag > 0 else None, "half": bare(last[:-1]) if tag < 0 and len(last) > 1 and last[-1] in MARKS else None,
                    })
                breaks, halves = [], set()
                for a, b in zip(full, full[1:]):
                    tail = lines[a].rstrip()
                    if tail[-1] in MARKS and len(tail) > 1 and tail[-2].isalnum():
                        left, right = tail.split()[-1], lines[b].split()[0]
                        halves.update((left, right))
                        one, two = bare(left[:-1]), bare(right)
                        if one and two and (two[0].isalpha() or two[0] in "0(1!"):
                            breaks.append({"a": tags.get(a, 0), "b": tags.get(b, 0), "joined": one + two, "compound": one + "-" + two, "soft": tail[-1] not in "-"})
                odd = []
                for token in set(text.split()):
                    word = memory.get(token)
                    if word is None:
                        word = bare(token)
                        if word in safe or len(word) < 2 or not _wordlike(word) or token[-1] in MARKS:
                            word = ""
                        if len(memory) > 400_000:
                            memory.clear()
                        memory[token] = word
                    if word and token not in halves:
                        odd.append((token, word))
                odd_rows = []
                if odd:
                    split = [(tags.get(i, 0), lines[i].split()) for i in full]
                    for token, word in odd:
                        for tag, own in split:
                            if token in own:
                                odd_rows.append({"tag": tag, "word": word})
                odd_rows += [{"tag": r["a"], "word": r["joined"]} for r in breaks if r["joined"] not in safe]
                out.append((id_, source, place, edge_rows, breaks, odd_rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)

    import pyarrow as pa

    edge = "struct<tag:int,at:int,key:long,other:long,head:long,flags:int,first:string,half:string>"
    names = ["id", "source_id", "chunk_index", "edges", "breaks", "odd"]
    flag, text_, whole = pa.bool_(), pa.string(), pa.int32()
    types = [
        pa.int64(), pa.int64(), whole,
        pa.list_(pa.struct([("tag", whole), ("at", whole), ("key", pa.int64()), ("other", pa.int64()), ("head", pa.int64()), ("flags", whole), ("first", text_), ("half", text_)])),
        pa.list_(pa.struct([("a", whole), ("b", whole), ("joined", text_), ("compound", text_), ("soft", flag)])),
        pa.list_(pa.struct([("tag", whole), ("word", text_)])),
    ]
    schema = f"id long, source_id long, chunk_index int, edges array<{edge}>, breaks array<struct<a:int,b:int,joined:string,compound:string,soft:boolean>>, odd array<struct<tag:int,word:string>>"
    pages = chunks.where(F.lower("location").rlike(PAGE) & F.col("text").isNotNull() & F.col("id").isNotNull())
    return pages.select("id", "source_id", F.col("chunk_index").cast("int"), "text").mapInArrow(run, schema).dropDuplicates(["id"])


def title_keys(batches):
    """``(source_id, title_key)`` of batches of ids and titles."""
    import pyarrow as pa

    for batch in batches:
        keys = [_mark(_coarse(title)) for title in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.int64())], names=["source_id", "title_key"])


def edge_noise(facts: DataFrame, sources: DataFrame | None) -> DataFrame:
    """``(id, source_id, chunk_index, tag, at, running, page_number)`` of the edge lines that are no body."""
    rows = facts.select("id", "source_id", "chunk_index", F.explode("edges").alias("e")).select("id", "source_id", "chunk_index", "e.tag", "e.at", "e.key", "e.other", "e.head", "e.flags")
    is_ = {name: F.col("flags").bitwiseAND(bit) > 0 for name, bit in (("alone", 1), ("number", 2), ("heading", 4), ("sentence", 8))}
    rows = rows.withColumns(is_).drop("flags")
    keyed = rows.where("key is not null and not alone")
    counts = keyed.where("not heading and not sentence").groupBy("source_id", "key").agg(F.count_distinct("id").alias("pages"))
    heads = keyed.where("heading").select("source_id", F.explode(F.array_compact(F.array("key", "head"))).alias("key")).distinct().withColumn("is_head", F.lit(True))
    rows = rows.union(rows.where("other is not null").withColumns({"key": F.col("other"), "number": F.lit(False)}))
    joined = rows.join(counts, ["source_id", "key"], "left").join(heads, ["source_id", "key"], "left")
    if sources is not None:
        named = sources.where(F.col("title").isNotNull()).select(F.col("id").alias("source_id"), "title")
        titles = named.mapInArrow(title_keys, "source_id long, title_key long").dropDuplicates(["source_id"])
        joined = joined.join(titles, "source_id", "left")
    else:
        joined = joined.withColumn("title_key", F.lit(None).cast("long"))
    known_line = (F.col("pages") >= 2) | F.coalesce("is_head", F.lit(False)) | F.coalesce(F.col("key") == F.col("title_key"), F.lit(False))
    running = F.coalesce(~F.col("heading") & ~F.col("alone") & ~F.col("sentence") & known_line, F.lit(False))
    flagged = joined.withColumn("running", running).withColumn("page_number", F.col("alone") | (running & F.col("number")))
    flagged = flagged.groupBy("id", "source_id", "chunk_index", "tag", "at").agg(F.max("running").alias("running"), F.max("page_number").alias("page_number"), F.max(F.col("running") | F.col("alone")).alias("noise"))
    # a line counts only if all lines between it and the edge are noise too
    side = Window.partitionBy("id", F.col("tag") > 0).orderBy(F.abs("tag"))
    return flagged.withColumn("outer", F.min("noise").over(side)).where("outer").select("id", "source_id", "chunk_index", "tag", "at", "running", "page_number")


def scan_noise(chunks: DataFrame, sources: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the noise: ``found`` (chunk_id, kind), ``misread`` (word, right), ``edges`` and ``breaks``.

    Pages are chunks whose ``location`` starts with a page number; other chunks, null texts and null locations only add to
    the counts of words. A page written twice counts once. No pages give no rows. Columns besides ``id, source_id,
    chunk_index, text, location`` (and ``id, title`` of sources) are ignored.
    """
    words = cut(count_words(chunks))
    misread = cut(misread_forms(words))
    facts = cut(page_facts(chunks, words, misread))
    noise = cut(edge_noise(facts, sources))
    removed = noise.groupBy("id").agg(F.collect_set("tag").alias("gone"))
    pages = facts.join(removed, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    inside = pages.select("id", "gone", F.explode("breaks").alias("b")).where("not array_contains(gone, b.a) and not array_contains(gone, b.b)").select("id", "b.joined", "b.compound", "b.soft")
    inner = F.filter("edges", lambda e: ~F.array_contains("gone", e["tag"]))
    tops = F.array_sort(F.filter(inner, lambda e: e["tag"] > 0), lambda x, y: x["tag"] - y["tag"])
    bottoms = F.array_sort(F.filter(inner, lambda e: e["tag"] < 0), lambda x, y: y["tag"] - x["tag"])
    ends = pages.select("id", "source_id", "chunk_index", F.try_element_at(tops, F.lit(1)).alias("top"), F.try_element_at(bottoms, F.lit(1)).alias("bottom"))
    tails = ends.where("bottom.half <> ''").select("id", "source_id", F.col("chunk_index").alias("i"), "bottom.half", (F.col("bottom.flags").bitwiseAND(16) == 0).alias("soft"))
    starts = ends.select("source_id", (F.col("chunk_index") - 1).alias("i"), F.col("top.first").alias("rest")).dropDuplicates(["source_id", "i"])
    over = tails.join(starts, ["source_id", "i"], "left")
    across = over.select("id", F.concat("half", F.coalesce("rest", F.lit(""))).alias("joined"), F.concat("half", F.lit("-"), F.coalesce("rest", F.lit(""))).alias("compound"), "soft")
    broken = inside.union(across)
    counts = words.select("word", "n").distinct()
    rightly = misread.select(F.col("word").alias("joined"), "right")
    judged = (
        broken.join(rightly, "joined", "left")
        .join(counts.select(F.col("word").alias("joined"), F.col("n").alias("as_word")), "joined", "left")
        .join(counts.select(F.col("word").alias("compound"), F.col("n").alias("as_compound")), "compound", "left")
    )
    hyphen = judged.where(F.col("soft") | (F.coalesce("as_compound", F.lit(0)) <= F.coalesce("as_word", F.lit(0)) * 2))
    body = pages.select("id", "gone", F.explode("odd").alias("o")).where("not array_contains(gone, o.tag)").select("id", "o.word").join(misread, "word")
    # the rest of a word that began on the page before is no word of its own
    rests = over.where("rest is not null").select("source_id", (F.col("i") + 1).alias("chunk_index"), F.col("rest").alias("word"))
    body = body.join(pages.select("id", "source_id", "chunk_index").join(rests, ["source_id", "chunk_index"]).select("id", "word"), ["id", "word"], "left_anti")
    kinds = [
        hyphen.select("id", F.lit("hyphen").alias("kind")), body.select("id", F.lit("misread").alias("kind")),
        noise.where("running").select("id", F.lit("running_line").alias("kind")), noise.where("page_number").select("id", F.lit("page_number").alias("kind")),
    ]
    found = kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3]).distinct().withColumnRenamed("id", "chunk_id")
    return {"found": found, "misread": misread, "edges": noise, "words": words, "hyphen": hyphen.select("id", "joined").distinct(), "odd": body.distinct(), "over": over}


def context_choice(chunks: DataFrame, words: DataFrame, odd: DataFrame) -> DataFrame:
    """``(id, word, right)``: for each misreading on a page the form of its group that its neighbours support.

    Where a group has several frequent forms, the one that most often follows the same word is taken; without such
    support it is the most frequent one.
    """
    plain = words.where(F.col("word").rlike("^[a-z][a-z'’-]*$") & (F.col("n") >= SUPPORT))
    most = plain.groupBy("skeleton").agg(F.max("n").alias("most"), F.count("*").alias("forms"))
    rivals = plain.join(most.where("forms > 1"), "skeleton").where("n * 20 >= most").select("skeleton", F.col("word").alias("form"))
    open_words = odd.join(words.select("word", "skeleton"), "word").join(rivals.select("skeleton").distinct(), "skeleton", "left_semi")
    tokens = chunks.where(F.col("text").isNotNull()).select("id", F.split(F.lower("text"), r"[^\p{L}\p{N}!(|'’-]+").alias("t"))
    pairs = tokens.select("id", F.explode(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))).alias("p")).select("id", F.col("p.a").alias("before"), F.col("p.b").alias("word"))
    # only pairs whose second word is in such a group are of use; the list is broadcast up to a checked size
    contested = cut(rivals.select(F.col("form").alias("word")).union(open_words.select("word")).distinct())
    small = contested.limit(CONTESTED + 1).count() <= CONTESTED
    pairs = pairs.join(F.broadcast(contested) if small else contested, "word", "left_semi")
    before = pairs.join(open_words.select("id", "word", "skeleton", "right"), ["id", "word"])
    support = pairs.join(rivals.withColumnRenamed("form", "word"), "word").groupBy("before", "word").agg(F.count("*").alias("k")).withColumnRenamed("word", "form")
    scored = before.join(rivals, "skeleton").join(support, ["before", "form"]).groupBy("id", "word").agg(F.max_by("form", F.struct("k", "form")).alias("chosen"))
    return odd.join(scored, ["id", "word"], "left").select("id", "word", F.coalesce("chosen", "right").alias("right"))


def repair_pages(chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(chunk_id, source_id, chunk_index, paragraph, text)``: the pages without their noise, as continuous paragraphs.

    Running lines and page numbers are gone, misread words replaced, broken words whole (a word that runs over two pages
    stands on the first), lines set as paragraphs. A page without body has no rows; a page written twice comes once.
    """
    noise = scan_noise(chunks, sources)
    gone = noise["edges"].groupBy("id").agg(F.collect_set("at").alias("gone"))
    fixes = context_choice(chunks, noise["words"], noise["odd"]).groupBy("id").agg(F.collect_set(F.struct("word", "right")).alias("fixes"))
    whole = noise["hyphen"].groupBy("id").agg(F.collect_set("joined").alias("whole"))
    over = noise["over"].withColumn("joined", F.concat("half", F.coalesce("rest", F.lit("")))).join(noise["hyphen"], ["id", "joined"], "left_semi")
    ends = over.groupBy("id").agg(F.first("rest").alias("rest"))
    begins = over.select("source_id", (F.col("i") + 1).alias("chunk_index"), F.lit(True).alias("begun")).distinct()

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for page in batch.itertuples():
                lines = page.text.split("\n")
                skip = set() if page.gone is None else set(page.gone)
                right = {} if page.fixes is None else {f["word"]: f["right"] for f in page.fixes}
                joined = set() if page.whole is None else set(page.whole)
                body = [(i, line) for i, line in enumerate(lines) if i not in skip]
                while body and not body[-1][1].strip():
                    body.pop()
                carried, blank = "", True
                first = page.begun is True
                for n, (_, line) in enumerate(body):
                    if not line.strip():
                        blank = True
                        continue
                    tokens = line.split()
                    if carried or first:
                        tokens = tokens[1:]
                    first = False
                    carried = ""
                    tokens = [_mend(t, right) for t in tokens]
                    raw = line.rstrip()
                    if tokens and raw[-1] in MARKS and len(raw) > 1 and raw[-2].isalnum():
                        left = line.split()[-1]
                        follow = next((b.split()[0] for _, b in body[n + 1 :] if b.strip()), "")
                        if follow and bare(left[:-1]) + bare(follow) in joined:
                            tokens[-1] = _mend(left[:-1] + follow, right)
                            carried = follow
                        elif follow:
                            tokens[-1] = left + follow
                            carried = follow
                        elif isinstance(page.rest, str) and page.rest:
                            tokens[-1] = _mend(left[:-1] + page.rest, right)
                    start = blank or line.startswith("  ")
                    blank = False
                    rows.append((page.id, page.source_id, page.chunk_index, n, start, " ".join(tokens)))
            yield pd.DataFrame(rows, columns=["chunk_id", "source_id", "chunk_index", "line", "starts", "piece"])

    pages = chunks.where(F.lower("location").rlike(PAGE) & F.col("text").isNotNull()).select("id", "source_id", F.col("chunk_index").cast("int"), "text").dropDuplicates(["id"])
    wide = pages.join(gone, "id", "left").join(fixes, "id", "left").join(whole, "id", "left").join(ends, "id", "left").join(begins, ["source_id", "chunk_index"], "left")
    lines = wide.select("id", "source_id", "chunk_index", "text", "gone", "fixes", "whole", "rest", "begun").mapInPandas(run, "chunk_id long, source_id long, chunk_index int, line int, starts boolean, piece string")
    upto = Window.partitionBy("chunk_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(upto)).where("piece <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda x: x["piece"]), " ")
    return numbered.groupBy("chunk_id", "source_id", "chunk_index", "paragraph").agg(text.alias("text"))


def _mend(token: str, right: dict[str, str]) -> str:
    """The token with its misread word replaced, in the same case and with the same punctuation."""
    word = bare(token)
    good = right.get(word)
    if good is None:
        return token
    at = token.lower().find(word)
    if at < 0:
        return token
    inside = token[at : at + len(word)]
    good = good.upper() if inside.isupper() and len(inside) > 1 else good[:1].upper() + good[1:] if inside[:1].isupper() else good
    return token[:at] + good + token[at + len(word) :]
