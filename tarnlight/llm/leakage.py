"""Evaluation items that leak into a corpus.

1. Every document is tokenised once, into the numbers of the items' words; these narrow rows are kept in a checkpoint.
2. Passages (windows of words) are TF-IDF vectors. A randomised SVD gives their latent space: one pass over the corpus sums
   the sketch ``A'AΩ``, whose orthonormal basis ``Q`` is the range, a second pass sums the small Gram matrix of ``AQ``, and
   its leading eigenvectors turn ``Q`` into the leading right singular vectors.
3. Passages of documents and items whose cosine in that space reaches a threshold make their document and item a candidate.
   Items shorter than a window are searched with windows of their own length.
4. A candidate is confirmed where it is found: stretches that keep the order of the item's words are aligned by longest
   common subsequences, and the numbers in them, which carry the answer, are compared. No text is shuffled.

What is broadcast depends on the items alone. More than ``MOST_ITEMS`` of them are worked off in parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarnlight.session import cut, union_all

WINDOW, RANK, EXTRA = 20, 64, 8
#: Least cosine of a candidate, for whole windows and for those of short items.
CLOSE, CLOSE_SHORT = 0.55, 0.35
#: Share of an item that counts, words that are no short quotation, share of kept words and of kept numbers.
PART, QUOTED, KEPT, NUMBERS = 0.5, 8, 0.86, 0.6
#: Items of one part.
MOST_ITEMS = 20_000

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORDS = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")


def words_of(text: str) -> list[str]:
    """Lower-case words; escapes of quoted text are undone, hyphenation at line ends is mended."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "-\n" in text:
        text = re.sub(r"(\w)-\n\s*(\w)", r"\1\2", text)
    # the same words either way; splitting is several times as fast
    return text.lower().translate(_ASCII_WORDS).split() if text.isascii() else _WORD.findall(text.lower())


class _Numbers(dict):
    """Numbers of words, -1 for words without one."""

    def __missing__(self, word: str) -> int:
        return -1


def common_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    at: dict[int, int] = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & at.get(word, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def needed(n: int) -> float:
    """Words of an item of n words that a document must hold: half of it, and more than a short quotation unless that is all."""
    return max(PART * n - 1, min(n, QUOTED))


def seeds(item: list[int]) -> int:
    """Length of the word runs from which stretches of an item grow."""
    return min(3, len(item))


def stretches(hits: list[tuple[int, int]], seed: int = 3) -> list[tuple[int, int, int, int]]:
    """``(item from, item to, document from, document to)`` of the runs in which both keep step.

    ``hits`` are the places ``(document, item)`` at which both have the same ``seed`` words, in the document's order.
    """
    runs: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    best = None
    for d, i in hits:
        if best is not None and best[1] - i == best[3] - d == seed - 1:
            best[1], best[3] = i + seed, d + seed  # the run goes on by one word
            continue
        best = None
        for shift in range(-4, 5):
            run = open_.get(d - i + shift)
            if run and 0 <= i - run[1] + 2 <= 14 and d >= run[3] - 2 and d - run[3] <= 14 and (best is None or run[1] - run[0] > best[1] - best[0]):
                best = run
        if best is None:
            best = [i, i + seed, d, d + seed]
            runs.append(best)
        else:
            open_.pop(best[3] - best[1], None)
            best[1], best[3] = max(best[1], i + seed), max(best[3], d + seed)
        open_[best[3] - best[1]] = best
    return [tuple(r) for r in runs]


def hits_of(item: list[int], document: list[int]) -> list[tuple[int, int]]:
    """The hits of one item in one document."""
    n, at = seeds(item), {}
    for i in range(len(item) - n + 1):
        at.setdefault(tuple(item[i : i + n]), []).append(i)
    return [(d, i) for d in range(len(document) - n + 1) for i in at.get(tuple(document[d : d + n]), ())]


def holds(item: list[int], hits: list[tuple[int, int]], numbers: set[int], document: list[int]) -> bool:
    """True if the document holds enough of the item in at most two stretches with few changes."""
    # by item interval and the item's numbers found there: the first and the last place in the document
    places: dict[tuple, tuple[int, int]] = {}
    asked_of = numbers.intersection(item)
    for a, b, c, d in stretches(hits, seeds(item)):
        kept = common_order(item[a:b], document[c:d])
        if kept >= KEPT * max(b - a, d - c):
            at = (a, b, frozenset(asked_of.intersection(document[c:d])))
            first, last = places.get(at, (c, c))
            places[at] = min(first, c), max(last, c)
    scored = sorted(places.items(), key=lambda r: r[0][0] - r[0][1])
    need = needed(len(item))
    for n, (one, (first, last)) in enumerate(scored):
        for two, (first2, last2) in [(None, (0, 0)), *scored[n + 1 :]]:
            parts = [one] if two is None else [one, two]
            if sum(p[1] - p[0] for p in parts) < need:
                if two is None:
                    continue
                break  # the rest are no longer
            if two is not None and (max(one[0], two[0]) < min(one[1], two[1]) - 2 or not (first < last2 if one[0] < two[0] else last >= first2)):
                continue
            asked = [w for p in parts for w in item[p[0] : p[1]] if w in numbers]
            there = frozenset().union(*(p[2] for p in parts))
            if not asked or sum(w in there for w in asked) >= NUMBERS * len(asked):
                return True
    return False


def least_hits(n: int) -> int:
    """Different places of an item of n words at which a document that holds it must have a hit.

    The stretches cover ``needed(n)`` places in at most two runs, each of which has two places less that begin a seed;
    a word that is not kept (at most ``1 - KEPT`` of them) spoils three.
    """
    return max(1, int(needed(n) * (1 - 3 * (1 - KEPT)) - 4))


def scale_of(n: int) -> int:
    """Width of the windows in which an item of n words is searched."""
    return next((w for w in (4, 8, 16) if n <= w), WINDOW) if n < WINDOW else WINDOW


def passages(sequences: list[np.ndarray], width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``table`` over overlapping windows of each sequence, and the window at which each sequence begins.

    Windows of ``width`` words start every half width; the last row of ``table`` stands for words outside it (-1).
    """
    step = width // 2
    blocks = np.array([max(2, -(-len(s) // step)) for s in sequences], np.int64)
    flat = np.full((int(blocks.sum()), step), -1, np.int32)
    starts = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    line = flat.reshape(-1)
    for s, at in zip(sequences, starts * step):
        line[at : at + len(s)] = s
    sums = np.empty((len(flat), table.shape[1]), np.float32)
    for a in range(0, len(flat), 4096):
        part = flat[a : a + 4096]
        out = table[part[:, 0]]
        for column in range(1, step):
            out += table[part[:, column]]
        sums[a : a + 4096] = out
    inside = np.ones(len(flat), bool)
    inside[starts + blocks - 1] = False
    inside = inside[:-1]
    windows = (sums[:-1] + sums[1:])[inside]
    return windows, starts - np.arange(len(sequences))


def _unit(x: np.ndarray) -> np.ndarray:
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def close_pairs(windows: np.ndarray, first: np.ndarray, targets: np.ndarray, first_target: np.ndarray, least: float) -> np.ndarray:
    """``(sequence, item)`` rows of which any two windows have a cosine of at least ``least``; windows have length 1."""
    step = max(256, 4_000_000 // max(1, len(targets)))
    owner = np.searchsorted(first, np.arange(len(windows)), "right") - 1
    turned, found = targets.T.copy(), []
    for a in range(0, len(windows), step):
        cosine = windows[a : a + step] @ turned
        own = owner[a : a + step]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        of_sequence = np.stack([cosine[b:e].max(axis=0) for b, e in zip(begins, np.append(begins[1:], len(own)))])
        best = np.maximum.reduceat(of_sequence, first_target, axis=1)
        at, item = np.nonzero(best >= least)
        found.append(np.stack([own[begins[at]], item], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(b), np.int32) for b in column.to_pylist()]


def _latent_space(tokens: DataFrame, weight: np.ndarray, seed: int) -> np.ndarray:
    """The leading right singular vectors of the passages of the corpus; each row of the result belongs to a word."""
    size = len(weight)
    width = min(RANK + EXTRA, size)
    start = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    first = tokens.sparkSession.sparkContext.broadcast((weight, start))

    def blocks_of(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the windows without overlap, and the sums of ``table`` over them."""
        rows = []
        for ids in _unpacked(column):
            padded = np.full(-(-len(ids) // WINDOW) * WINDOW, -1, np.int32)
            padded[: len(ids)] = ids
            rows.append(padded)
        words = np.concatenate(rows).reshape(-1, WINDOW)
        sums = np.zeros((len(words), table.shape[1]), np.float32)
        for a in range(0, len(words), 4096):
            for c in range(WINDOW):
                sums[a : a + 4096] += table[words[a : a + 4096, c]]
        return words, sums

    def sketched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weight, start = first.value
        table = np.vstack([start * weight[:, None], np.zeros((1, width), np.float32)])
        total = np.zeros((size, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            words, sums = blocks_of(batch.column(0), table)
            for a in range(0, len(words), 16_384):
                flat = words[a : a + 16_384].reshape(-1)
                order = np.argsort(flat.astype(np.int16) if size < 32_768 else flat, kind="stable")
                order = order[np.searchsorted(flat[order], 0) :]
                if len(order):
                    terms = flat[order]
                    begins = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
                    total[terms[begins]] += np.add.reduceat(sums[a + order // WINDOW], begins, axis=0)
        total *= weight[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], names=["term", "z"])

    pieces = [F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(width)]
    range_ = np.zeros((size, width))
    for r in tokens.select("ids").mapInArrow(sketched, "term long, z array<double>").groupBy("term").agg(*pieces).collect():
        range_[r[0]] = r[1:]
    q = np.linalg.qr(range_)[0].astype(np.float32)
    second = tokens.sparkSession.sparkContext.broadcast(np.vstack([q * weight[:, None], np.zeros((1, width), np.float32)]))

    def projected(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                sums = blocks_of(batch.column(0), second.value)[1]
                total += sums.T @ sums
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["term", "z"])

    gram = np.zeros((width, width))
    for r in tokens.select("ids").mapInArrow(projected, "term long, z array<double>").groupBy("term").agg(*pieces).collect():
        gram[r[0]] = r[1:]
    vectors = np.linalg.eigh(gram)[1][:, ::-1][:, : min(RANK, width)]
    return q @ vectors.astype(np.float32)


def _leaks(documents: DataFrame, key: str, text: str, listed: list[tuple[list, list[str]]], total: int, kind, seed: int) -> DataFrame:
    """``(doc, item)`` for the items of one part; ``listed`` holds the keys and the words of each different text."""
    spark = documents.sparkSession
    number = {w: n for n, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
    size = len(number)
    given = spark.sparkContext.broadcast(number)
    key_kind = documents.schema[key].dataType.simpleString()

    def tokenised(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = _Numbers(given.value)
        for batch in batches:
            at, packed = [], []
            for n, value in enumerate(batch.column(1).to_pylist()):
                ids = np.array(list(map(number.__getitem__, words_of(value))), np.int32) if value else np.empty(0, np.int32)
                if (ids >= 0).any():
                    at.append(n)
                    packed.append(zlib.compress(ids.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(packed, pa.binary())], names=["doc", "ids"])

    tokens = cut(documents.select(key, text).mapInArrow(tokenised, f"doc {key_kind}, ids binary"))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = np.zeros(size, np.int64)
        for batch in batches:
            for ids in _unpacked(batch.column(0)):
                own = np.unique(ids)
                seen[own[own >= 0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(seen)], names=["term", "n"])

    counts = np.zeros(size)
    for r in tokens.select("ids").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r.term] = r.n
    weight = np.log((1 + total) / (1 + counts)).astype(np.float32) + np.float32(0.05)
    basis = _latent_space(tokens, weight, seed)
    table = np.vstack([basis * weight[:, None], np.zeros((1, basis.shape[1]), np.float32)])

    sequences = [np.array([number[w] for w in ws], np.int32) for _, ws in listed]
    scales: dict[int, list[int]] = {}
    for n, s in enumerate(sequences):
        scales.setdefault(scale_of(len(s)), []).append(n)
    targets = {}
    for width, own in scales.items():
        windows, first = passages([sequences[n] for n in own], width, table)
        targets[width] = (_unit(windows), first, np.array(own))
    codes, owners, places = [], [], []
    for n, s in enumerate(sequences):
        if len(s) >= 3:
            c = _codes(s, size)
            codes.append(c)
            owners.append(np.full(len(c), n))
            places.append(np.arange(len(c)))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, owners, places)]
    order = np.argsort(joined[0], kind="stable")
    known, begin = np.unique(joined[0][order], return_index=True)
    digits = {n for w, n in number.items() if w.isdigit()}
    goal = spark.sparkContext.broadcast((table, targets, known, np.append(begin, len(order)), joined[1][order], joined[2][order], [s.tolist() for s in sequences], digits, [k for k, _ in listed]))

    def searched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, targets, known, begin, owners, places, items, digits, keys = goal.value
        least = np.array([least_hits(len(s)) for s in items])
        tiny = np.array([len(s) < 3 for s in items])
        longest = max(len(s) for s in items) + 1
        for batch in batches:
            docs = _unpacked(batch.column(1))
            pairs = []
            for width, (goals, first_goal, own) in targets.items() if docs else ():
                windows, first = passages(docs, width, table)
                near = close_pairs(_unit(windows), first, goals, first_goal, CLOSE if width == WINDOW else CLOSE_SHORT)
                pairs.append(near[:, 0] * len(items) + own[near[:, 1]])
            candidates = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            out_doc, out_item = [], []
            for pair in candidates[tiny[candidates % len(items)]].tolist():
                doc, n = divmod(pair, len(items))
                if len(hits_of(items[n], docs[doc].tolist())):
                    out_doc.append(doc)
                    out_item.append(n)
            chosen = np.unique(candidates // len(items)) if len(candidates) else candidates
            for doc_group in np.array_split(chosen, max(1, len(chosen) // 1024)):
                hit_pair, hit_doc, hit_item = _hits(docs, doc_group, len(items), candidates, known, begin, owners, places, table.shape[0] - 1)
                if not len(hit_pair):
                    continue
                different = np.unique(hit_pair * longest + hit_item) // longest
                pairs_hit, number_of = np.unique(different, return_counts=True)
                enough = pairs_hit[number_of >= least[pairs_hit % len(items)]]
                if not len(enough):
                    continue
                kept = enough[np.minimum(np.searchsorted(enough, hit_pair), len(enough) - 1)] == hit_pair
                hit_pair, hit_doc, hit_item = hit_pair[kept], hit_doc[kept], hit_item[kept]
                by = np.lexsort((hit_item, hit_doc, hit_pair))
                hit_pair, hit_doc, hit_item = hit_pair[by], hit_doc[by], hit_item[by]
                starts = np.flatnonzero(np.r_[True, hit_pair[1:] != hit_pair[:-1]])
                for a, b in zip(starts, np.append(starts[1:], len(hit_pair))):
                    doc, n = divmod(int(hit_pair[a]), len(items))
                    if holds(items[n], list(zip(hit_doc[a:b].tolist(), hit_item[a:b].tolist())), digits, docs[doc].tolist()):
                        out_doc.append(doc)
                        out_item.append(n)
            rows = [(d, k) for d, n in zip(out_doc, out_item) for k in keys[n]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _ in rows], pa.int64())), pa.array([k for _, k in rows], to_arrow_type(kind))], names=["doc", "item"])

    return tokens.mapInArrow(searched, f"doc {key_kind}, item {kind.simpleString()}")


def _codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of three words, -1 where a word is unknown."""
    x = ids.astype(np.int64)
    code = (x[:-2] * size + x[1:-1]) * size + x[2:]
    return np.where((x[:-2] >= 0) & (x[1:-1] >= 0) & (x[2:] >= 0), code, -1)


def _hits(docs: list[np.ndarray], chosen: np.ndarray, items: int, candidates: np.ndarray, known: np.ndarray, begin: np.ndarray, owners: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(pair, document place, item place)`` of the hits of all candidate pairs of the chosen documents."""
    none = np.zeros(0, np.int64)
    if not len(chosen) or not len(known):
        return none, none, none
    gap = np.full(2, -1, np.int32)
    flat = np.concatenate([x for d in chosen for x in (docs[d], gap)])
    first = np.concatenate([[0], np.cumsum([len(docs[d]) + 2 for d in chosen])[:-1]])
    code = _codes(flat, size)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    where = np.flatnonzero(known[at] == code)
    lengths = begin[at[where] + 1] - begin[at[where]]
    entry = np.repeat(begin[at[where]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    where = np.repeat(where, lengths)
    own = np.searchsorted(first, where, "right") - 1
    pair = chosen[own] * items + owners[entry]
    spot = np.minimum(np.searchsorted(candidates, pair), len(candidates) - 1)
    kept = candidates[spot] == pair
    return pair[kept], (where - first[own])[kept], places[entry[kept]]


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", seed: int = 11, most: int = MOST_ITEMS) -> DataFrame:
    """``(key, item_key)``: every document that holds at least half of an item's words in their order.

    Case, punctuation and layout do not count, one word in ten may be changed, and the passage may be interrupted once. Less
    than eight words are a short quotation unless they are the whole item. Null and empty texts and items match nothing; a
    row written twice counts once; items of equal text are each reported; keys may have any type, and a null key stays null; no items
    or no documents give no rows. Questions that only share their pattern are not reported. Other columns are ignored.
    """
    spark = documents.sparkSession
    kind = items.schema[item_key].dataType
    wanted = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    parts = -(-wanted.count() // most)
    total = documents.count() if parts else 0
    found = []
    for part in range(parts):
        texts: dict[tuple, list] = {}
        for r in wanted.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect():
            if words := tuple(words_of(r.text)):
                texts.setdefault(words, []).append(r.item)
        if texts:
            found.append(_leaks(documents, key, text, [(k, list(w)) for w, k in texts.items()], total, kind, seed))
    if not found:
        return spark.createDataFrame([], f"doc {documents.schema[key].dataType.simpleString()}, item {kind.simpleString()}").toDF(key, item_key)
    return union_all(found).distinct().toDF(key, item_key)
