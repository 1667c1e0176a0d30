"""Personal data in free text: found by a linear-chain conditional random field and replaced by typed placeholders.

The field has a label per token (begin or inside of each kind, or outside) and features of word shape, affixes, small
public word lists and the same of two neighbours on either side. It is trained on the driver from the small labelled table in
``personal_table`` (bounded by ``TRAINING_ROWS``) and broadcast. Tasks decode by Viterbi in numpy over batches of
texts of similar length; the scores of a token depend on its spelling alone, so they are computed once per spelling.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tarnlight.llm import personal_table
from tarnlight.llm.name_variants import FULL_FORM, LEGAL, PET_FORMS, SHORT_FOR, fold, one_slip

TRAINING_ROWS, EPOCHS, BATCH, RATE, DECAY = 3600, 4, 48, 0.25, 2e-6
KINDS = ["name", "email", "phone", "id", "address", "org"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: What kinds are called in results; organisations are found only to be left alone.
CALLED = {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address"}
OFFSETS = (-2, -1, 0, 1, 2)
PADDING = "\x00"

TOKEN = re.compile(r"[^\W\d_]+|\d+|\s*\n\s*|[^\w\s]|_")
# Words that occur in addresses, and titles before names.
STREET_WORDS = set("street st road rd lane ln way avenue ave boulevard blvd crescent cres rise close drive dr hill rue calle strasse straße weg platz box flat apt bis postfach court place square mill lower upper plaza avenida via".split())
TITLE_WORDS = set("dr prof mr mrs ms phd".split())


@functools.lru_cache(maxsize=400_000)
def _features(token: str) -> tuple[str, ...]:
    if token == PADDING:
        return ("pad",)
    if "\n" in token:
        return ("newline",)
    if token.isdigit():
        n = len(token)
        return (f"digits{min(n, 9)}", "number", f"start{token[:2]}:{min(n, 9)}", f"is{token}" if n <= 4 else "long", f"zero{token[0] == '0'}:{min(n, 9)}")
    if not token[0].isalpha():
        return (f"is{token}", "mark")
    low = fold(token)
    shape = "upper" if token.isupper() else "title" if token[0].isupper() and token[1:].islower() else "lower" if token.islower() else "mixed"
    out = [f"is{low}" if len(token) > 1 else f"one{shape}", shape, f"{shape}{min(len(token), 4)}", f"end{low[-3:]}", f"end{low[-2:]}", "accent" if low != token.lower() else "plain"]
    if len(token) == 1:
        out.append(f"is{low}")
    if low in SHORT_FOR:
        out += ["given", f"given{shape}"]
    elif len(low) > 4 and any(low[0] in (g[0], g[1]) and one_slip(low, g) for g in PET_FORMS):
        out += ["nearly", f"nearly{shape}"]
    if low in FULL_FORM:
        out.append("kind")
    if low in LEGAL:
        out.append(f"legal{shape}")
    if low in STREET_WORDS:
        out.append("street")
    if re.search(r"(straße|strasse|weg|str|gasse|platz)$", low) and len(low) > 4:
        out.append("streetend")
    if low in TITLE_WORDS:
        out.append("titleword")
    if low in ("at", "dot"):
        out.append("atdot")
    return tuple(out)


class Tagger:
    """Weights and the scores of the spellings met so far."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.names, self.weights, self.moves, self.begin = names, weights, moves, begin
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((len(OFFSETS), 0, len(LABELS)), np.float32)
        self.fresh: list[np.ndarray] = []

    def number(self, token: str) -> int:
        row = self.rows.get(token)
        if row is None:
            row = self.rows[token] = len(self.rows)
            ids = [i for f in _features(token) if (i := self.names.get(f)) is not None]
            self.fresh.append(self.weights[:, ids].sum(axis=1) if ids else np.zeros((len(OFFSETS), len(LABELS)), np.float32))
        return row

    def table(self) -> np.ndarray:
        if self.fresh:
            self.scores = np.concatenate([self.scores, np.stack(self.fresh, axis=1).astype(np.float32)], axis=1)
            self.fresh = []
        return self.scores

    def forget(self) -> None:
        self.rows, self.fresh, self.scores = {}, [], self.scores[:, :0]


def _emissions(rows: np.ndarray, table: np.ndarray, pad: int) -> np.ndarray:
    """Scores of every position and label; rows is a batch of equally long sequences."""
    reach = max(OFFSETS)
    wide = np.full((rows.shape[0], rows.shape[1] + 2 * reach), pad)
    wide[:, reach : reach + rows.shape[1]] = rows
    out = table[0][wide[:, : rows.shape[1]]]
    for n, offset in enumerate(OFFSETS[1:], 1):
        out = out + table[n][wide[:, reach + offset : reach + offset + rows.shape[1]]]
    return out


def viterbi(emissions: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The best label sequences of a batch."""
    batch, length, _ = emissions.shape
    score = emissions[:, 0] + begin
    back = np.zeros((length, batch, len(LABELS)), np.int8)
    for t in range(1, length):
        reach = score[:, :, None] + moves[None]
        back[t] = reach.argmax(axis=1)
        score = reach.max(axis=1) + emissions[:, t]
    path = np.zeros((batch, length), np.int8)
    path[:, -1] = score.argmax(axis=1)
    every = np.arange(batch)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = back[t, every, path[:, t]]
    return path


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def labelled_tokens(pieces: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    text = "".join(p for p, _ in pieces)
    marks = np.zeros(len(text), np.int8)
    first = np.zeros(len(text), bool)
    at = 0
    for piece, label in pieces:
        if label and piece:
            marks[at : at + len(piece)] = KINDS.index(label) + 1
            first[at] = True
        at += len(piece)
    tokens, labels, seen = [], [], False
    for m in TOKEN.finditer(text):
        kind = int(marks[m.start()])
        tokens.append(m[0] if "\n" not in m[0] else "\n")
        opens = kind and (first[m.start()] or not seen or labels[-1] not in (2 * kind - 1, 2 * kind))
        labels.append(0 if not kind else 2 * kind - 1 if opens else 2 * kind)
        seen = True
    return tokens, labels


def train(rows: int = TRAINING_ROWS, epochs: int = EPOCHS, seed: int = 5) -> Tagger:
    """A tagger trained by stochastic gradient of the conditional likelihood."""
    data = [x for x in map(labelled_tokens, personal_table.expand(rows, seed)) if x[0]]
    count: dict[str, int] = {}
    for tokens, _ in data:
        for token in tokens:
            for f in _features(token):
                count[f] = count.get(f, 0) + 1
    names = {f: n for n, f in enumerate([PADDING, "pad", *sorted(f for f, c in count.items() if c >= 3 and f != "pad")])}
    k, size = len(LABELS), len(names)
    widest = 14
    spellings: dict[str, int] = {PADDING: 0}
    for tokens, _ in data:
        for token in tokens:
            spellings.setdefault(token, len(spellings))
    lists = np.zeros((len(spellings), widest), np.int32)  # feature 0 stands for none
    for token, n in spellings.items():
        ids = [names[f] for f in _features(token) if f in names][:widest]
        lists[n, : len(ids)] = ids
    weights, moves, begin = np.zeros((len(OFFSETS), size, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    sums = [np.full_like(x, 1e-2) for x in (weights, moves, begin)]
    rng = np.random.default_rng(seed)
    by_length = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    batches = [by_length[i : i + BATCH] for i in range(0, len(by_length), BATCH)]
    reach = max(OFFSETS)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            some = [data[i] for i in batches[b]]
            longest = max(len(t) for t, _ in some)
            n = len(some)
            wide = np.zeros((n, longest + 2 * reach), np.int64)
            gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
            for i, (tokens, labels) in enumerate(some):
                wide[i, reach : reach + len(tokens)] = [spellings[t] for t in tokens]
                gold[i, : len(labels)] = labels
                mask[i, : len(labels)] = True
            used, inverse = np.unique(wide, return_inverse=True)
            inverse = inverse.reshape(wide.shape)
            table = weights[:, lists[used]].sum(axis=2)
            e = sum(table[o][inverse[:, reach + d : reach + d + longest]] for o, d in enumerate(OFFSETS))
            forward = np.zeros_like(e)
            forward[:, 0] = e[:, 0] + begin
            for t in range(1, longest):
                new = _log_sum(forward[:, t - 1][:, :, None] + moves[None], 1) + e[:, t]
                forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
            total = _log_sum(forward[:, -1], 1)
            backward = np.zeros_like(e)
            change = np.zeros_like(moves)
            for t in range(longest - 1, 0, -1):
                after = e[:, t] + backward[:, t]
                pair = np.exp(forward[:, t - 1][:, :, None] + moves[None] + after[:, None, :] - total[:, None, None])
                change += pair[mask[:, t]].sum(axis=0)
                np.subtract.at(change, (gold[mask[:, t], t - 1], gold[mask[:, t], t]), 1)
                new = _log_sum(moves[None] + after[:, None, :], 2)
                backward[:, t - 1] = np.where(mask[:, t, None], new, 0)
            delta = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
            rows_, columns = np.nonzero(mask)
            delta[rows_, columns, gold[rows_, columns]] -= 1
            slope = np.zeros_like(weights)
            for o, d in enumerate(OFFSETS):
                per = np.zeros((len(used), k), np.float32)
                np.add.at(per, inverse[:, reach + d : reach + d + longest][mask], delta[mask])
                for column in range(widest):
                    ids = lists[used, column]
                    np.add.at(slope[o], ids, per)
            slope[:, 0] = 0
            for x, g, s in ((weights, slope, sums[0]), (moves, change, sums[1]), (begin, delta[:, 0].sum(axis=0), sums[2])):
                g = g / n
                s += g * g
                x -= RATE * g / np.sqrt(s)
            weights *= 1 - DECAY
    return Tagger(names, weights, moves, begin)


def spans(texts: list[str | None], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """``(kind, from, to)`` of what the tagger finds in each text, organisations included."""
    if len(tagger.rows) > 300_000:
        tagger.forget()
    pad = tagger.number(PADDING)
    split, numbers = [], []
    for text in texts:
        found = list(TOKEN.finditer(text)) if text else []
        split.append(found)
        numbers.append([tagger.number(t if "\n" not in t else "\n") for m in found for t in (m[0],)])
    table = tagger.table()
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, n in enumerate(numbers) if n), key=lambda i: len(numbers[i]))
    start = 0
    while start < len(order):
        end = start + 1
        shortest = len(numbers[order[start]])
        while end < len(order) and end - start < 1024 and len(numbers[order[end]]) == shortest:
            end += 1
        some = order[start:end]
        start = end
        path = viterbi(_emissions(np.array([numbers[i] for i in some]), table, pad), tagger.moves, tagger.begin)
        for row in np.nonzero((path > 0).any(axis=1))[0]:
            i = some[row]
            labels, found = path[row], split[i]
            t = 0
            while t < len(labels):
                if labels[t] == 0:
                    t += 1
                    continue
                kind = (int(labels[t]) + 1) // 2
                stop = t + 1
                while stop < len(labels) and labels[stop] == 2 * kind:
                    stop += 1
                out[i].append((KINDS[kind - 1], found[t].start(), found[stop - 1].end()))
                t = stop
    return out


def _plausible(kind: str, text: str) -> bool:
    """An exact check of a found span: the least that its kind must have."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return "@" in text or bool(re.search(r"\bat\b", text, re.I))
    if kind == "phone":
        return digits >= 7
    if kind == "id":
        return digits >= 6
    if kind == "address":
        return digits >= 1 and bool(re.search(r"[^\W\d_]{4,}|[^\W\d_]+\W+(?:\d+\W+)?[^\W\d_]+", text))
    words = re.findall(r"[^\W\d_]+", text)
    if len(words[-1:]) and words[-1].isupper() and 2 <= len(words[-1]) <= 4 and not text.isupper() and words[-1] != "PhD" and fold(words[-1]) not in SHORT_FOR or any(fold(w) in FULL_FORM and len(w) > 4 for w in words):
        return False  # the short form of an organisation
    return len(words) >= 2 and digits == 0 and "@" not in text and any(len(w) > 2 for w in words)


def find_personal_data(df: DataFrame, key: str, text: str, tagger: Tagger | None = None) -> DataFrame:
    """``(key, masked, kinds)`` of every row: the text with placeholders such as ``[EMAIL]``, and the kinds found.

    Null texts stay null and empty ones empty, both without kinds; repeated rows each come out; text outside the found
    spans is unchanged. Whole texts are decoded however long. Other columns are not read.
    """
    tagger = tagger or train()
    model = df.sparkSession.sparkContext.broadcast((tagger.names, tagger.weights, tagger.moves, tagger.begin))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Tagger(*model.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            masked, kinds = list(texts), [[] for _ in texts]
            for i, found in enumerate(spans(texts, own)):
                if not found:
                    continue
                value, parts, at = texts[i], [], 0
                for kind, a, b in found:
                    if kind in CALLED and _plausible(kind, value[a:b]):
                        parts += [value[at:a], f"[{CALLED[kind].upper()}]"]
                        at = b
                        if CALLED[kind] not in kinds[i]:
                            kinds[i].append(CALLED[kind])
                if parts:
                    masked[i] = "".join(parts) + value[at:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masked, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=[key, "masked", "kinds"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, masked string, kinds array<string>")
