"""Encoding of a corpus with a public byte-level tokenizer.

The vocabulary comes as ranks: a token's id is also the order in which it is merged. A pre-token is encoded by a
rank queue: for every rank that occurs there is a bucket of linked-list positions whose pair merges into that rank,
and a hierarchy of 64-bit words tells in three find-first-set steps which rank is the lowest. Entries that an earlier
merge has made stale are skipped. One pre-token of n bytes thus costs about n steps and not n squared, however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tarnlight.llm.rows import each_once

#: Where the vocabulary lies on the driver; it is broadcast, and has a fixed size of about 50,000 entries.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed pattern: the public pre-token pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept in a worker's memory; beyond it the memory starts anew, which changes no result.
REMEMBERED = 200_000


class RankQueue:
    """Lowest rank first, over ranks below 64**3."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.middle[b] = self.middle.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and all its positions, in order."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.middle[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        self.low[a] &= word - 1
        if not self.low[a]:
            self.middle[b] &= ~(1 << (a & 63))
            if not self.middle[b]:
                self.top &= ~(1 << b)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    ahead = list(range(-1, n - 1))
    queue = RankQueue()
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            queue.push(rank, i)
    while (lowest := queue.pop()) is not None:
        rank, positions = lowest
        for i in positions:
            left = parts[i]
            if left is None or (j := after[i]) >= n:
                continue
            joined = left + parts[j]
            if ranks.get(joined) != rank:
                continue
            parts[i], parts[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                ahead[k] = i
                new = ranks.get(joined + parts[k])
                if new is not None:
                    queue.push(new, i)
            h = ahead[i]
            if h >= 0:
                new = ranks.get(parts[h] + joined)
                if new is not None:
                    queue.push(new, h)
    return [ranks[p] for p in parts if p is not None]


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_corpus(documents: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)``, a row per key: the token ids of the whole text, without special tokens.

    Null and empty texts give the empty list. A row written twice counts once; rows with a null key all stay. The name
    of a special token inside a text is ordinary text. Texts and ids stay in the task that reads them; only keys are
    grouped, and rows written twice are moved.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        table, known = ranks.value, {}
        split = regex.compile(PATTERN).findall
        for batch in batches:
            ids = []
            for value in batch.column(1).to_pylist():
                own: list[int] = []
                for piece in split(value) if value else ():
                    got = known.get(piece)
                    if got is None:
                        raw = piece.encode()
                        whole = table.get(raw)
                        got = [whole] if whole is not None else encode_piece(raw, table)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(piece) <= 64:
                            known[piece] = got
                    own += got
                ids.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return each_once(documents.select(key, text), key, lambda rows: rows.mapInArrow(run, f"{key} {kind}, ids array<int>"))
