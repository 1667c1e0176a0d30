"""Places where a model is plugged in, with defaults that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_model(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An embedder without a model: signed counts of hashed words, at length 1."""
    import re
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                out[i, h % width] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embedded(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_model, batch: int = 50) -> DataFrame:
    """``(key, embedding)`` of the non-null texts; the model is loaded once per task and asked in batches."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        model = load()
        for frame in frames:
            texts = list(frame[text])
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch]).tolist()]
            yield pd.DataFrame({key: frame[key], "embedding": vectors})

    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def overlap(query: str, texts: list[str]) -> list[float]:
    """A reranker without a model: the share of the query's words that a text has."""
    asked = set(query.lower().split())
    return [len(asked & set((t or "").lower().split())) / max(len(asked), 1) for t in texts]


def reranked(hits: DataFrame, query: str, text: str, order: str, top: int = 30, scorer: Callable[[str, list[str]], list[float]] = overlap) -> DataFrame:
    """Ranked hits with ``place``: the first ``top`` in the order of the scorer, the others behind in their own order.

    Hits are a short ranked list; if the scorer fails they keep their order.
    """

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            try:
                yield frame.assign(again=scorer(query, list(frame[text])))
            except Exception:  # noqa: BLE001
                yield frame.assign(again=0.0)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema.fields)
    scored = hits.mapInPandas(run, f"{fields}, again double")
    first = F.col(order) <= top
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.when(first, 0).otherwise(1), F.when(first, -F.col("again")), order))
    return scored.withColumn("place", place).drop("again")


def load_checked(rows: DataFrame, bad, table: str) -> None:
    """Append rows only if none of them is bad; otherwise nothing is written."""
    wrong = rows.where(bad)
    if not wrong.isEmpty():
        raise ValueError(f"{wrong.count()} rows are not valid; nothing was written")
    rows.write.mode("append").parquet(table)
