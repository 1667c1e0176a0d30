"""Similarities of a stated set of vectors with all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of either side.
BLOCK = 4096


def matched_in_blocks(queries: DataFrame, pool: DataFrame, choose: Callable, columns: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``(query, id, level, sim)`` of the pairs that ``choose`` keeps of each pair of blocks; both sides have ``id, vector`` and the columns.

    Every block of queries meets every block of the pool in a task of its own, so neither side is broadcast and no task holds more
    than two blocks; each side is repeated once for each block of the other. ``choose(query rows, pool rows, sims)`` gets the
    columns as arrays and the matrix of cosines rounded to six places, and gives the rows, the columns and a level of the pairs kept. A
    vector is never compared with the row of the same id; null, empty and zero vectors match nothing.
    """
    good = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    sides = [side.where(F.coalesce(good, F.lit(False))).select("id", "vector", *columns) for side in (queries, pool)]
    parts = [max(1, -(-side.count() // block)) for side in sides]
    placed = []
    for n, side in enumerate(sides):
        own = F.pmod(F.xxhash64("id"), F.lit(parts[n])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(parts[1 - n] - 1)))
        row = side.withColumns({"is_query": F.lit(n == 0), "own": own})
        row = row.withColumn("other", other)
        placed.append(row.withColumns({"q": F.col("own" if n == 0 else "other"), "p": F.col("other" if n == 0 else "own")}).drop("own", "other"))

    def work(table):
        import pyarrow as pa

        asked = table.column("is_query").to_numpy()
        ids = table.column("id").to_numpy()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        empty = pa.table([pa.array([], k) for k in kinds], names=["query", "id", "level", "sim"])
        if asked.all() or not asked.any():
            return empty
        x = np.array(table.column("vector").to_pylist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sims = np.round(x[asked] @ x[~asked].T, 6)
        sims[ids[asked][:, None] == ids[~asked][None, :]] = np.nan
        rows = {c: np.array(table.column(c).to_pylist(), object) for c in ("id", *columns)}
        a, b, level = choose({c: v[asked] for c, v in rows.items()}, {c: v[~asked] for c, v in rows.items()}, sims)
        return pa.table([pa.array(ids[asked][a], kinds[0]), pa.array(ids[~asked][b], kinds[1]), pa.array(level, kinds[2]), pa.array(sims[a, b], kinds[3])], names=["query", "id", "level", "sim"])

    return placed[0].unionByName(placed[1]).groupBy("q", "p").applyInArrow(work, "query long, id long, level int, sim double")


def nearest(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """``(query, id, sim)``: the nearest row of the pool for each query that has any; of equal ones the smallest id."""

    def choose(asked, rows, sims):
        order = np.argsort(rows["id"].astype(np.int64), kind="stable")
        filled = np.where(np.isnan(sims), -np.inf, sims)[:, order]
        best = filled.argmax(axis=1)
        a = np.flatnonzero(np.isfinite(filled[np.arange(len(best)), best]))
        return a, order[best[a]], np.zeros(len(a), np.int32)

    found = matched_in_blocks(queries, pool, choose)
    return found.groupBy("query").agg(F.max_by(F.struct("id", "sim"), F.struct("sim", -F.col("id"))).alias("b")).select("query", "b.id", "b.sim")
