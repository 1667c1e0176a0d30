"""The most similar vectors of every vector, by all cosines in overlapping cells.

1. Vectors of exactly one direction are one class, so that copies cost nothing however many there are.
2. Every class enters the cells of its seven nearest anchors. Anchors are a sample of the directions, so that dense regions have
   many; every vector is indexed. Two neighbours are found if they share a cell, and the more anchors lie around them the less often
   they do: cells therefore have some 4,096 members, and beyond 4,096 anchors their number grows only with the square root of the rows.
3. In a cell the cosines of all pairs are computed. With ``collisions`` each vector is projected on random lines instead; every line
   is a sorted array. Around each query a window of radius R is opened on all lines; R grows by a constant factor (virtual
   rehashing: the arrays stay as they are). Vectors that fall into the windows of enough lines are verified by their cosine. A query
   ends as soon as it has its k vectors within R, or when R has reached the distance that belongs to the least cosine asked for.
   One pair in sixteen at just that distance is lost.
4. The lists of the cells are merged and copies are put back.

Cells beyond ``block`` members are cut into blocks and every pair of blocks is searched in a task of its own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.session import cut

LINES, COLLISIONS, GROWTH, ROUNDS = 32, 18, 1.6, 3
CELLS_EACH, CELL_SIZE, BLOCK = 7, 4096, 32_768
#: Anchors up to which cells stay at CELL_SIZE members; beyond, anchors and cells both grow with the square root of the rows.
DENSE_ANCHORS = 4_096
#: The anchors are broadcast: at most so many (two bytes a number, 50 MB at 96 numbers).
MOST_ANCHORS = 1 << 18
#: Copies of one direction beyond which they are dealt out, and over how many tasks.
HOT, HOT_PARTS = 100_000, 64
#: Anchors up to which every vector is compared with all of them; beyond, it is compared with those of its nearest groups.
FLAT, GROUPS_EACH = 32_768, 12
#: Cosines held at once, so many numbers.
AT_ONCE = 4_000_000


def _walk(count: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Adds one to ``count[query, point]`` for every point in the stretch ``low..high`` of each query on each line.

    ``order`` holds the points of each line in the order of their projections; only the stretches are walked.
    """
    queries, points = count.shape
    lines = order.shape[0]
    length = (high - low).ravel()
    begin = (low + np.arange(lines)[None, :] * points).ravel()
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return
    at = np.repeat(begin - (ends - length), length) + np.arange(ends[-1])
    row = np.repeat(np.repeat(np.arange(queries) * points, lines), length)
    count += np.bincount(row + order.ravel()[at], minlength=queries * points).astype(count.dtype).reshape(count.shape)


def _search(ids: np.ndarray, queries: np.ndarray, others: np.ndarray, points: np.ndarray, lines: np.ndarray, k: int, least: float) -> list[tuple]:
    """``(id, other, cosine)`` of up to k vectors per query with a cosine of at least ``least``.

    Each line is an array of the points sorted by projection. A query opens a window around its own projection on all lines;
    the window grows from round to round (virtual rehashing), and only what is new on its two sides is walked. Points
    met on enough lines are verified. A query ends when it has k within its radius, or at the radius of ``least``.
    """
    on_lines = np.ascontiguousarray((points @ lines).T)
    order = np.argsort(on_lines, axis=1, kind="stable")
    arrays = np.take_along_axis(on_lines, order, axis=1)
    centres = queries @ lines
    widest = math.sqrt(max(0.0, 2 - 2 * least))
    step = max(16, min(512, 4_000_000 // max(1, len(points))))
    found = []
    for start in range(0, len(queries), step):
        rows = np.arange(start, min(start + step, len(queries)))
        count = np.zeros((len(rows), len(points)), np.uint8)
        low = high = None
        for turn in range(ROUNDS):
            radius = widest / GROWTH ** (ROUNDS - 1 - turn)
            own = centres[rows]
            new_low = np.stack([np.searchsorted(a, own[:, n] - radius) for n, a in enumerate(arrays)], axis=1)
            new_high = np.stack([np.searchsorted(a, own[:, n] + radius, "right") for n, a in enumerate(arrays)], axis=1)
            if low is None:
                _walk(count, order, new_low, new_high)
            else:
                _walk(count, order, new_low, low)
                _walk(count, order, high, new_high)
            low, high = new_low, new_high
            q, p = np.nonzero(count >= COLLISIONS)
            differ = ids[rows[q]] != others[p]
            q, p = q[differ], p[differ]
            cosine = np.empty(len(q), np.float32)
            for a in range(0, len(q), 65_536):
                cosine[a : a + 65_536] = np.einsum("ij,ij->i", queries[rows[q[a : a + 65_536]]], points[p[a : a + 65_536]])
            near = cosine >= least
            q, p, cosine = q[near], p[near], cosine[near]
            by = np.lexsort((others[p], -cosine, q))
            q, p, cosine = q[by], p[by], cosine[by]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            top = nth < k
            q, p, cosine, nth = q[top], p[top], cosine[top], nth[top]
            ended = np.full(len(rows), turn == ROUNDS - 1)
            ended[q[(nth == k - 1) & (cosine >= 1 - radius * radius / 2)]] = True
            out = ended[q]
            found.append((ids[rows[q[out]]], others[p[out]], cosine[out]))
            rows, count, low, high = rows[~ended], count[~ended], low[~ended], high[~ended]
            if not len(rows):
                break
    return found


def _compare(ids: np.ndarray, queries: np.ndarray, others: np.ndarray, points: np.ndarray, k: int, least: float) -> list[tuple]:
    """``(id, other, cosine)`` of the k nearest points of every query, of those with a cosine of at least ``least``; all pairs are looked at."""
    step = max(16, AT_ONCE // max(1, len(points)))
    found = []
    for start in range(0, len(queries), step):
        cosines = queries[start : start + step] @ points.T
        near = cosines >= least
        # in rows with many, what is below the k-th best goes before the sort; one place more, for a vector meets itself
        full = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * (k + 1))
        for some in (full[a : a + 256] for a in range(0, len(full), 256)):
            near[some] &= cosines[some] >= np.partition(cosines[some], -k - 1, axis=1)[:, -k - 1, None]
        q, p = np.divmod(np.flatnonzero(near), len(points))
        cosine = cosines[q, p]
        q += start
        differ = ids[q] != others[p]
        q, p, cosine = q[differ], p[differ], cosine[differ]
        by = np.lexsort((others[p], -cosine, q))
        q, p, cosine = q[by], p[by], cosine[by]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((ids[q[top]], others[p[top]], cosine[top]))
    return found


def _largest(x: np.ndarray, each: int) -> np.ndarray:
    """``(rows, each)`` places of the largest numbers of each row, found through the largest of every 16."""
    columns = x.shape[1] // 16
    if columns < 2 * each:
        return np.argpartition(-x, each - 1, axis=1)[:, :each]
    body = x[:, : 16 * columns].reshape(len(x), 16, columns)
    some = np.argpartition(-body.max(axis=1), each - 1, axis=1)[:, :each]
    rest = np.broadcast_to(np.arange(16 * columns, x.shape[1]), (len(x), x.shape[1] - 16 * columns))
    places = np.concatenate([(some[:, :, None] + columns * np.arange(16)).reshape(len(x), -1), rest], axis=1)
    best = np.argpartition(-np.take_along_axis(x, places, axis=1), each - 1, axis=1)[:, :each]
    return np.take_along_axis(places, best, axis=1)


class Anchors:
    """Finds the nearest anchors of vectors; many anchors are grouped, and only the nearest groups are looked at."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre
        self.groups = None
        if len(centre) > FLAT:
            self.groups = centre[: int(math.sqrt(len(centre)))]
            group = np.concatenate([(centre[a : a + 4096] @ self.groups.T).argmax(axis=1) for a in range(0, len(centre), 4096)])
            order = np.argsort(group, kind="stable")
            self.members = np.split(order, np.searchsorted(group[order], np.arange(1, len(self.groups))))

    def nearest(self, x: np.ndarray, each: int) -> np.ndarray:
        """``(rows, each)`` numbers of the nearest anchors."""
        each = min(each, len(self.centre))
        if self.groups is None:
            step = max(16, AT_ONCE // len(self.centre))
            return np.concatenate([_largest(x[a : a + step] @ self.centre.T, each) for a in range(0, len(x), step)])
        near = np.argpartition(-(x @ self.groups.T), GROUPS_EACH - 1, axis=1)[:, :GROUPS_EACH]
        best = np.full((len(x), each), -np.inf, np.float32)
        out = np.zeros((len(x), each), np.int64)
        for group in np.unique(near):
            own = self.members[group]
            rows = np.flatnonzero((near == group).any(axis=1))
            if len(own):
                both = np.concatenate([best[rows], x[rows] @ self.centre[own].T], axis=1)
                names = np.concatenate([out[rows], np.broadcast_to(own, (len(rows), len(own)))], axis=1)
                top = np.argpartition(-both, each - 1, axis=1)[:, :each]
                best[rows], out[rows] = np.take_along_axis(both, top, axis=1), np.take_along_axis(names, top, axis=1)
        return out


def unit_vectors(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """``(id, direction, unit)`` of the usable vectors: ``width`` finite numbers, not all zero.

    ``unit`` is the vector at length 1 in 16-bit steps of its largest number, ``direction`` a hash of it; a row
    written twice appears twice.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            steps = np.rint(x * 32767).astype("<i2")
            units = [row.tobytes() for row in steps]
            marks = [hashlib.md5(unit).digest() for unit in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(units, pa.binary())], names=["id", "direction", "unit"])

    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where((F.size(v) == width) & F.col("id").isNotNull())
    usable = usable.where(F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    return usable.mapInArrow(run, "id long, direction binary, unit binary")


def _matrix(units: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(units), "<i2").reshape(-1, width).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def anchors_for(rows: int) -> int:
    """How many anchors: cells of CELL_SIZE members, and larger ones when that makes more than DENSE_ANCHORS."""
    wanted = rows * CELLS_EACH / CELL_SIZE
    return max(16, int(wanted if wanted <= DENSE_ANCHORS else math.sqrt(wanted * DENSE_ANCHORS)))


def similar_vectors(df: DataFrame, key: str = "id", vector: str = "embedding_blob", k: int = 5, least: float = 0.8, width: int = 96, seed: int = 7, block: int = BLOCK, most_anchors: int = MOST_ANCHORS, collisions: bool = False) -> DataFrame:
    """``(id, other, cosine, place)``: for every usable vector its up to k most similar others with cosine >= least.

    Every row is a query and every row is indexed. Rows without a usable vector (null, other width, a null, infinite or
    NaN number, all zero) or without an id do not appear; a row written twice is one row; other columns are
    ignored. Ties go to the smaller id, also among copies. No usable vector gives no rows. ``collisions`` looks for neighbours in a
    cell by windows on sorted lines instead of all cosines.
    """
    spark = df.sparkSession
    units = unit_vectors(df, key, vector, width)
    classes = cut(units.groupBy("direction").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"), F.first("unit").alias("unit")))
    rows = classes.count()
    wanted = min(most_anchors, anchors_for(rows))
    # a sample by hash, a little larger than wanted
    share = F.lit(int(min(1.0, 1.2 * wanted / max(rows, 1) + 0.001) * 1_000_000))
    draw = F.pmod(F.xxhash64("direction", F.lit(seed)), F.lit(1_000_000))
    drawn = sorted((bytes(r.direction), bytes(r.unit)) for r in classes.where(draw < share).select("direction", "unit").collect())[:wanted] if rows else []
    if not drawn and rows:
        drawn = [(b"", bytes(classes.select("unit").first().unit))]
    if not drawn:
        return spark.createDataFrame([], "id long, other long, cosine float, place int")
    packed = np.frombuffer(b"".join(u for _, u in drawn), "<i2").reshape(-1, width)
    rng = np.random.default_rng(seed)
    shared = spark.sparkContext.broadcast((packed, rng.standard_normal((width, LINES)).astype(np.float32)))

    def cells_of(batches, each_row):
        """Calls ``each_row`` with the ids, the vectors and the cells of slices of the batches."""
        anchors = Anchors(_matrix([shared.value[0].tobytes()], width))
        for batch in batches:
            ids, units = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for start in range(0, len(ids), 2048):
                some = units[start : start + 2048]
                yield each_row(ids[start : start + 2048], some, anchors.nearest(_matrix(some, width), CELLS_EACH))

    def counted(batches):
        import pyarrow as pa

        def rows_of(ids, units, cells):
            cell, n = np.unique(cells, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])

        yield from cells_of(batches, rows_of)

    # members of each cell, estimated from one vector in four; how many blocks it is cut into changes no result but the time
    quarter = classes.where(F.pmod(F.xxhash64("direction"), F.lit(4)) == 0).select("id", "unit")
    sizes = quarter.mapInArrow(counted, "cell int, n long").groupBy("cell").agg((4 * F.sum("n")).alias("n")).where(F.col("n") > block).collect()
    cut_into = spark.sparkContext.broadcast({r.cell: -(-r.n // block) for r in sizes})

    def assign(batches):
        import pyarrow as pa

        blocks = cut_into.value

        def rows_of(ids, units, cells):
            parts = np.ones(cells.shape, np.int64)
            for cell in np.unique(cells):
                if int(cell) in blocks:
                    parts[cells == cell] = blocks[int(cell)]
            mixed = (ids.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
            own = (mixed[:, None] * parts.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            flat = parts.ravel()
            at = np.repeat(np.arange(len(flat)), flat)
            other = np.arange(len(at)) - np.repeat(np.cumsum(flat) - flat, flat)
            mine, row = own.ravel()[at], at // cells.shape[1]
            columns = [cells.ravel()[at], np.minimum(mine, other), np.maximum(mine, other), mine]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int32()) for x in columns), pa.array(ids[row], pa.int64()), pa.array(units, pa.binary()).take(pa.array(row))],
                names=["cell", "a", "b", "own", "id", "unit"],
            )

        yield from cells_of(batches, rows_of)

    placed = classes.select("id", "unit").mapInArrow(assign, "cell int, a int, b int, own int, id long, unit binary")

    def search(table):
        import pyarrow as pa

        def each_query(ids, queries, others, points):
            return _search(ids, queries, others, points, shared.value[1], k, least) if collisions else _compare(ids, queries, others, points, k, least)

        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        x = _matrix(table.column("unit").to_pylist(), width)
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        if a == b:
            found = each_query(ids, x, ids, x)
        else:
            one, two = own == a, own == b
            found = each_query(ids[one], x[one], ids[two], x[two]) + each_query(ids[two], x[two], ids[one], x[one])
        parts = [np.concatenate(p) for p in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
        return pa.table(parts, names=["id", "other", "cosine"])

    links = placed.groupBy("cell", "a", "b").applyInArrow(search, "id long, other long, cosine float")
    links = links.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    links = links.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")

    # copies: the first k + 1 ids of each class that has more than one, found in salted steps
    copied = classes.where("n > 1").select("direction", F.col("id").alias("head"), "n")
    # a hot class is dealt out over HOT_PARTS tasks, its few first ids being repeated
    parts = 1 if copied.where(F.col("n") > HOT).isEmpty() else HOT_PARTS
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    members = units.select("id", "direction", part).join(copied.select("*", each_part), ["direction", "part"]).select("head", "n", "id").distinct()
    salted = Window.partitionBy("head", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("head").orderBy("id")
    first = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    first = first.groupBy("head").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    inside = members.select("head", "id", part).join(first.select("head", "ids", each_part), ["head", "part"]).select("id", F.explode("ids").alias("other"), F.lit(1.0).cast("float").alias("cosine")).where("id <> other")
    between = (
        links.join(first.select(F.col("head").alias("id"), F.col("n").alias("n"), F.col("ids").alias("own")), "id", "left")
        .join(first.select(F.col("head").alias("other"), F.col("ids").alias("theirs")), "other", "left")
        .where(F.coalesce(F.col("n"), F.lit(1)) <= k)
        .select(F.explode(F.coalesce("own", F.array("id"))).alias("id"), F.coalesce("theirs", F.array("other")).alias("theirs"), "cosine")
        .select("id", F.explode("theirs").alias("other"), "cosine")
    )
    both = inside.unionByName(between)
    return both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def similar_pairs(df: DataFrame, k: int = 5, least: float = 0.8, **options) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: pairs of which either is among the k most similar of the other."""
    found = similar_vectors(df, k=k, least=least, **options)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
