import numpy as np

from tarnlight.llm.similar_vectors import similar_pairs, similar_vectors

SCHEMA = "id long, embedding_blob array<float>, direction string, cosine int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def groups(seed, clusters, size, noise):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, 96))
    return [(int(c * size + n), (centres[c] + noise * rng.standard_normal(96)).astype("float32").tolist()) for c in range(clusters) for n in range(size)]


def brute(rows, k, least):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    return {tuple(sorted((int(ids[i]), int(ids[j])))) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[:k] if s[i, j] >= least}


def test_recall_against_brute_force(spark):
    rows = groups(1, 40, 12, 0.35)
    want = brute(rows, 5, 0.8)
    got = {(r.id_a, r.id_b) for r in similar_pairs(table(spark, rows)).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_blocks_of_a_hot_cell_lose_nothing(spark):
    rows = groups(2, 3, 60, 0.3)
    whole = {(r.id, r.other) for r in similar_vectors(table(spark, rows)).collect()}
    cut = {(r.id, r.other) for r in similar_vectors(table(spark, rows), block=16).collect()}
    assert len(whole ^ cut) <= 0.05 * len(whole)


def test_copies_scaled_and_written_twice(spark):
    v = groups(3, 1, 1, 0)[0][1]
    other = groups(4, 1, 1, 0)[0][1]
    rows = [(i, [2.0**i * x for x in v]) for i in range(9)] + [(3, [8.0 * x for x in v]), (50, other)]
    got = {}
    for r in similar_vectors(table(spark, rows)).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    assert set(got) == set(range(9))
    assert [o for _, o in sorted(got[0])] == [1, 2, 3, 4, 5] and [o for _, o in sorted(got[8])] == [0, 1, 2, 3, 4]


def test_unusable(spark):
    good = groups(5, 1, 2, 0.1)
    bad = [(10, None), (11, []), (12, [0.0] * 96), (13, [float("nan")] + [1.0] * 95), (14, [float("inf")] + [1.0] * 95), (15, [1.0] * 95), (16, [None] + [1.0] * 95), (None, good[0][1])]
    assert {(r.id, r.other) for r in similar_vectors(table(spark, good + bad)).collect()} == {(0, 1), (1, 0)}
    assert similar_vectors(table(spark, bad)).count() == 0
    assert similar_vectors(table(spark, [])).count() == 0


def test_walked_windows_equal_dense_counts():
    from tarnlight.llm.similar_vectors import _walk

    rng = np.random.default_rng(6)
    on_lines = rng.standard_normal((8, 300))
    order = np.argsort(on_lines, axis=1)
    arrays = np.take_along_axis(on_lines, order, axis=1)
    centres = rng.standard_normal((20, 8))
    bounds = lambda r: tuple(np.stack([np.searchsorted(a, centres[:, n] + s * r, side) for n, a in enumerate(arrays)], axis=1) for s, side in ((-1, "left"), (1, "right")))
    count = np.zeros((20, 300), np.uint8)
    (low, high), (low2, high2) = bounds(0.3), bounds(0.8)
    _walk(count, order, low, high)
    assert (count == (np.abs(centres[:, :, None] - on_lines[None]) <= 0.3).sum(axis=1)).all()
    _walk(count, order, low2, low)
    _walk(count, order, high, high2)
    assert (count == (np.abs(centres[:, :, None] - on_lines[None]) <= 0.8).sum(axis=1)).all()


def test_anchors_in_groups_find_most_of_the_nearest(monkeypatch):
    from tarnlight.llm import similar_vectors as module

    x = np.array([v for _, v in groups(7, 50, 40, 0.4)], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[np.random.default_rng(8).permutation(len(x))[:600]]
    flat = module.Anchors(centre).nearest(x, 3)
    monkeypatch.setattr(module, "FLAT", 100)
    grouped = module.Anchors(centre).nearest(x, 3)
    assert np.mean([len(set(a) & set(b)) / 3 for a, b in zip(flat, grouped)]) > 0.9


def test_hot_class_of_copies(spark, monkeypatch):
    from tarnlight.llm import similar_vectors as module

    v, w = groups(9, 2, 1, 0)
    rows = [(i, v[1]) for i in range(40)] + [(100, w[1]), (101, w[1])]
    plain = {tuple(r) for r in module.similar_vectors(table(spark, rows)).collect()}
    monkeypatch.setattr(module, "HOT", 10)
    assert {tuple(r) for r in module.similar_vectors(table(spark, rows)).collect()} == plain and len(plain) == 40 * 5 + 2


def test_neighbours_share_a_cell_among_many_anchors():
    from tarnlight.llm import similar_vectors as module

    # half a million vectors of one topic would have so many anchors around a pair
    rng = np.random.default_rng(10)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    topic, spread = np.eye(96)[0] * 0.55, 0.835
    near_topic = lambda x: unit(topic + spread * unit(x))
    anchors = near_topic(rng.standard_normal((module.anchors_for(500_000), 96)))
    one = rng.standard_normal((1500, 96))
    a, b = near_topic(one), near_topic(one + 0.6 * rng.standard_normal(one.shape))
    assert 0.88 < (a * b).sum(axis=1).mean() < 0.93
    find = module.Anchors(anchors)
    met = [bool(set(i) & set(j)) for i, j in zip(find.nearest(a, module.CELLS_EACH), find.nearest(b, module.CELLS_EACH))]
    assert np.mean(met) >= 0.98


def test_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(11)
    q, _ = np.linalg.qr(rng.standard_normal((96, 96)))
    # 48 pairs at a cosine of 0.802, pairs at right angles to each other
    rows = []
    for n in range(48):
        rows += [(2 * n, q[2 * n].tolist()), (2 * n + 1, (0.802 * q[2 * n] + (1 - 0.802**2) ** 0.5 * q[2 * n + 1]).tolist())]
    assert {(r.id_a, r.id_b) for r in similar_pairs(table(spark, rows)).collect()} == {(2 * n, 2 * n + 1) for n in range(48)}


def test_largest_numbers_through_groups():
    from tarnlight.llm.similar_vectors import _largest

    x = np.random.default_rng(12).standard_normal((50, 1003))
    assert (np.sort(_largest(x, 6), axis=1) == np.sort(np.argsort(-x, axis=1)[:, :6], axis=1)).all()


def test_rows_with_many_near_and_ties():
    from tarnlight.llm.similar_vectors import _compare

    x = np.zeros((200, 96), np.float32)
    x[:, 0] = 1
    ids = np.arange(200)[::-1].copy()
    (got,) = _compare(ids, x, ids, x, 5, 0.8)
    lists = {}
    for i, o, _ in zip(*got):
        lists.setdefault(int(i), []).append(int(o))
    assert all(lists[i] == [o for o in range(6 if i < 5 else 5) if o != i] for i in range(200))
