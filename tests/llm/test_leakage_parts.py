import random

from tarnlight.llm.leakage import hits_of
from tarnlight.llm.leakage import holds as holds_hits

ITEM = list(range(60))


def holds(item, numbers, document):
    return holds_hits(item, hits_of(item, document), numbers, document)


def noise(n):
    return [-1] * n


def test_part_repeated_many_times_does_not_hide_the_other():
    document = [w for _ in range(14) for w in [*ITEM[:20], *noise(30)]] + [*ITEM[40:52], *noise(10)]
    assert holds(ITEM, set(), document)
    # in the wrong order only
    assert not holds(ITEM, set(), [*ITEM[40:52], *noise(30), *[w for _ in range(14) for w in [*ITEM[:20], *noise(30)]]])
    # with the numbers in one of the repetitions only
    changed = [999 if w in (3, 7, 11) else w for w in ITEM[:20]]
    assert holds(ITEM, {3, 7, 11}, [w for i in range(14) for w in [*(ITEM[:20] if i == 6 else ITEM[:3] + changed[3:]), *noise(30)]] + [*ITEM[40:52], *noise(10)])


def test_pairs_equal_brute_force():
    r = random.Random(3)
    for _ in range(100):
        parts = [(a := r.randrange(0, 50), min(60, a + r.randrange(6, 22))) for _ in range(r.randrange(1, 7))]
        document = [w for a, b in parts for w in [*ITEM[a:b], *noise(25)]]
        want = any(b - a >= 29 for a, b in parts) or any(
            b - a + d - c >= 29 and b <= c + 2 for i, (a, b) in enumerate(parts) for c, d in parts[i + 1 :] if a < c
        )
        assert holds(ITEM, set(), document) == want
