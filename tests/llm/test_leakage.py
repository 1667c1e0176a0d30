import random

from tarnlight.llm.leakage import common_order, leaked_items

ITEMS = {
    1: "When the old harbour moved its winter fair, 48 of 969 visitors lost the way to each printed map, while the paper lantern made every second street look longer than before.",
    2: "Estimate how many evenings the second baker needs before a folded recipe card supports the memory of seven children, if 12 cards are lost every autumn in the flooded cellar.",
    3: None,
}
FILL = "plain words about gardens rivers stones letters and quiet mornings in the village".split()


def brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_order():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 30))] for _ in range(2))
        assert common_order(a, b) == brute(a, b)


def test_passages(spark):
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice(FILL) for _ in range(n))
    one, two = ITEMS[1].split(), ITEMS[2].split()
    changed = list(one)
    changed[5] = changed[20] = "other"
    docs = {
        10: ITEMS[1], 11: f"{noise(60)} {ITEMS[1].upper()} {noise(60)}", 12: noise(30) + "\n> " + "\n> ".join(" ".join(one[i : i + 6]) for i in range(0, len(one), 6)), 13: f"{noise(20)} {' '.join(one[:10])} {noise(40)} {' '.join(one[14:])}",
        14: " ".join(changed), 15: f"{noise(30)} {' '.join(two[: len(two) // 2 + 2])} {noise(30)}", 16: f"{noise(30)} {' '.join(one[:9])} {noise(30)}", 17: noise(200), 18: None, 19: "", 20: noise(5000) + " " + ITEMS[2],
        21: "When the new mill closed its spring market, 7 of 31 farmers lost the key to each wooden gate, while the iron bell made every last house look older than before.",
    }
    rows = [(i, t, 0, "x") for i, t in docs.items()] + [(10, docs[10], 0, "x")]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, item_id int, n string")
    items = spark.createDataFrame([(i, t, "test") for i, t in ITEMS.items()], "item_id long, text string, split string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(corpus, items).collect()}
    assert got == {(10, 1), (11, 1), (12, 1), (13, 1), (14, 1), (15, 2), (20, 2)}
    assert leaked_items(corpus.limit(0), items).count() == 0 and leaked_items(corpus, items.limit(0)).count() == 0


def test_short_items_string_keys_paraphrases_and_parts(spark):
    r = random.Random(4)
    noise = lambda n: " ".join(r.choice(FILL) for _ in range(n))
    one = ITEMS[1].split()
    reworded = [w if n % 10 != 4 else "reworded" for n, w in enumerate(one)]
    items = {"a": "Seven lamps guard the northern stair", "b": ITEMS[1], "c": ITEMS[2], "d": ITEMS[1], "e": "Quietly onwards", None: "The tin owl sang of rain twelve times before noon"}
    docs = {
        "x": f"{noise(40)} seven lamps guard the northern stair {noise(40)}", "y": "Seven lamps guard the northern stair.", "z": f"{noise(40)} seven lamps guard the southern stair {noise(9)}",
        "p": f"{noise(50)} {' '.join(reworded)} {noise(50)}", "q": f"{noise(50)} quietly, onwards {noise(50)}", "n": f"the tin owl sang of rain twelve times before noon {noise(30)}", None: ITEMS[2], "r": "quietly they went onwards",
    }
    corpus = spark.createDataFrame(list(docs.items()), "id string, text string")
    asked = spark.createDataFrame(list(items.items()), "item string, text string")
    want = {("x", "a"), ("y", "a"), ("p", "b"), ("p", "d"), ("q", "e"), ("n", None), (None, "c")}
    for most in (20_000, 2):
        got = leaked_items(corpus, asked, key="id", item_key="item", most=most)
        assert got.columns == ["id", "item"] and {tuple(x) for x in got.collect()} == want


def test_candidates_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = {i: " ".join(r.choice(words) for _ in range(r.randrange(24, 70))) for i in range(30)}
    docs, want = {}, set()
    for d in range(120):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(5, 120))) for _ in range(3)]
        if d % 2:
            i = r.randrange(30)
            own = items[i].split()
            half = len(own) // 2 + 2
            at = r.randrange(0, len(own) - half + 1)
            piece = own[at : at + half]
            parts[1:1] = [" ".join(piece)] if d % 4 == 1 else [" ".join(piece[: half // 2]), " ".join(r.choice(words) for _ in range(20)), " ".join(piece[half // 2 :])]
            want.add((d, i))
        docs[d] = " ".join(parts)
    corpus, asked = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {tuple(x) for x in leaked_items(corpus, asked).collect()}
    assert len(want & got) >= 0.95 * len(want) and not got - want
