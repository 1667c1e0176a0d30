import random

import pytest

from tarnlight.llm import personal, personal_table


@pytest.fixture(scope="module")
def tagger():
    return personal.train()


def test_held_out_accuracy(tagger):
    rows = personal_table.expand(600, seed=77)
    found = personal.spans(["".join(p for p, _ in r) for r in rows], tagger)
    right = wrong = missed = 0
    for row, spans in zip(rows, found):
        want = {label for _, label in row if label}
        have = {k for k, _, _ in spans}
        right, wrong, missed = right + len(want & have), wrong + len(have - want), missed + len(want - have)
    assert right / (right + missed) > 0.97 and right / (right + wrong) > 0.97


def test_given_names_outside_the_list(tagger):
    given = "Bruno Clara Dmitri Emil Fatima Gustav Hanna Ibrahim Jana Kofi Leila Marco Nadia Oscar Pedro Stefan Tariq Vera Walter Yara Akira Chidi Esteban Freya Gita Hiroshi Jorge Lars Nikolai Olga".split()
    assert not {g.lower() for g in given} & set(personal.SHORT_FOR)
    r = random.Random(9)
    lines = [x for x in personal_table.LINES.split("\n") if x.count("{name}") == 1]
    found = 0
    for _ in range(600):
        first, last = r.choice(given), personal_table._surname(r)
        name = r.choice((f"{first} {last}", f"{last}, {first}", f"{last} {first}"))
        text = r.choice(lines).replace("{name}", name)
        at = text.index(name)
        found += any(k == "name" and a <= at and b >= at + len(name) for k, a, b in personal.spans([text], tagger)[0])
    assert found / 600 > 0.97


def test_table(spark, tagger):
    texts = {
        1: "Call (555) 555-0142 after six. Thanks, and map making?", 2: "Write to anna.berg@example.org before Friday", 3: "Home address: 12 Maple Street, Northbrook", 4: "ID number QQ123456C",
        5: "talk to Katherine Osterby about the draft", 6: "see build 2025-11-2345", 7: None, 8: "", 9: "a habit from Dunaworth School of Cartography Ltd", 10: "plain words " * 20_000,
    }
    rows = [(i, t, "m", ["k"]) for i, t in texts.items()] + [(2, texts[2], "m", ["k"])]
    out = personal.find_personal_data(spark.createDataFrame(rows, "id long, content string, masked string, kinds array<string>"), "id", "content", tagger).collect()
    got = {r.id: (r.masked, list(r.kinds)) for r in out}
    assert len(out) == 11 and got[7] == (None, []) and got[8] == ("", []) and got[10] == (texts[10], [])
    assert got[1] == ("Call [PHONE] after six. Thanks, and map making?", ["phone"])
    assert got[2] == ("Write to [EMAIL] before Friday", ["email"])
    assert got[3] == ("Home address: [ADDRESS]", ["address"]) and got[4] == ("ID number [ID_NUMBER]", ["id_number"])
    assert got[5] == ("talk to [NAME] about the draft", ["name"]) and got[6] == (texts[6], []) and got[9] == (texts[9], [])
    assert personal.find_personal_data(spark.createDataFrame([], "id long, content string"), "id", "content", tagger).count() == 0
