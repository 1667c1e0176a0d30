import os

import pytest

from tarnlight.llm import residue
from tarnlight.llm.residue import classify, find_residue, masked, shared_form

KINDS = {
    "This page requires JS.": "residue", "Rate limit exceeded.": "residue", "Zurück zur Startseite": "residue", "404 Not Found": "residue", "404": "label",
    "When the archive answered 404 Not Found, we kept the cached copy and went on reading the older chapters.": "suspect", "x" * 60 + "y": "label",
}


@pytest.mark.parametrize("text", KINDS)
def test_kinds(text):
    assert classify(masked(text)) == KINDS[text]


def test_shared_form():
    assert shared_form("goal: {{ goal }}") == shared_form("goal: {{ my aim }}")
    assert shared_form("dolor sit amet lorem ipsum.") == shared_form("ipsum amet elit dolor magna.")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_cues_hide_no_rule():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    forms = {masked(p) for t in texts if t for p in residue._ENDS.split(t)}
    for form in forms:
        plain, cues = form.strip(residue._BARE_MARKS), residue._cues_in(form)
        for n, rule in enumerate(residue.RULES):
            assert n in cues or not (rule.find(form) or rule.find(plain)), (form, n)
        assert -1 in cues or not residue._PLACEHOLDER.search(form), form


def test_long_sentence_of_a_rule_counts_only_if_it_recurs(spark):
    notice = "Before the reading room can show this shelf to its guests it has to run a few small programs in the window that you are looking through, and for that your reader must allow scripts, which at the moment it seems not to do, for reasons that we cannot see from here."
    assert classify(masked(notice)) == "suspect"
    texts = [f"Service Unavailable\n{notice}"] * 5 + [f"{notice} The whole winter was spent on a single map."] + ["404 Not Found\n" + notice.replace("shelf", "map")]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)]
    got = {r.doc_id for r in find_residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == set()  # here a copy stands in an article: fewer than 95 in 100 are beside residue
    rows = [r for r in rows if r[0] != 5]
    got = {r.doc_id for r in find_residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == set(range(5))


def test_hot_forms(spark, monkeypatch):
    monkeypatch.setattr(residue, "HOT", 3)
    rows = [(i, "Goal: {{ goal }}", f"s{i}") for i in range(8)] + [(8, "Goal: {{ goal }}\nThe whole winter was spent on a map.", "a"), (None, "404 Not Found", "b")]
    assert {r.doc_id for r in find_residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == set(range(8))
