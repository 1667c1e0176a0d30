import pytest

from tarnlight.llm.residue import find_residue, without_residue

RESIDUE = [
    "404 Not Found", "# 503\nService Unavailable\nTry again in 4 minutes.", "Goal: {{ goal }}\nDue: {{ date }}", "Please enable JavaScript to view this page.\n© 2026 Some Site. All rights reserved.", "lorem ipsum dolor sit amet consectetur adipiscing elit. Sed do eiusmod tempor.",
    "Your content goes here.\n\nThis is sample text. Replace it with your own.", "Hypothesis: ____________\nStart: __/__/____", "Seite nicht gefunden\nDie Notiz existiert nicht mehr oder wurde verschoben.", "Erreur interne du serveur. Veuillez réessayer dans 18 minutes.", "Habilite los scripts en su navegador para continuar.", "<your who> agreed to <your action> by <your date>.", "test test foo bar baz test test asdf qwer", "TODO: add metric\nTBD\n(fill in later)",
]
CONTENT = [
    "When the archive answered 404 Not Found, we kept the cached copy and went on reading the older chapters.", "# Templates\n\nEvery note of the reading group starts from one short form that asks for three things.\n\n```\nGoal: {{ goal }}\n```\nBoth fields are filled by hand after the meeting.", "Nothing new today.", "bird counts: 23 pages",
    "TODO: ask for the second volume. A careful planner wrote down what the first one says about winter.", "", "   ", None, "Menu\nSearch", "Why filler such as lorem ipsum hurts an index: readers find words that nobody meant to write.", "word " * 30_000,
]
SCHEMA = "doc_id long, text string, source string, h long, kind string"


def table(spark, texts, sources=("a", "b", "c", None)):
    return spark.createDataFrame([(i, t, sources[i % len(sources)], 1, "k") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id for r in find_residue(table(spark, RESIDUE + CONTENT + RESIDUE[:1])).collect()}


def test_residue(found):
    assert [RESIDUE[i] for i in range(len(RESIDUE)) if i not in found] == []


def test_content(found):
    assert [CONTENT[i - len(RESIDUE)] for i in found if len(RESIDUE) <= i < len(RESIDUE) + len(CONTENT)] == []


def test_message_that_recurs_only_beside_residue_is_learned(spark):
    texts = ["Internal Server Error\nThe keeper of the lamps has gone home for the night."] * 6 + ["The keeper of the bees has gone home for the night.", "404 Not Found\nThe cat walked over the table twice on Monday."]
    assert {r.doc_id for r in find_residue(table(spark, texts)).collect()} == set(range(6))


def test_repeated_rows_and_empty(spark):
    df = table(spark, ["404 Not Found", "The whole winter was spent on a single map of the harbour."])
    assert find_residue(df.union(df)).count() == 1 and without_residue(df).count() == 1 and find_residue(df.limit(0)).count() == 0
