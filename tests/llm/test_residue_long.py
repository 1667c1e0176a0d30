import pytest

from tarnlight.llm.residue import classify_long, masked

RESIDUE = {
    "html": "<html><head><title>404 Not Found</title><style>body { margin: 0; font-family: sans-serif }</style></head><body>" + '<div class="wrapper box main page left top"><span></span></div>' * 8 + "<h1>Not Found</h1><hr><center>nginx/1.18.0</center></body></html>",
    "json": '{"error": "not found", "message": "The page could not be found", ' + ", ".join(f'"trace{i}": "{i}a7f00"' for i in range(60)) + "}",
    "form": " ".join(f"{w} of the meeting: {{{{ {w} }}}}" for w in "title owner place day hour goal topic room guest chair minutes outcome budget review".split()),
    "notice": ", ".join(["please enable javascript to view this page", "the page could not be loaded", "please check the address", "your session has expired", "bitte aktivieren sie javascript"] * 4),
}
CONTENT = {
    "prose": ", ".join(["the readers found the old map", "the page could not be loaded", "the keeper of the lamps went home"] * 6),
    "record": "{" + ", ".join(f'"status": "active", "name": "Anna Berg {i}", "city": "Northbrook"' for i in range(20)) + "}",
    "words": "word " * 30_000,
    "html": "<p>" + "the whole winter was spent on a single map of the harbour and the lamps above it " * 8 + "</p><h1>404 Not Found</h1>",
}


@pytest.mark.parametrize("name", RESIDUE)
def test_long_residue(name):
    assert len(masked(RESIDUE[name])) > 400
    kinds = {k for _, k in classify_long(RESIDUE[name].lower())}
    assert "residue" in kinds and "content" not in kinds


@pytest.mark.parametrize("name", CONTENT)
def test_long_content(name):
    assert len(masked(CONTENT[name])) > 400
    assert "content" in {k for _, k in classify_long(CONTENT[name].lower())}


def test_query(spark):
    from tarnlight.llm.residue import find_residue

    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate([*RESIDUE.values(), *CONTENT.values()])], "doc_id long, text string, source string")
    assert {r.doc_id for r in find_residue(df).collect()} == set(range(len(RESIDUE)))
