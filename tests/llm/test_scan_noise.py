import pytest

from tarnlight.llm.scan_noise import bare, repair_pages, scan_noise, skeleton

SCHEMA = "id long, source_id long, chunk_index int, text string, location string, kind string, joined string"
PROSE = "the careful reader keeps a notebook and the notebook keeps the reader honest about every question of the winter"


def pages(spark):
    rows = [(i, 1, i, PROSE, "Intro", "k", "j") for i in range(10)]
    body = [
        "NOTES ON WINTER 1\nthe careful reader keeps a note-\nbook and the notebook keeps the read¬\ner honest about every quest-",
        "NOTES ON WINTER 2\nion of the winter. the carefu1 reader keeps\na notebook",
        "NOTES ON WINTER 3\nthe rcader keeps a notebook with a well-\nkept index",
        "the reader keeps a table\n\nreader\n12\nnotebook\n40",
    ]
    rows += [(100 + n, 7, n, t, f"Page {n + 1}", "k", "j") for n, t in enumerate(body)]
    rows += [(101, 7, 1, body[1], "Page 2", "k", "j"), (200, 8, 0, None, "Page 1", "k", "j"), (201, 8, 1, "", "Page 2", "k", "j"), (202, 8, 2, "word " * 20_000, "p. 3", "k", "j"), (203, None, None, "the reader", None, "k", "j")]
    rows += [(300 + i, 9, i, "a well-kept index of a well-kept notebook", "Intro", "k", "j") for i in range(4)]
    return spark.createDataFrame(rows, SCHEMA)


def test_kinds(spark):
    got = {}
    for r in scan_noise(pages(spark))["found"].collect():
        got.setdefault(r.chunk_id, set()).add(r.kind)
    assert got[100] == {"hyphen", "running_line", "page_number"}
    assert got[101] == {"misread", "running_line", "page_number"}
    assert got[102] == {"misread", "running_line", "page_number"}
    assert not set(got) & {103, 200, 201, 202, 203} and not any(i < 100 or i >= 300 for i in got)


def test_repair(spark):
    got = {}
    for r in repair_pages(pages(spark)).orderBy("chunk_id", "paragraph").collect():
        got.setdefault(r.chunk_id, []).append(r.text)
    assert got[100] == ["the careful reader keeps a notebook and the notebook keeps the reader honest about every question"]
    assert got[101] == ["of the winter. the careful reader keeps a notebook"]
    assert got[102] == ["the reader keeps a notebook with a well-kept index"]
    assert len(got[103]) == 2 and 200 not in got and 201 not in got


def test_no_pages(spark):
    assert scan_noise(pages(spark).limit(0))["found"].count() == 0
    assert scan_noise(pages(spark).where("location = 'Intro'"))["found"].count() == 0


@pytest.mark.parametrize(("a", "b"), [("modern", "modem"), ("clear", "dear"), ("h1story", "history"), ("whicli", "which"), ("burdeu", "burden"), ("crovvded", "crowded"), ("spëed", "speed"), ("pra(tice", "practice"), ("origmal", "original")])
def test_skeleton_joins_confusable_forms(a, b):
    assert skeleton(a) == skeleton(b)


def test_bare():
    assert bare("“Word,”") == "word" and bare("(word)") == "(word" or bare("(word)") == "word"
