import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.llm.encoding import VOCABULARY, encode_corpus, encode_piece, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def ranks():
    return read_ranks()


def test_corpus(spark, reference):
    texts = ["", None, "Hello world", "<|endoftext|> is text", "don't  stop\n\n now\r\n", "héé 漢字 👩‍🔬 é", " " * 300, "a" * 5000, "x" * 20_000 + "!" * 3000]
    rows = [(i, t, [1], "x") for i, t in enumerate(texts)] + [(2, texts[2], [1], "x"), (None, "no key", [1], "x")]
    got = {r.doc_id: list(r.ids) for r in encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, known string")).collect()}
    assert len(got) == len(texts) + 1 and got[0] == [] and got[1] == []
    assert all(got[i] == reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if t)
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abeho tnrs'éß漢1", min_size=1, max_size=60))
def test_pieces_decode_to_the_text(text):
    ranks = read_ranks()
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in encode_piece(text.encode(), ranks)) == text.encode()


def test_every_token_is_itself(ranks):
    assert all(encode_piece(token, ranks) == [rank] for token, rank in list(ranks.items())[:50_256:97])


def test_long_piece_is_not_quadratic(ranks):
    def seconds(n):
        start = time.perf_counter()
        encode_piece(("abcde fghij".replace(" ", "") * n).encode(), ranks)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 30 * max(seconds(2000), 0.005)


def test_null_keys_and_repeated_rows(spark, monkeypatch):
    from tarnlight.llm import rows
    from tarnlight.llm.encoding import encode_corpus

    df = spark.createDataFrame([(None, "one"), (None, "one"), (1, "two"), (1, "two"), (2, None)], "doc_id long, text string")
    for most in (500_000, 0):
        monkeypatch.setattr(rows, "MOST_REPEATED", most)
        got = sorted((r.doc_id or 0, len(r.ids)) for r in encode_corpus(df).collect())
        assert got == [(0, 1), (0, 1), (1, 1), (2, 0)]
