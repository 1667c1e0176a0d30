from tarnlight.llm.residue import find_residue

NOTICE = [f"The {w} of the lamps has gone home for the night." for w in "keeper owner writer warden porter clerk guard cook smith".split()]
SCHEMA = "doc_id long, text string, source string"


def found(spark, texts, sources):
    return {r.doc_id for r in find_residue(spark.createDataFrame([(i, t, f"s{i % sources}") for i, t in enumerate(texts)], SCHEMA)).collect()}


def test_long_notice_beside_residue_is_learned(spark):
    texts = ["\n".join(["Internal Server Error", *NOTICE])] * 12 + [NOTICE[0], "The whole winter was spent on a single map of the harbour."]
    assert found(spark, texts, 12) == set(range(13))


def test_article_that_quotes_an_error_is_no_residue_when_copied(spark):
    assert found(spark, ["\n".join(["404 Not Found", *NOTICE])] * 3, 3) == set()


def test_notice_without_listed_phrases_is_learned(spark):
    notice = "Esta folha foi levada pelo vento do norte.\nO guarda volta com a chave depois das # horas."
    texts = [notice] * 20 + ["\n".join(NOTICE)] * 3 + ["O guarda volta sem o mapa e conta a viagem ao porto."]
    assert found(spark, texts, 12) == set(range(20))
