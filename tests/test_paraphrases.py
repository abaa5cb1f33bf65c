"""The paraphrase queries read documents, the whole table."""

from corpuskiln.plans import catalogue

TEXTS = ["please write some code that sorts every number upwards", "please write some code that sorts every number downwards", "nothing here resembles another row", "sorts every number upwards, please write some code that"]


def test_paraphrases_among_documents(spark, tmp_path):
    spark.createDataFrame([(i, x, "s", "en") for i, x in enumerate(TEXTS)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(r.a, r.b) for r in catalogue.QUERIES["paraphrase_pairs"](spark, str(tmp_path)).collect()}
    assert pairs == {(0, 1), (0, 3), (1, 3)}
    scores = {r.doc_id: r.score for r in catalogue.QUERIES["semantic_score"](spark, str(tmp_path)).collect()}
    assert set(scores) == {0, 1, 2, 3} and all(0 < x <= 1 for x in scores.values())
