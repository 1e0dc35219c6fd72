import numpy as np
import pytest

from tivlens.llm import language_id
from tivlens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return language_id.fit(docs.where(~language_id.held_out()))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language_id"](spark, SF_DIR).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_special_texts(spark, model):
    texts = [None, "", "123 !? \n", "1 the 2", "the of and " * 400_000, "\U0001d518\U0001f600", "é"]
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)] + [(3, "1 the 2", 9), (None, "the and", 9)],
                                 "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert [got[k] for k in range(3)] == [("und", 0.0)] * 3
    assert got[3][0] in model.langs and got[4][0] == "en" and got[None][0] in model.langs
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert set(language_id.predict(docs, model, carry=True).select("row.score").toPandas().score) == {9}


def test_long_texts_are_whole():
    text = "abc dé" * 400_000
    assert (language_id.gram_counts(text) == sum_of_grams(text)).all()


def sum_of_grams(text, size=language_id.SLICE):
    language_id.SLICE = len(text)
    try:
        return language_id.gram_counts(text)
    finally:
        language_id.SLICE = size


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert [tuple(r) for r in language_id.predict(docs, model).collect()] == [(1, "und", 0.0)]
    one = language_id.fit(docs.fillna("xx"))
    assert [tuple(r) for r in language_id.predict(docs, one).collect()] == [(1, "xx", 1.0)]


def test_elastic_net_gives_zeros_and_calibration_spreads(model):
    assert (model.weights == 0).mean() > 0.3
    scores, labels = np.array([[9.0, 0], [9, 0], [9, 0], [9, 0]]), np.array([0, 0, 0, 1])
    t = language_id.temperature(scores, labels)
    assert 0.6 < language_id.softmax(scores / t)[0, 0] < 0.85


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    def text(lang, k):
        return " ".join(f"{lang}{chr(97 + k % 26)}{chr(97 + k // 26)}" for _ in range(3))

    rows = [(text(lang, k), lang) for lang in ("aa", "bb") for k in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string")
    first = df.selectExpr("text", "lang", "xxhash64(text, lang) AS place").where("lang = 'aa' AND place % 5 <> 0").orderBy("place").first()
    seen = {}

    def ftrl(rows, k, *_):
        seen["rows"] = rows
        return np.zeros((language_id.BUCKETS, k))

    def temperature(scores, labels):
        seen["left"] = labels
        return 1.0

    monkeypatch.setattr(language_id, "ftrl", ftrl)
    monkeypatch.setattr(language_id, "temperature", temperature)
    language_id.fit(df.union(spark.createDataFrame([(first.text, "aa")] * 300, df.schema)), max_rows=60)
    labels = [y for *_, y in seen["rows"]] + list(seen["left"])
    assert labels.count(0) == 30 and labels.count(1) == 30
    assert len({(at.tobytes(), x.tobytes()) for at, x, _ in seen["rows"]}) == len(seen["rows"])


def test_only_texts_are_sent_to_the_workers(spark):
    """The rows stay in Spark, and a condition on the prediction doesn't make it a second time."""
    docs = spark.createDataFrame([(1, "ab", "x" * 50), (2, None, "y"), (None, "cd", None)], "doc_id long, text string, more string")
    model = language_id.Model(["l"], np.ones(language_id.BUCKETS), np.ones((language_id.BUCKETS, 1)), 1.0)
    found = language_id.predict(docs, model, carry=True).where("lang_pred <> 'und' AND score >= 0.5")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted((r["row"]["more"] or "", r["lang_pred"], r["score"]) for r in found.collect()) == [("", "l", 1.0), ("x" * 50, "l", 1.0)]
