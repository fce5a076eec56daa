import pytest
from pyspark.sql import functions as F

from memlake.llm.language_id import UNKNOWN, count_languages, decide, fold, identify, keep_known, learn


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return learn(docs.where(fold(F.col("doc_id"), 4) != 2))


def test_held_out_accuracy(docs, model):
    away = docs.where(fold(F.col("doc_id"), 4) == 2)
    hits = identify(away, model).join(away.select("doc_id", "lang"), "doc_id")
    assert hits.where("lang = lang_pred").count() >= 0.97 * away.count()
    assert hits.where("score < 0 OR score > 1").isEmpty()


def test_clean_documents_stay(docs, model):
    assert keep_known(docs, model).count() >= 0.99 * docs.count()


def test_counts_against_plain_windows(model):
    text = "Und der Weg, und DER Weg!"
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(letters.split()) + " "
    total, found = count_languages([text], model)
    assert total[0] == sum(c.isalpha() for c in padded)
    one_by_one = [count_languages([w], model) for w in padded.split()]
    assert (sum(f for _, f in one_by_one) == found).all() and sum(t for t, _ in one_by_one) == total


def test_long_texts_are_counted_in_parts(model, monkeypatch):
    from memlake.llm import language_id

    text = "the word of that and this is here " * 500
    whole = count_languages([text, "x", None], model)
    monkeypatch.setattr(language_id, "CHUNK", 1000)
    parts = count_languages([text, "x", None], model)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


@pytest.mark.parametrize("text", [None, "", "12 *** 3.", "\U0001f600"])
def test_no_letters(spark, model, text):
    row = identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert (row["lang_pred"], row["score"]) == (UNKNOWN, 0.0)


def test_more_languages_than_a_mask_holds(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{i:02}" for i in range(70)]
    rows = [(i, " ".join(f"{letters[i % 26]}{letters[i // 26]}{c}" for c in letters), names[i]) for i in range(70)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(table, learn(table)).join(table, "doc_id")
    assert got.where("lang_pred = lang").count() == 70


def test_nothing_learned(spark, odd_docs, no_docs):
    model = learn(no_docs)
    assert {r["lang_pred"] for r in identify(odd_docs, model).collect()} == {UNKNOWN}
    assert decide(*count_languages(["a"], model), model)[0] == [UNKNOWN]
    assert identify(no_docs, learn(odd_docs)).collect() == []


def test_odd_rows(odd_docs):
    model = learn(odd_docs)
    assert identify(odd_docs, model).count() == odd_docs.count()
    kept = keep_known(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.where("text IS NULL OR text = ''").isEmpty()
