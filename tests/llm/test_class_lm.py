import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import class_lm
from memlake.llm.class_lm import CLASSES, _objective, best_class, held_out, score_texts, train


def words(text):
    return (text or "").encode().lower().split() + [None]


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counts = train(docs.where(~held_out(F.col("doc_id"))).select("text"))
    rows = score_texts(docs, model, counts).collect()
    return model, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, rows


def test_base_scores(scored):
    model, texts, rows = scored
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t))
    total, ground = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    assert (model.tokens, model.vocabulary) == (total, len(counts))
    assert len(rows) == len(texts)
    for r in rows:
        said = words(texts[r["doc_id"]])
        assert r["n_tokens"] == len(said) and r["n_known"] == sum(counts[w] > 0 for w in said)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / ground) for w in said), rel=1e-9)


def test_classes_beat_single_words_on_unseen_texts(scored):
    _, _, rows = scored
    away = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in away) > sum(r["base_score"] for r in away)
    assert all(r["score"] < 0 for r in rows)


def test_probabilities_add_up(spark, monkeypatch):
    """All words of a corpus and one unknown word, after each context."""
    monkeypatch.setattr(class_lm, "UNIT_COUNT", 4)
    texts = ["a b a b c d", "a b c a b e f", "b a x y z", "a a a b", "q r s t u v w"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model, counts = train(docs)
    vocabulary = sorted({w for t in texts for w in t.split()})
    units, _ = model.units.find(*_hashed(vocabulary))
    known = {r["word"]: r["n"] for r in counts.collect()}
    hashes = _hashed(vocabulary)[0].view(np.int64)
    for context in range(CLASSES + 1):
        into = 10 ** (model.transition[context, model.classes] + model.emission)
        total = into[0]
        left = into.copy()
        left[0] = 0
        for unit, h in zip(units, hashes.tolist(), strict=True):
            tail = unit - 1 - model.units.own
            if tail < 0:
                total += into[unit]
            else:
                total += into[unit] * (known[h] - model.discount) / model.tail_total[tail]
            left[unit] = 0 if tail < 0 else left[unit]
        # What is left of the groups is for words never seen.
        for tail in range(class_lm.TAILS):
            unit = 1 + model.units.own + tail
            n = model.tail_total[tail]
            total += into[unit] * (model.discount * model.tail_words[tail] / n if n else 1.0)
        assert total == pytest.approx(1.0, abs=1e-9)


def _hashed(some):
    import pyarrow as pa

    from memlake.llm.tokens import words_of

    parts = list(words_of(pa.array(some)))
    return np.concatenate([p.hashes for p in parts]), np.concatenate([p.tails for p in parts])


def test_best_class_raises_the_objective_most():
    rng = np.random.default_rng(3)
    for _ in range(20):
        k, units = 5, 12
        pairs = rng.integers(0, 6, (units, units)).astype(float)
        classes = rng.integers(1, k, units)
        classes[0] = 0

        def matrix(c):
            m = np.zeros((k, k))
            np.add.at(m, (c[:, None].repeat(units, 1), c[None, :].repeat(units, 0)), pairs)
            return m

        unit = int(rng.integers(1, units))
        alone = np.arange(units) != unit
        before = np.bincount(classes[alone], weights=pairs[alone, unit], minlength=k)
        after = np.bincount(classes[alone], weights=pairs[unit, alone], minlength=k)
        got = best_class(int(classes[unit]), before, after, pairs[unit, unit], matrix(classes))
        scores = {}
        for c in range(1, k):
            moved = classes.copy()
            moved[unit] = c
            scores[c] = _objective(matrix(moved))
        assert scores[got] == pytest.approx(max(scores.values()))


def test_sweeps_raise_the_likelihood(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    plain, _ = train(texts, sweeps=0)
    model, counts = train(texts, sweeps=4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = lambda m: score_texts(docs, m, counts).agg(F.sum("score")).first()[0]
    assert total(model) > total(plain)


def test_odd_rows(odd_docs, no_docs):
    model, counts = train(odd_docs.select("text"))
    rows = score_texts(odd_docs, model, counts).collect()
    assert len(rows) == odd_docs.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 7)} == {1}
    assert len({(r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in rows if r["doc_id"] == 6}) == 1
    assert next(r["n_tokens"] for r in rows if r["doc_id"] == 5) == 60_001
    assert score_texts(no_docs, model, counts).collect() == []


def test_nothing_learned(odd_docs, no_docs):
    model, counts = train(no_docs.select("text"))
    rows = score_texts(odd_docs, model, counts).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) and r["base_score"] == 0 for r in rows)
