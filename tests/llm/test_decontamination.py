import re

import pytest
from pyspark.sql import functions as F

from memlake.llm.decontamination import contamination, remove_contaminated, remove_spans

ITEMS = "item_id long, text string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for p in range(len(w)):
            for k in range(1, n + 1):
                some = windows.get(tuple(w[p : p + k])) if p + k <= len(w) else None
                if some:
                    hit |= set(range(p, p + k))
                    found |= {str(x) for x in some if x is not None}
        out.append((i, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def got(docs, items):
    rows = contamination(docs, items).collect()
    return sorted(((r["doc_id"], r["n_words"], sorted(r["hits"]), r["items"]) for r in rows), key=str)


def test_like_all_windows(spark, rng):
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 25]) + 0)) for i in range(2, 12)] + [(None, "lone words"), (3, None)]
    items = [x for x in items if len(words(x[1])) not in (1, 3)] + [(50, "x, Y-z!"), (51, "Straße")]
    docs = [(i, say(rng.randint(0, 60)) + rng.choice(["", " X y Z", " lone. Words", " straße"])) for i in range(80)]
    docs += [(None, "x y z"), (7, docs[7][1]), (7, docs[7][1])]
    assert got(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)) == plain(docs, items)


@pytest.fixture
def item(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], ITEMS)


@pytest.mark.parametrize("text, left", [
    ("Start. One two three four five six seven eight nine ten, end.", "Start, end."),
    ("one two three four five six seven eight nine", "one two three four five six seven eight nine"),
    ("A one two three four five six seven eight nine ten eleven twelve!", "A twelve!"), ("", ""), (None, None),
])
def test_spans_go(spark, item, text, left):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert remove_spans(docs, item).first()["text"] == left


def test_documents_go(odd_docs, item, spark, no_docs):
    bad = odd_docs.withColumn("text", F.when(F.col("doc_id") == 4, "x ONE two three four five six seven eight nine ten")
                              .otherwise(F.col("text")))
    kept = remove_contaminated(bad, item)
    assert kept.columns == bad.columns and kept.count() == bad.count() - 1
    assert contamination(odd_docs, item).count() == odd_docs.count()
    assert contamination(no_docs, item).collect() == [] and remove_contaminated(no_docs, item).collect() == []
    nothing = spark.createDataFrame([], ITEMS)
    assert remove_contaminated(odd_docs, nothing).count() == odd_docs.count()


def test_the_lookup_is_a_broadcast_and_runs_no_python(spark, item, odd_docs):
    plan = contamination(odd_docs, item)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|CartesianProduct|NestedLoop", plan)
