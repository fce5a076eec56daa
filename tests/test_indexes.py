"""Stored indexes: the same rows as a full scan, and only what a search needs is read."""

import glob
import itertools
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from memlake.operators import knn, postings, reading, retrieval, vector_index
from memlake.plans import indexing, searching
from memlake.session import scratch_path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- vectors ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def clouds(spark):
    """Forty clouds of vectors; a third of all rows are one vector, some have none."""
    rng = random.Random(3)
    data = []
    for i in range(1500):
        center = rng.randrange(40)
        vector = [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [center * (1 + j) % 17 + rng.gauss(0, 0.2) for j in range(4)]
        data.append((i, f"d{center % 5}/f{i}", None if i % 50 == 1 else vector))
    return spark.createDataFrame(data, "key int, path string, vector array<float>").repartition(6)


@pytest.fixture(scope="module", params=["l2", "cosine"])
def index(spark, clouds, request):
    root = scratch_path(spark, "index")
    vector_index.write_vector_index(clouds, root, ["key"], metric=request.param)
    return vector_index.read_vector_index(spark, root)


def asked(clouds):
    return clouds.where("key % 7 = 0").select(F.col("key").alias("qid"), "vector")


def test_exact_search_equals_the_full_scan(index, clouds):
    full = knn.knn_join(asked(clouds), clouds, 5, metric=index.metric)
    for first in (1, 4, 10_000):
        got = vector_index.search_vectors(asked(clouds), index, 5, first_probes=first)
        key = lambda df: rows(df.select("qid", "rank", "key", F.round("distance", 6)))
        assert key(got) == key(full)


def test_every_row_is_indexed_once(index, clouds):
    assert rows(index.rows.select("key")) == rows(clouds.where("vector IS NOT NULL").select("key"))
    assert sum(index.lists.column("n").to_pylist()) == index.rows.count()


def test_recall_of_the_probed_lists(index, clouds):
    full = {(q, k) for q, k in rows(knn.knn_join(asked(clouds), clouds, 10, metric=index.metric).select("qid", "key"))}
    probes = index.probes_for(0.95)
    got = {(q, k) for q, k in rows(vector_index.search_vectors(asked(clouds), index, 10, recall=0.95).select("qid", "key"))}
    assert len(full & got) / len(full) >= 0.9 and probes < index.lists.num_rows / 2
    assert index.recall == sorted(index.recall) and index.recall[-1] == pytest.approx(1.0)


def test_only_probed_lists_are_read(index, clouds):
    one = asked(clouds).where("qid = 7")
    got = vector_index.search_vectors(one, index, 3, probes=1)
    text = plan(got)
    assert "PartitionFilters: [" in text and text.split("PartitionFilters: [")[1].startswith("isnotnull(list")
    files = vector_index._probed(one.withColumn("_bound", F.lit(0.0)), index, "vector", vector_index._nearest(1))
    assert files.select("list").distinct().count() == 1


def test_a_query_is_not_copied_for_each_list(monkeypatch, index, clouds):
    """However many lists a query looks into, one row of it goes to the search."""
    seen = []
    join = knn.knn_join
    monkeypatch.setattr(vector_index, "knn_join", lambda queries, *a, **b: seen.append(queries.count()) or join(queries, *a, **b))
    some = asked(clouds)
    most = some.where("vector IS NOT NULL").count()
    vector_index.search_vectors(some, index, 5, first_probes=8).count()
    vector_index.search_vectors(some, index, 5, probes=8).count()
    assert seen == [most, most, most]


def test_search_below_directories(spark, index, clouds):
    some = asked(clouds).where("qid < 200").withColumn("scopes", F.array(F.lit("d1"), F.lit("d3")))
    full = knn.knn_join(some, clouds, 4, scopes="scopes", metric=index.metric)
    got = vector_index.search_vectors(some, index, 4, scopes="scopes")
    assert rows(got.select("qid", "rank", "key")) == rows(full.select("qid", "rank", "key"))


def test_an_empty_corpus_finds_nothing(spark, clouds):
    root = scratch_path(spark, "empty")
    vector_index.write_vector_index(clouds.limit(0), root, ["key"])
    nothing = vector_index.read_vector_index(spark, root)
    for options in ({}, {"probes": 3}, {"recall": 0.9}):
        assert vector_index.search_vectors(asked(clouds), nothing, 3, **options).count() == 0


def test_a_thousand_directories_cost_look_ups(spark):
    import pyarrow as pa

    paths = [f"r{i % 1000}/s{i % 7}/f{i}" for i in range(5000)] + [None, "r1", "r1x/f", "r1/"]
    tree = knn.PathTree(pa.array(paths))
    for scope in [f"r{i}" for i in range(1000)] + ["r1/s1", "none"]:
        plain = [bool(p and p.startswith(scope + "/")) for p in paths]
        assert tree.below((scope,)).tolist() == plain
    assert tree.below(()).all()
    assert tree.below(("r1", "r2")).sum() == tree.below(("r1",)).sum() + tree.below(("r2",)).sum()


def test_groups_of_any_columns(spark):
    import pyarrow as pa

    table = pa.table({"a": ["x", None, "x", "y"], "b": [1 << 60, 1, (1 << 60) + 1, None]})
    found = {key: at.tolist() for key, at in knn.groups_of(table, ["a", "b"])}
    assert found == {("x", 1 << 60): [0], ("x", (1 << 60) + 1): [2]}


# --- postings --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def notes(spark):
    """One word in all rows, a third of the rows equal, rare words, rows without words."""
    rng = random.Random(5)
    data = []
    for i in range(900):
        words = ["the"] * rng.randint(1, 4) + [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 12))]
        text = "the same note" if i % 3 == 0 else " ".join(words)
        data.append((i, f"d{i % 4}/n{i}", None if i == 7 else "" if i == 8 else text))
    return spark.createDataFrame(data, "key int, path string, keywords string").repartition(5)


@pytest.fixture(scope="module")
def stored(spark, notes):
    root = scratch_path(spark, "postings")
    postings.write_postings(notes, root, ["key", "path"], buckets=16)
    return postings.read_postings(spark, root)


@pytest.fixture(scope="module")
def questions(spark):
    data = [(1, "the w1 w250"), (2, "the"), (3, "the same note"), (4, "unknown"), (5, ""), (6, None), (7, "W2 w3, w4 w5 w6 the the note")]
    data += [(10 + i, f"the w{i} w{i * 3 % 200} note") for i in range(30)]
    return spark.createDataFrame(data, "qid int, query string").withColumn("scopes", F.expr("IF(qid % 2 = 0, array('d1', 'd2'), array())"))


@pytest.mark.parametrize("scopes", [None, "scopes"])
@pytest.mark.parametrize("first", [1, 100, 10**9])
@pytest.mark.parametrize("k", [3])
def test_postings_score_as_the_scan(stored, notes, questions, scopes, first, k):
    key = lambda df: rows(df.select("qid", "rank", "key", F.round("score", 6)))
    full = retrieval.bm25(questions, notes, k, keys=["key", "path"], scopes=scopes)
    got = postings.bm25_postings(questions, stored, k, scopes=scopes, first_postings=first)
    assert key(got) == key(full) != []


def test_only_the_buckets_of_the_terms_are_read(spark, stored):
    one = spark.createDataFrame([(1, "w1 w250")], "qid int, query string")
    got = postings.bm25_postings(one, stored, 3)
    filters = [part.split("]")[0] for part in plan(got).split("PartitionFilters: [")[1:]]
    assert any("bucket" in f and ("IN" in f or "=" in f) for f in filters)


def test_common_terms_bring_no_rows(spark, stored, monkeypatch):
    """With a bound from the rare term the common one is only looked up for the rows found."""
    seen = []
    parts = postings._parts
    monkeypatch.setattr(postings, "_parts", lambda p, w, *a: seen.append(w.select("term").distinct().collect()) or parts(p, w, *a))
    one = spark.createDataFrame([(1, "the w250 w251")], "qid int, query string")
    postings.bm25_postings(one, stored, 1, first_postings=1).collect()
    assert "the" not in {r["term"] for r in seen[1]} and {r["term"] for r in seen[2]} >= {"the"}


def test_terms_and_impacts(stored, notes):
    df = {r["term"]: r["df"] for r in retrieval.document_frequency(notes).collect()}
    assert {r["term"]: r["df"] for r in stored.terms.collect()} == df
    assert stored.n_docs == 900


def test_postings_of_no_rows(spark, notes, questions):
    root = scratch_path(spark, "none")
    postings.write_postings(notes.limit(0), root, ["key", "path"])
    assert postings.bm25_postings(questions, postings.read_postings(spark, root), 3).count() == 0


# --- grams -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    words = ["alpha", "Beta", "gämma", "the", "日本語", "x", "delta-delta", "epsilon_zeta_eta_theta"]
    data = [
        (f"p{i}" if i % 9 else f".h/p{i}", None if i == 4 else "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 5))))
        for i in range(300)
    ]
    data += [("same", "The Common line of all\n" * 40), ("end", "…" * 17 + "needle"), ("empty", "")]
    return spark.createDataFrame(data, "path string, content string").repartition(4)


PATTERNS = [
    (1, "needle"), (2, "the"), (3, "é"), (4, "x"), (5, "the common line"), (6, "THE COMMON LINE OF ALL"), (7, "gämma the"), (8, "日本語"),
    (9, "delta-delta epsilon_zeta_eta_theta"), (10, "theta"), (11, ""), (12, None), (13, "all\nthe"), (14, "……needle"), (None, "alpha beta"),
    (15, "epsilon_zeta_eta_theta epsilon_zeta_eta_theta"), (2, "beta"), (16, "no such thing anywhere at all"),
]


@pytest.mark.parametrize("options", [{}, {"max_patterns": 0}, {"stored": True}, {"stored": True, "max_patterns": 0}])
def test_grep_finds_every_line(spark, texts, options, monkeypatch):
    monkeypatch.setattr(reading, "SHORT_PATTERNS", 2)
    options = dict(options)
    asked = spark.createDataFrame(PATTERNS, "qid int, query string")
    if options.pop("stored", False):
        root = scratch_path(spark, "grams")
        reading.write_grams(texts, root)
        options["index"] = reading.read_grams(spark, root)
    got = sorted(reading.grep(texts, asked, **options).collect(), key=str)
    plain = []
    for doc in texts.collect():
        if doc["content"] is None or doc["path"].startswith("."):
            continue
        for n, line in enumerate(doc["content"].split("\n"), 1):
            plain += [(q, doc["path"], n, line.strip()) for q, p in PATTERNS if p and p.lower() in line.lower()]
    assert [tuple(r) for r in got] == sorted(plain, key=lambda r: str(got[0].__class__(qid=r[0], path=r[1], line=r[2], content=r[3])))


@pytest.mark.parametrize("text", ["", "a", "abcd", "äbcdefg", "x" * 100, "日本語" * 20])
def test_every_pattern_shares_a_gram_with_its_text(spark, text):
    patterns = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    patterns = [(0, p) for p in patterns if len(p.encode()) >= 7][:600]
    docs = spark.createDataFrame([("d", "ü" + text + "end of text")], "path string, content string")
    asked = spark.createDataFrame(patterns or [(0, "end of text")], "_qid int, _pattern string")
    met = reading.grams(docs).join(reading._anchors(asked), "gram").select("_pattern").distinct()
    assert met.count() == asked.count()


def test_grep_reads_only_the_buckets_of_its_grams(spark, texts, monkeypatch):
    root = scratch_path(spark, "grams")
    reading.write_grams(texts, root)
    read = []
    whole = reading._stored_grams
    monkeypatch.setattr(reading, "_stored_grams", lambda *a: read.append(whole(*a)) or read[0])
    asked = spark.createDataFrame([(1, "zeta_eta_theta epsilon_zeta_eta")], "qid int, query string")
    reading.grep(texts, asked, index=reading.read_grams(spark, root)).collect()
    assert "PartitionFilters: [bucket" in plan(read[0]) or "PartitionFilters: [isnotnull(bucket" in plan(read[0]) or "IN" in plan(read[0])
    assert read[0].count() < reading.read_grams(spark, root).count() / 2


# --- both lanes ------------------------------------------------------------------------------

def test_hybrid_search_over_stored_lanes(spark):
    """The plan gives the same rows from stored indexes as from plain tables, with their live lines."""
    words = ["alpha-1", "BetaGamma", "NodeJs", "F12", "docs/x.md", "plain", "text"]
    rng = random.Random(2)
    data = [
        (f"k/d{i}.md", "# T\n" + "".join(f"## S{j}\n{' '.join(rng.choices(words, k=9))} n{i}\n" for j in range(3))) for i in range(40)
    ]
    docs = spark.createDataFrame(data, "path string, content string")
    tables = indexing.build_index(docs)
    queries = spark.createDataFrame([(1, "alpha-1 NodeJs"), (2, "F12 text"), (3, "docs/x.md"), (4, "nothing known")], "qid int, query string")
    row = ["path", "start_line", "end_line", "section"]
    roots = scratch_path(spark, "chunks"), scratch_path(spark, "keywords")
    vector_index.write_vector_index(tables.chunks, roots[0], row)
    postings.write_postings(tables.keywords, roots[1], row)
    stored = vector_index.read_vector_index(spark, roots[0]), postings.read_postings(spark, roots[1])
    key = lambda df: rows(df.select("qid", "rank", *row, F.round("score", 6), "match", "content"))
    view = indexing.clean_view(docs)
    plain = key(searching.hybrid_search(queries, tables.chunks, tables.keywords, view, 4))
    assert key(searching.hybrid_search(queries, *stored, view, 4)) == plain != []
    near = lambda chunks: rows(searching.search_sections(queries, chunks, view, 3).select("qid", "rank", *row))
    assert near(stored[0]) == near(tables.chunks)


def test_documents_of_one_file_get_their_postings_from_many_tasks(spark, tmp_path, monkeypatch):
    from memlake.catalog import search

    docs = spark.createDataFrame([(i, f"common word{i % 7} mark{i}") for i in range(60)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, "mark7 common"), (2, "word3 common")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    tasks, write = [], search.write_postings
    monkeypatch.setattr(search, "write_postings", lambda d, *more: tasks.append(d.rdd.getNumPartitions()) or write(d, *more))
    found = {(r.qid, r["rank"]): r.doc_id for r in search.bm25_from_postings(spark, str(tmp_path)).collect()}
    assert tasks == [spark.sparkContext.defaultParallelism]
    # Of equal scores the smallest keys come first.
    assert found[1, 1] == 7 and [found[2, n] for n in range(1, 6)] == [3, 10, 17, 24, 31]


def test_stored_grams_keep_the_order_of_their_documents(spark):
    """Nothing is sorted by gram: within a file of a bucket the grams of one document stand together."""
    root = scratch_path(spark, "grams")
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"word{i * 37 + j}" for j in range(400))) for i in range(12)], "path string, content string")
    reading.write_grams(docs.coalesce(1), root)
    stored = reading.read_grams(spark, root)
    assert sorted(stored.select("path", "gram").collect()) == sorted(reading.grams(docs).select("path", "gram").collect())
    for file in glob.glob(f"{root}/bucket=*/*.parquet"):
        paths = pq.read_table(file, partitioning=None).column("path").to_pylist()
        assert len(list(itertools.groupby(paths))) == len(set(paths))
