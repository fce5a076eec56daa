"""Plans and skew: what must hold when one key has a third of the rows, whatever the partitioning."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake import catalog
from memlake.catalog import inputs
from memlake.catalog.base import table
from memlake.functions.chunking import overlap_chunks
from memlake.functions.embedding import embed
from memlake.functions.keywords import extract_keywords
from memlake.operators import code, index, knn, reading, retrieval, skew
from memlake.streaming import changes


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows of which a third belong to one key; times and values with ties."""
    rng = random.Random(7)
    data = [
        ("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.randrange(900), rng.random())
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "key string, id int, t int, v double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 13])
@pytest.mark.parametrize("descending", [False, True])
def test_split_rank_is_row_number(skewed, partitions, descending):
    order = [F.desc("t") if descending else F.asc("t"), "id"]
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    ours = skew.split_rank(skewed.repartition(partitions), ["key"], "t", ["id"], descending)
    assert rows(ours.select("id", "rank")) == rows(plain.select("id", "rank"))


@pytest.mark.parametrize("descending", [False, True])
def test_equal_values_are_split_as_well(spark, descending):
    """Ten thousand rows of one key and one time, some of them equal in all columns, and keys that are null."""
    data = [("hot", 5, i % 4000) for i in range(10_000)] + [(None, 5, i) for i in range(50)] + [(f"k{i}", i % 3, 0) for i in range(50)]
    df = spark.createDataFrame(data, "key string, t int, id int").repartition(7)
    order = [F.desc("t") if descending else F.asc("t"), "id"]
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    named = lambda d: sorted((str(r[0]), *r[1:]) for r in d.select("key", "t", "id", "rank").collect())
    assert named(skew.split_rank(df, ["key"], "t", ["id"], descending)) == named(plain)
    written, ends = skew._in_order(df, ["key"], order, [], 8)
    sizes = [r["n"] for r in written.groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * len(data) / 8 and len(sizes) == 8
    lagged = skew.split_lag(df, ["key"], "t", ["id"], ["id"])
    plain = df.withColumn("prev_id", F.lag("id").over(Window.partitionBy("key").orderBy("t", "id")))
    named = lambda d: sorted(tuple(map(str, r)) for r in d.select("key", "t", "id", "prev_id").collect())
    assert named(lagged) == named(plain)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ranks_over_any_number_of_ranges(spark, skewed, parts):
    ours = skew.split_rank(skewed, ["key"], "t", ["id"], parts=parts)
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("t", "id")))
    assert rows(ours.select("id", "rank")) == rows(plain.select("id", "rank"))
    assert skew.split_rank(skewed.limit(0), ["key"], "t", ["id"], parts=parts).count() == 0


def test_split_rank_of_a_whole_table(skewed):
    plain = skewed.withColumn("rank", F.row_number().over(Window.orderBy("t", "id")))
    ours = skew.split_rank(skewed, [], "t", ["id"])
    assert rows(ours.select("id", "rank")) == rows(plain.select("id", "rank"))


def test_split_rank_never_groups_a_whole_key(skewed):
    """No cell of the local ranking holds more than its share of the hot key."""
    cells = skew.bucketed(skewed, "id").where("key = 'hot'").groupBy("_bucket").count()
    assert cells.agg(F.max("count")).first()[0] <= 1000 // 8 + 20


@pytest.mark.parametrize("parts", [8, 100, 997])
def test_buckets_follow_the_order(skewed, parts):
    cells = skew.bucketed(skewed, "t", parts=parts).groupBy("_bucket").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spans = [(r.a, r.b) for r in cells.orderBy("_bucket").collect()]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and len(spans) > min(parts, 900) * 0.6


def test_split_lag_is_lag(skewed):
    w = Window.partitionBy("key").orderBy("t", "id")
    plain = skewed.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_id", F.lag("id").over(w))
    ours = skew.split_lag(skewed, ["key"], "t", ["v", "id"], ["id"])
    assert rows(ours.select("id", F.coalesce("prev_v", F.lit(-1.0)), F.coalesce("prev_id", F.lit(-1)))) == rows(
        plain.select("id", F.coalesce("prev_v", F.lit(-1.0)), F.coalesce("prev_id", F.lit(-1)))
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("find_hot", [True, False])
def test_salted_join_is_join(spark, skewed, how, find_hot):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), ("none", 5)], "key string, w int")
    ours = skew.salted_join(skewed, right, ["key"], how, find_hot=find_hot)
    plain = skewed.join(right, ["key"], how)
    text = lambda df: df.select(F.to_json(F.struct(*sorted(df.columns))))
    assert rows(text(ours)) == rows(text(plain))


def test_salted_join_spreads_the_hot_key(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "key string, w int")
    joined = skew.salted_join(skewed.where("key = 'hot'"), right, ["key"], find_hot=False)
    assert "_salt" in plan(joined)


@pytest.mark.parametrize("gap", [1, 3, 50])
def test_bursts_match_a_plain_window(skewed, gap):
    events = skewed.select(F.col("key").alias("path"), F.timestamp_seconds("t").alias("ts"))
    w = Window.partitionBy("path").orderBy("ts")
    opens = F.coalesce((F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w)) > gap).cast("int"), F.lit(1))
    numbered = events.withColumn("o", opens).withColumn("n", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plain = numbered.groupBy("path", "n").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("c"))
    ours = changes.debounce(events, gap)
    assert rows(ours.select("path", "first_ts", "last_ts", "n")) == rows(plain.select("path", "a", "b", "c"))


# --- nearest neighbours ----------------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"max_queries": 7}])
def test_copies_of_one_vector_are_ordered_by_key(spark, options):
    """A third of the corpus is one vector: nothing is dropped and ties follow the key."""
    data = [(i, [1.0, 0.0] if i % 3 == 0 else [float(i), 1.0]) for i in range(300)]
    corpus = spark.createDataFrame(data, "key int, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(20)], "qid int, vector array<float>")
    got = knn.knn_join(queries, corpus, 4, **options)
    assert rows(got.select("qid", "rank", "key")) == [(q, r + 1, 3 * r) for q in range(20) for r in range(4)]


@pytest.mark.parametrize("options", [{}, {"max_queries": 1}])
def test_scopes_and_groups_limit_each_query(spark, options):
    corpus = spark.createDataFrame(
        [("a/b/x", "p", [0.0]), ("a/bc/y", "p", [0.0]), ("a/b/z", "q", [5.0]), ("c/w", "q", [1.0])],
        "path string, project string, vector array<float>",
    )
    queries = spark.createDataFrame(
        [(1, ["a/b"], "p", [0.0]), (2, [], "q", [0.0]), (3, ["none"], "p", [0.0])],
        "qid int, scopes array<string>, project string, vector array<float>",
    )
    got = knn.knn_join(queries, corpus, 3, keys=["path"], by=["project"], scopes="scopes", **options)
    assert rows(got.select("qid", "path")) == [(1, "a/b/x"), (2, "a/b/z"), (2, "c/w")]


@pytest.mark.parametrize("max_weights", [0, 10**6])
def test_keyword_lane_respects_scopes(spark, max_weights):
    corpus = spark.createDataFrame(
        [("a/b/x", "fox den"), ("a/bc/y", "fox"), ("c/w", "fox fox"), ("d/v", "owl")], "path string, keywords string"
    )
    queries = spark.createDataFrame([(1, "fox", ["a/b"]), (2, "Fox", []), (3, "cat", [])], "qid int, query string, scopes array<string>")
    got = retrieval.bm25(queries, corpus, 3, keys=["path"], scopes="scopes", max_weights=max_weights)
    found = {(r.qid, r.path) for r in got.collect()}
    assert found == {(1, "a/b/x"), (2, "a/b/x"), (2, "a/bc/y"), (2, "c/w")}


def test_grep_reads_long_texts_to_the_end(spark):
    docs = spark.createDataFrame([("a", "filler line\n" * 180_000 + "the Needle")], "path string, content string")
    asked = spark.createDataFrame([(1, "needle")], "qid int, query string")
    assert rows(reading.grep(docs, asked)) == [(1, "a", 180_001, "the Needle")]


def test_grep_plans_agree(spark):
    docs = spark.createDataFrame(
        [("a", "One Two\nthree\n"), ("b", "two" * 30 + "\nÉtÉ twO x"), (".h/c", "two"), ("d", None)], "path string, content string"
    )
    asked = spark.createDataFrame([(1, "two"), (2, "e"), (3, "été"), (4, ""), (5, "twotwotwotwotwotwo"), (6, "two\nthree")], "qid int, query string")
    blocks = rows(reading.grep(docs, asked, cap=None, max_patterns=0))
    arrays = rows(reading.grep(docs, asked, cap=None))
    assert blocks == arrays
    assert [r[:3] for r in arrays] == [
        (1, "a", 1), (1, "b", 1), (1, "b", 2), (2, "a", 1), (2, "a", 2), (3, "b", 2), (5, "b", 1)
    ]


# --- plans -----------------------------------------------------------------------------------

def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    text = plan(tasks)
    assert "EqualTo(o_orderstatus,P)" in text and "o_totalprice" not in text


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    top = skew.top_k_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 3)
    assert plan(top).count("WindowGroupLimit") == 2


def test_row_local_work_needs_no_shuffle_and_no_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    work = docs.select(F.explode(overlap_chunks("text")).alias("c")).select(extract_keywords("c.section", "c.text"))
    text = plan(work)
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_project_map_reads_no_text(spark, sf_dir):
    units = inputs.units(spark, sf_dir)
    text = plan(code.project_map(code.indexed_paths(units)))
    assert "l_quantity" not in text


@pytest.mark.parametrize("name", ["merge_units", "unblock", "scope_filter", "rrf_fused", "version_list", "title_unique", "role_decisions"])
def test_no_cross_join(spark, sf_dir, name):
    text = plan(catalog.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_texts_that_nobody_asks_for_stay_where_they_are(spark, sf_dir):
    """The documents are sifted by a broadcast of the requested paths before anything is shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("concat('d/', doc_id) AS path", "text AS content")
    asked = spark.createDataFrame([(1, "d/3", 1, 2), (2, "d/none", 1, 1)], "rid int, path string, start_line int, end_line int")
    hits = asked.selectExpr("rid AS qid", "path", "start_line", "end_line")
    for plan in (reading.read_lines(asked, docs), retrieval.hydrate(hits, docs)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "LeftSemi" in text and "CartesianProduct" not in text
        assert plan.count() == 2


def test_hot_keys_get_as_many_salts_as_they_fill_shares(spark):
    df = spark.range(1000).selectExpr("IF(id < 600, 'most', IF(id < 700, NULL, concat('k', id))) AS key", "id")
    assert rows(skew.hot_keys(df, ["key"], parts=10)) == [("most", 6)]
    right = spark.createDataFrame([("most", 1), ("k900", 2), (None, 3)], "key string, w int")
    got = skew.salted_join(df, right, ["key"], "left")
    assert rows(got.groupBy("w").count().where("w IS NOT NULL")) == [(1, 600), (2, 1)] and got.count() == 1000


def test_a_null_group_matches_nothing(spark):
    corpus = spark.createDataFrame([("a", None, [1.0, 0.0]), ("b", "x", [0.0, 1.0])], "path string, g string, vector array<float>")
    queries = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, "x", [1.0, 0.0])], "qid int, g string, vector array<float>")
    found = knn.knn_join(queries, corpus, 3, keys=["path"], by=["g"])
    assert {(r.qid, r.path) for r in found.collect()} == {(2, "b")}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("options", [{}, {"by": ["g"]}])
def test_many_blocks_of_queries_are_one_pass(spark, metric, options):
    """Two hundred blocks of queries are no more steps of the plan than two, and find what one block finds."""
    rng = random.Random(2)
    data = [(i, f"g{i % 3}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    data += [(400 + i, "g1", [1.0] * 8) for i in range(100)] + [(600, "g1", None), (601, "g1", [float("nan")] * 8), (602, "g1", [0.0] * 8)]
    corpus = spark.createDataFrame(data, "key int, g string, vector array<float>").repartition(5)
    queries = corpus.withColumnRenamed("key", "qid")
    few, many = (knn.knn_join(queries, corpus, 6, metric=metric, max_queries=n, **options) for n in (10_000, 3))
    assert plan(many).count("MapInArrow") == 1
    key = lambda df: rows(df.select("qid", "rank", "key", F.round("distance", 9)))
    assert key(many) == key(few)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_products_stay_in_the_cache_and_find_what_large_ones_find(metric, monkeypatch):
    """A product has no more pairs than a core's cache holds, whatever the sizes; pairs held back from tile to tile count."""
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(900, 8)), np.ones((40, 8))])
    side = lambda name: pa.table({name: np.arange(940), "vector": list(vectors)})
    opts = {"qid": "qid", "keys": ["key"], "vector": "vector", "k": 5, "metric": metric, "by": [], "scopes": None, "names": ["qid", "key", "distance"]}
    assert knn._CELLS * 4 <= 1 << 20
    monkeypatch.setattr(knn, "_CELLS", 64 * 50)
    sizes, multiply = [], np.matmul
    monkeypatch.setattr(knn.np, "matmul", lambda a, b, out: sizes.append(out.size) or multiply(a, b, out=out))
    found = knn._best(knn._Block(side("qid"), opts), knn._Chunk(side("key"), opts), opts).to_pandas()
    assert max(sizes) <= 64 * knn._QUERIES and len(sizes) > 10
    gaps = ((vectors[:, None] - vectors[None]) ** 2).sum(axis=2)
    if metric == "cosine":
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        gaps = 1 - unit @ unit.T
    true = np.argsort(gaps.round(9), axis=1, kind="stable")[:, :5]
    got = found.assign(d=found.distance.round(9)).sort_values(["qid", "d", "key"])
    assert (got.key.to_numpy().reshape(940, 5) == true).all()


def test_set_places_of_a_mask(spark):
    rng = np.random.default_rng(3)
    for shape in ((0, 5), (1, 3), (7, 13), (64, 64), (5, 0)):
        mask = rng.random(shape) < 0.1
        assert all((a == b).all() for a, b in zip(knn.places(mask), np.nonzero(mask)))


def test_heavy_keys_are_found_by_buckets(spark):
    """The first count has 64 groups a partition however many keys there are, and finds what counting every key finds."""
    df = spark.range(1000).selectExpr("IF(id < 600, 'most', IF(id < 750, NULL, concat('k', id))) AS key", "id")
    total, found = skew.hot_keys_by_buckets(df, ["key"], parts=10)
    assert total == 1000 and sorted(map(repr, found.collect())) == sorted(map(repr, skew.hot_keys(df, ["key"], parts=10).collect()))
    assert skew.hot_keys_by_buckets(df.where("id >= 750"), ["key"], parts=10) == (250, None)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sized_joins_have_partitions_for_their_rows(spark, skewed, how, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "key string, w int")
    for left in (skewed, skewed.where("key <> 'hot'")):
        n = -(-left.count() // 50)
        assert n > skew._parts(left)
        sized = skew.salted_join(left, right, ["key"], how, sized=True)
        assert "REPARTITION_BY_NUM" in plan(sized) and f", {n})" in plan(sized)
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(sized) == key(left.join(right, "key", how))


def test_merges_do_not_count_every_file_in_a_task(spark, monkeypatch):
    """An index of more rows than the session's partitions hold is sorted in more of them; the merge is the same."""
    target = spark.range(900).selectExpr("'p' AS project", "concat('f', id % 300) AS path", "'m' AS chunk_type", "concat('n', id) AS chunk_name")
    batch = target.where("path IN ('f1', 'f2')").where("chunk_name <> 'n1'").unionByName(
        spark.sql("SELECT 'p' AS project, 'f1' AS path, 'm' AS chunk_type, 'fresh' AS chunk_name"))
    cleared = spark.sql("SELECT 'p' AS project, 'f9' AS path")
    before = rows(index.merge_units(target, batch, cleared)), rows(index.merge_report(target, batch, cleared))
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    merged, report = index.merge_units(target, batch, cleared), index.merge_report(target, batch, cleared)
    assert "REPARTITION_BY_NUM" in plan(merged) and "REPARTITION_BY_NUM" in plan(report)
    assert (rows(merged), rows(report)) == before and before[1] == [(5, 1, 4)]


def test_a_text_is_folded_once_for_all_its_patterns(spark, monkeypatch):
    """The lower-cased text is a column of the texts; it is not made anew for each pattern that a text meets."""
    docs = spark.createDataFrame([("d/1", "Ein Straßenfest IN KÖLN\nzwei"), ("d/2", "nothing here"), ("d/3", None)], "path string, content string")
    asked = spark.createDataFrame([(1, "straßenfest"), (2, "fest in köln"), (3, "Nothing h"), (4, "absent words")], "qid int, query string")
    for fits in (True, False):
        monkeypatch.setattr(reading, "fits_broadcast", lambda *_, fits=fits, **__: fits)
        found = reading.grep(docs, asked)
        assert rows(found.select("qid", "path", "line")) == [(1, "d/1", 1), (2, "d/1", 1), (3, "d/2", 1)]
        assert "Contains(lower(content" not in plan(found) and "lower(content" in plan(found)


def test_words_are_hashed_where_they_are_counted(spark):
    """No word is hashed in a lambda of the plan; the vector is the words' counts by bucket, blank and null have none."""
    texts = ["a b  a\tC", "Ünï 你好 a", " ", None, "", "x" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = embed(df, "t")
    assert "md5" not in plan(made) and "ArrowEvalPython" in plan(made)
    got = {r.i: r.vector for r in made.collect()}
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        if not words:
            assert got[i] is None
            continue
        counts = np.zeros(64)
        for w in words:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 64] += 1
        assert got[i] == (counts / np.sqrt((counts * counts).sum())).astype(np.float32).tolist()
