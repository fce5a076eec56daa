"""Stored postings for BM25: a search reads the buckets of its terms and skips what can't reach its best rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.exprs import let
from memlake.operators.retrieval import CHUNK_KEY, search_terms
from memlake.operators.skew import broadcast_if_small, salted_join, top_k_per_key
from memlake.session import cut_lineage

BUCKETS = 64
#: Postings of its rarest terms that a query scores first, to learn what its best rows reach at least.
FIRST_POSTINGS = 10_000
#: Scores are compared at nine digits.
_SLACK = 1e-6


@dataclass
class PostingIndex:
    """``postings``: bucket, term, impact and the keys. ``terms``: bucket, term, df and the largest impact, ``most``."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    buckets: int
    keys: list[str]


def _counted(bag: Column) -> Column:
    """Array of struct(term, tf), sorted by term; equal terms of a sorted array stand side by side."""
    def runs(s):
        last = F.size(s) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(s, i) != F.get(s, i + 1)))
        return let(ends, lambda e: F.transform(e, lambda i, j: F.struct(
            F.get(s, i).alias("term"), (i - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("tf"))))

    return F.when(F.size(bag) > 0, let(F.sort_array(bag), runs))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write_postings(
    corpus: DataFrame, root: str, keys: Sequence[str] = CHUNK_KEY, text: str = "keywords", *, buckets: int = BUCKETS,
    k1: float = 1.2, b: float = 0.75,
) -> None:
    """Write the postings of every row of the corpus below ``root``; ``keys`` identify a row.

    Terms are counted inside each row. Several tasks share a bucket by hashed keys, so a term that stands in most rows
    is no single task's work. Each task's postings lie in order of term and falling impact: the statistics of the files
    tell which parts hold a term and how much it can add. A row without terms counts in the mean length only.
    """
    spark, keys = corpus.sparkSession, list(keys)
    bags = corpus.select(*keys, search_terms(text).alias("_bag"))
    stats = bags.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("_bag")).alias("avg_len")).first()
    length = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.size("_bag") / F.lit(stats["avg_len"] or 1.0))
    found = bags.select(*keys, length.alias("_damp"), F.explode(_counted(F.col("_bag"))).alias("_t"))
    tf = F.col("_t")["tf"]
    postings = found.select(F.col("_t")["term"].alias("term"), (tf * (k1 + 1) / (tf + F.col("_damp"))).alias("impact"), *keys)
    order = ["bucket", "term", F.desc("impact")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64(*keys), F.lit(max(4, 2 * parts // buckets)))
    dealt = postings.withColumn("bucket", _bucket(buckets)).repartition(parts, "bucket", share)
    dealt.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{root}/postings")
    schema = f"term string, impact double, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in corpus.select(*keys).schema)}, bucket int"
    stored = spark.read.schema(schema).parquet(f"{root}/postings")
    terms = stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most"))
    terms.repartitionByRange(parts, "bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(
        f"{root}/terms")
    facts = [(stats["n_docs"], buckets, keys, schema)]
    spark.createDataFrame(facts, "n_docs long, buckets int, keys array<string>, schema string").coalesce(1).write.parquet(
        f"{root}/facts")


def read_postings(spark: SparkSession, root: str) -> PostingIndex:
    facts = spark.read.parquet(f"{root}/facts").first()
    terms = spark.read.schema("term string, df long, most double, bucket int").parquet(f"{root}/terms")
    postings = spark.read.schema(facts["schema"]).parquet(f"{root}/postings")
    return PostingIndex(postings, terms, facts["n_docs"], facts["buckets"], list(facts["keys"]))


def _parts(postings: DataFrame, weights: DataFrame, index: PostingIndex, qid: str, path: str, keep: Column | None) -> DataFrame:
    """qid, keys and part, the share of the score that a posting adds, for all postings of the weighted terms."""
    # Only few weights are known to be few: beyond the bound postings and weights meet by a spread join.
    small = broadcast_if_small(weights)
    joined = postings.join(small, ["bucket", "term"]) if small is not weights else salted_join(
        postings, weights, ["bucket", "term"], spread=index.keys)
    joined = joined.withColumn("_part", F.col("impact") * F.col("_idf"))
    if "_scopes" in weights.columns:
        inside = F.exists("_scopes", lambda s: F.startswith(F.col(path), F.concat(s, F.lit("/"))))
        joined = joined.where((F.size(F.coalesce("_scopes", F.array())) == 0) | inside)
    if keep is not None:
        joined = joined.where(keep)
    return joined.select(qid, *index.keys, "_part")


def bm25_postings(
    queries: DataFrame, index: PostingIndex, k: int, *, qid: str = "qid", query: str = "query", scopes: str | None = None,
    path: str = "path", first_postings: int = FIRST_POSTINGS,
) -> DataFrame:
    """Top-k rows per query by BM25 as ``bm25`` returns them: qid, keys, score, rank.

    Only the buckets of the queries' terms are read. A query first scores the postings of its rarest terms, up to about
    ``first_postings``; its k-th row so far is a bound that the k-th best row reaches. The terms that cannot lift a
    row to the bound all together, the most common ones as a rule, then bring no rows of their own, and postings whose
    impact with all other terms at their best stays below it are skipped. What is left is scored in full, so the
    result is exact. Queries without a known term find nothing.
    """
    asked = queries.select(
        qid, F.explode(F.array_distinct(search_terms(query))).alias("term"), *([F.col(scopes).alias("_scopes")] if scopes else [])
    ).withColumn("bucket", _bucket(index.buckets))
    n, df = F.lit(index.n_docs), F.col("df")
    terms = index.terms.join(broadcast_if_small(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    weights = asked.join(terms, ["bucket", "term"]).withColumn("_idf", idf).withColumn("_top", F.col("_idf") * F.col("most"))
    # All windows are over the terms of one query.
    rare = Window.partitionBy(qid).orderBy("df", "term")
    weak = Window.partitionBy(qid).orderBy("_top", "term")
    weights = cut_lineage(
        weights.withColumn("_before", F.sum("df").over(rare) - df).withColumn("_upto", F.sum("_top").over(weak))
        .withColumn("_all", F.sum("_top").over(Window.partitionBy(qid)))
    )
    buckets = [r["bucket"] for r in weights.select("bucket").distinct().collect()]
    postings = index.postings.where(F.col("bucket").isin(buckets))
    scored = lambda parts: parts.groupBy(qid, *index.keys).agg(F.sum("_part").alias("score"))
    cols = ["bucket", "term", qid, "_idf", *(["_scopes"] if scopes else [])]

    first = scored(_parts(postings, weights.where(F.col("_before") < first_postings).select(cols), index, qid, path, None))
    best = top_k_per_key(first, [qid], [F.desc("score")], k)
    bound = best.groupBy(qid).agg(F.when(F.count(F.lit(1)) == k, F.min("score") - _SLACK).alias("_bound"))
    weights = cut_lineage(weights.join(bound, qid, "left").withColumn("_bound", F.coalesce("_bound", F.lit(0.0))))
    strong = weights.where(F.col("_upto") >= F.col("_bound"))
    rest = weights.where(F.col("_upto") < F.col("_bound"))

    reaches = F.col("_part") + F.col("_all") - F.col("_top") >= F.col("_bound")
    some = scored(_parts(postings, strong.select(*cols, "_all", "_top", "_bound"), index, qid, path, reaches))
    weakest = weights.groupBy(qid).agg(
        F.first("_bound").alias("_bound"), F.sum(F.when(F.col("_upto") < F.col("_bound"), F.col("_top")).otherwise(0.0)).alias("_more"))
    candidates = cut_lineage(
        some.join(broadcast_if_small(weakest), qid).where(F.col("score") + F.col("_more") >= F.col("_bound"))
        .select(qid, *index.keys, F.col("score").alias("_part"))
    )
    # A row comes with the queries that may still take it, so a part that none of them asks for goes before any shuffle.
    held = broadcast_if_small(candidates.groupBy(*index.keys).agg(F.collect_list(qid).alias("_asked")))
    # Common terms are looked up for the rows that are left, and for no others.
    near = postings.join(held, index.keys)
    added = _parts(near, rest.select(cols), index, qid, path, F.array_contains("_asked", F.col(qid)))
    total = scored(candidates.unionByName(added))
    return top_k_per_key(total, [qid], [F.desc(F.round("score", 9)), *index.keys], k)
