"""A stored index for nearest-neighbour search: rows in lists around centroids, partitioned by list.

A search reads only the lists it probes, as a partition filter, and ranks their rows by exact distances.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.operators.knn import METRICS, knn_join
from memlake.session import cut_lineage

#: Most lists of an index: they are folders, and their centroids go to every task.
MAX_LISTS = 4096
#: Most rows that the centroids are fitted on, those with the smallest hashed keys.
SAMPLE_ROWS = 100_000
ROUNDS = 10
#: Rows of the sample whose neighbours are looked up exactly to learn how many lists a recall takes.
MEASURED = 200
#: Distances are compared at nine digits.
_SLACK = 1e-6


@dataclass
class VectorIndex:
    """``rows``: the indexed columns, the vector and ``list``. ``lists``: list, centroid, radius, n, in list order.
    ``recall``: share of true neighbours in the nearest 1, 2, ... lists, as measured; ``metric`` as in ``knn_join``."""

    rows: DataFrame
    lists: pa.Table
    recall: list[float]
    metric: str
    vector: str

    @property
    def centroids(self) -> np.ndarray:
        return np.array(self.lists.column("centroid").to_pylist(), np.float64).reshape(self.lists.num_rows, -1)

    def probes_for(self, recall: float) -> int:
        """Fewest lists whose measured recall reaches the asked one; all lists if none does."""
        return next((p for p, r in enumerate(self.recall, 1) if r >= recall), self.lists.num_rows)


def _scaled(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances of unit vectors are twice their cosine distances."""
    if metric == "l2":
        return vectors
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _gaps(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    gaps = (vectors**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :] - 2.0 * (vectors @ centroids.T)
    return np.maximum(gaps, 0.0)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def fit_centroids(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds over a bounded sample, from some of its rows; an empty list takes the row farthest from its own."""
    sample = np.unique(sample, axis=0)
    n = min(n, len(sample))
    # A fixed shuffle, since the different rows come sorted.
    centroids = sample[np.random.default_rng(0).permutation(len(sample))[:n]]
    for _ in range(rounds):
        nearest, gap = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for at in range(0, len(sample), 4096):
            gaps = _gaps(sample[at : at + 4096], centroids)
            nearest[at : at + 4096], gap[at : at + 4096] = gaps.argmin(axis=1), gaps.min(axis=1)
        sizes = np.bincount(nearest, minlength=n)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids = sums / np.maximum(sizes, 1)[:, None]
        empty = np.flatnonzero(sizes == 0)
        centroids[empty] = sample[np.argsort(-gap)[: len(empty)]]
    return centroids


def _assigned(centroids: np.ndarray, metric: str):
    """A function from a vector column to struct(list, gap), the nearest centroid and the distance to it."""

    @F.arrow_udf("struct<list:int,gap:double>")
    def assign(vectors: pa.Array) -> pa.Array:
        found, gap = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for at in range(0, len(vectors), 1024):
            part = _matrix(vectors.slice(at, 1024), centroids.shape[1])
            gaps = _gaps(_scaled(part, metric), centroids)
            found[at : at + 1024] = gaps.argmin(axis=1)
            gap[at : at + 1024] = np.sqrt(gaps.min(axis=1))
        return pa.StructArray.from_arrays([pa.array(found), pa.array(gap)], ["list", "gap"])

    return assign


def write_vector_index(
    corpus: DataFrame, root: str, keys: Sequence[str], *, vector: str = "vector", metric: str = "l2",
    lists: int | None = None, sample_rows: int = SAMPLE_ROWS, k: int = 10,
) -> None:
    """Index every row that has a vector, below ``root``. ``keys`` identify a row.

    The centroids are fitted on at most about ``sample_rows`` rows, chosen by a hash of their keys; by default there
    are as many lists as the root of the rows, and ``MAX_LISTS`` at most. All rows are assigned to their nearest
    centroid inside the tasks, dealt out by ranges of list and hashed keys, so a list of any size is spread, and
    written with one folder for each list. The recall of the first ``k`` neighbours in the nearest lists is measured
    on rows of the sample against all rows and stored with the index.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark, keys = corpus.sparkSession, list(keys)
    held = corpus.where(F.col(vector).isNotNull())
    n = held.count()
    mark = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    picked = held.where(mark < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30)) + 1).select(*keys, vector)
    table = picked.toArrow()
    width = len(table.column(vector)[0]) if table.num_rows else 1
    sample = _matrix(table.column(vector).combine_chunks(), width) if table.num_rows else np.zeros((0, width))
    wanted = lists or max(1, min(MAX_LISTS, round(n**0.5)))
    centroids = fit_centroids(_scaled(sample, metric), min(wanted, MAX_LISTS)) if len(sample) else np.zeros((1, width))
    assign = _assigned(centroids, metric)
    placed = held.withColumn("_at", assign(F.col(vector)))
    rows = placed.select(*corpus.columns, F.col("_at")["list"].alias("list"), F.col("_at")["gap"].alias("_gap"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "list", F.xxhash64(*keys)).sortWithinPartitions("list")
    ranged.write.partitionBy("list").parquet(f"{root}/rows")
    stored = spark.read.parquet(f"{root}/rows") if n else rows
    facts = {r["list"]: r for r in stored.groupBy("list").agg(F.max("_gap").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    told = [
        (k_, c.tolist(), float(facts[k_]["r"]) if k_ in facts else 0.0, facts[k_]["n"] if k_ in facts else 0)
        for k_, c in enumerate(centroids)
    ]
    spark.createDataFrame(told, "list int, centroid array<double>, radius double, n long").coalesce(1).write.parquet(f"{root}/lists")
    recall = _measured(table, stored, centroids, keys, vector, metric, k) if n else []
    facts = [(metric, vector, recall, rows.drop("list").schema.json())]
    spark.createDataFrame(facts, "metric string, vector string, recall array<double>, schema string").coalesce(1).write.parquet(
        f"{root}/facts")


def _measured(table, stored, centroids, keys, vector, metric, k) -> list[float]:
    """Share of the true first k neighbours of some sampled rows that their nearest 1, 2, ... lists hold."""
    asked = table.slice(0, MEASURED)
    spark = stored.sparkSession
    queries = spark.createDataFrame(pa.table({"_q": np.arange(asked.num_rows), vector: asked.column(vector)}))
    true = knn_join(queries, stored, k, qid="_q", keys=[*keys, "list"], vector=vector, metric=metric).select("_q", "list").toArrow()
    near = _gaps(_scaled(_matrix(asked.column(vector).combine_chunks(), centroids.shape[1]), metric), centroids)
    place = near.argsort(axis=1, kind="stable").argsort(axis=1)
    at = place[true.column("_q").to_numpy(), true.column("list").to_numpy()]
    return (np.cumsum(np.bincount(at, minlength=len(centroids))) / max(len(at), 1)).tolist()


def read_vector_index(spark: SparkSession, root: str) -> VectorIndex:
    facts = spark.read.parquet(f"{root}/facts").first()
    lists = spark.read.parquet(f"{root}/lists").orderBy("list").toArrow()
    # An index without rows has no file to tell its columns.
    schema = T.StructType.fromJson(json.loads(facts["schema"])).add("list", T.IntegerType())
    rows = spark.read.schema(schema).parquet(f"{root}/rows")
    return VectorIndex(rows, lists, list(facts["recall"]), facts["metric"], facts["vector"])


def _probed(queries: DataFrame, index: VectorIndex, vector: str, wanted) -> DataFrame:
    """A row for every query and list that ``wanted`` (distances, radii, bounds of the queries -> mask) names."""
    centroids, metric = index.centroids, index.metric
    radii = index.lists.column("radius").to_numpy()
    full = index.lists.column("n").to_numpy() > 0
    if not full.any():
        return queries.withColumn("list", F.lit(0)).where(F.lit(False))

    @F.arrow_udf("array<int>")
    def name(vectors: pa.Array, bounds: pa.Array) -> pa.Array:
        gaps = _gaps(_scaled(_matrix(vectors, centroids.shape[1]), metric), centroids)
        mask = wanted(gaps, radii, full, bounds.to_numpy(zero_copy_only=False)) & full
        return pa.array([np.flatnonzero(row).tolist() for row in mask], pa.list_(pa.int32()))

    return queries.withColumn("list", F.explode(name(F.col(vector), F.col("_bound"))))


def _nearest(probes: int):
    def wanted(gaps, radii, full, bounds):
        gaps = np.where(full, gaps, np.inf)
        if probes >= gaps.shape[1]:
            return np.ones(gaps.shape, bool)
        return gaps <= np.partition(gaps, probes - 1, axis=1)[:, probes - 1 : probes]

    return wanted


def _may_hold_nearer(gaps, radii, full, bounds):
    """No row of a list is nearer than its centroid's distance less its radius."""
    least = np.maximum(np.sqrt(gaps) - radii, 0.0)
    return ~(least**2 > bounds[:, None] + _SLACK)


def search_vectors(
    queries: DataFrame, index: VectorIndex, k: int, *, qid: str = "qid", keys: Sequence[str] = ("key",),
    probes: int | None = None, recall: float | None = None, scopes: str | None = None, path: str = "path",
    first_probes: int = 4,
) -> DataFrame:
    """The ``k`` nearest indexed rows of every query, as ``knn_join`` returns them.

    With ``probes`` each query looks into its nearest lists only, with ``recall`` into as many as reached that recall
    when it was measured. With neither the result is exact: after ``first_probes`` lists a query goes on to every list
    that can hold a row nearer than its k-th so far, by the distance of the centroid and the list's radius. Lists that
    no query asks for are not read. Queries have the index's vector column and search below ``scopes`` if given.
    """
    keys, vector = list(keys), index.vector
    options = {"qid": qid, "keys": keys, "vector": vector, "metric": index.metric, "scopes": scopes, "path": path}
    asked = queries.where(F.col(vector).isNotNull()).withColumn("_bound", F.lit(float("inf")))
    if recall is not None:
        probes = index.probes_for(recall)
    found = _within(asked, index, k, _nearest(min(probes or first_probes, index.lists.num_rows)), options)
    if probes is not None:
        return found
    # A row without k neighbours yet has no bound, and the lists looked into first are looked into again.
    reached = found.groupBy(qid).agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("_reached"))
    bound = F.coalesce("_reached", F.lit(float("inf"))) + F.lit(_SLACK)
    bounded = asked.drop("_bound").join(reached, qid, "left").withColumn("_bound", bound).drop("_reached")
    return _within(cut_lineage(bounded), index, k, _may_hold_nearer, options)


def _reach(index: VectorIndex, wanted):
    """A function from vectors and bounds to a mask of the numbers of lists that they look into."""
    # Unit vectors: squared distances are twice the cosine distances.
    centroids, metric, scale = index.centroids, index.metric, 1.0 if index.metric == "l2" else 2.0
    radii, full = index.lists.column("radius").to_numpy(), index.lists.column("n").to_numpy() > 0

    def reach(vectors: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        found = np.zeros((len(vectors), len(centroids)), bool)
        for at in range(0, len(vectors), 1024):
            part = slice(at, at + 1024)
            gaps = _gaps(_scaled(vectors[part], metric), centroids)
            found[part] = wanted(gaps, radii, full, scale * bounds[part]) & full
        return found

    return reach


def _within(asked: DataFrame, index: VectorIndex, k: int, wanted, options: dict) -> DataFrame:
    """The k nearest rows of the lists that ``wanted`` names for each query; lists that none asks for are not read."""
    vector, reach, (n, width) = index.vector, _reach(index, wanted), index.centroids.shape
    if not any(index.lists.column("n").to_pylist()):
        asked = asked.where(F.lit(False))

    def named(batches):
        seen = np.zeros(n, bool)
        for batch in batches:
            if batch.num_rows:
                seen |= reach(_matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False)).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], names=["list"])

    lists = [r["list"] for r in asked.select(vector, "_bound").mapInArrow(named, "list int").distinct().collect()]
    return knn_join(asked, index.rows.where(F.col("list").isin(lists)), k, by=["list"], reach=reach, bound="_bound", **options)
