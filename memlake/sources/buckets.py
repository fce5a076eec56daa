"""Plain tables that change by paths: Parquet in folders by a hash of the path, of which a change writes its own only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.skew import broadcast_if_small
from memlake.session import cut_lineage

BUCKETS = 256
_PER_FILE = 1_000_000


def bucket_of(on: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, on: Sequence[str], buckets: int, touched: list[int]) -> None:
    """Write whole buckets. A row without content opens each of them, so that one without rows left is written too."""
    spark = rows.sparkSession
    placed = rows.select("*", F.lit(True).alias("_live"), bucket_of(on, buckets).alias("bucket"))
    empty = spark.createDataFrame([(b,) for b in touched], "bucket int").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], F.lit(False).alias("_live"), "bucket")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A path with very many rows is spread over the tasks by the rows themselves.
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(max(1, parts // max(len(touched), 1))))
    dealt = placed.unionByName(empty).repartition(parts, "bucket", spread)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", _PER_FILE).partitionBy(
        "bucket").parquet(root)


def start_table(rows: DataFrame, root: str, on: Sequence[str] = ("path",), buckets: int = BUCKETS) -> None:
    """Write the first state of a table; rows with equal ``on`` are in one bucket."""
    _write(rows, root, on, buckets, list(range(buckets)))


def read_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).where("_live").drop("_live", "bucket")


def replace_paths(
    rows: DataFrame, touched: DataFrame, root: str, on: Sequence[str] = ("path",), buckets: int = BUCKETS
) -> None:
    """Give the touched paths the new ``rows`` and no others: delete, then insert.

    Only the buckets of touched paths are read and written anew, by dynamic partition overwrite; the files of all
    others stay as they are. The new state is complete before it replaces the old one, and a change that is run again
    leads to the same rows. One writer at a time.
    """
    spark, on = rows.sparkSession, list(on)
    paths = cut_lineage(touched.select(*on).distinct())
    numbers = [r["b"] for r in paths.select(bucket_of(on, buckets).alias("b")).distinct().collect()]
    if not numbers:
        return
    held = spark.read.parquet(root).where(F.col("bucket").isin(numbers)).where("_live").drop("_live", "bucket")
    kept = held.join(broadcast_if_small(paths), on, "left_anti")
    fresh = rows.join(broadcast_if_small(paths), on, "left_semi")
    _write(cut_lineage(kept.unionByName(fresh.select(*held.columns))), root, on, buckets, numbers)
