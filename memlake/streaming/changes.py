"""Change events: routing, debouncing and incremental index upkeep."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.functions.paths import has_extension
from memlake.operators.skew import bucketed
from memlake.plans.indexing import build_index
from memlake.session import cut_lineage
from memlake.sources.buckets import BUCKETS, replace_paths

# Quiet time before a changed file is taken up, and how late an event may be.
GAP_SECONDS = 7
WATERMARK = "1 hour"


def route_events(events: DataFrame, exts: Sequence[str]) -> DataFrame:
    """Watcher events as index operations: operation (upsert or delete), path, ts.

    Directories are ignored. A move is a delete of the old and an upsert of the new path, each only
    when its own extension is wanted. Works on tables and streams alike.
    """
    src, dst = F.col("src_path"), F.col("dest_path")
    kind = F.col("event_type")
    op = lambda name, path, on: F.when(
        on & has_extension(path, exts), F.struct(F.lit(name).alias("operation"), path.alias("path"))
    )
    operations = F.array_compact(
        F.array(
            op("delete", src, kind.isin("deleted", "moved")),
            op("upsert", src, kind.isin("created", "modified")),
            op("upsert", dst, kind == "moved"),
        )
    )
    keep = [c for c in events.columns if c not in ("event_type", "src_path", "dest_path", "is_directory")]
    return events.where(~F.col("is_directory")).select(*keep, F.inline(operations))


def debounce(
    events: DataFrame, gap_seconds: float = GAP_SECONDS, path: str = "path", ts: str = "ts",
    watermark: str = WATERMARK,
) -> DataFrame:
    """One row per burst of changes of a path: path, first_ts, last_ts, n.

    A burst ends when nothing happened for the gap; changes exactly one gap apart belong together.
    On a stream a burst comes out once the watermark has passed its end.
    """
    if events.isStreaming:
        return _debounce_stream(events, gap_seconds, path, ts, watermark)
    return _debounce_table(events, gap_seconds, path, ts)


def _debounce_stream(events, gap_seconds, path, ts, watermark) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    burst = F.session_window(ts, f"{gap_seconds} seconds")
    return (
        timed.groupBy(burst, path)
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
        .select(path, "first_ts", "last_ts", "n")
    )


def _debounce_table(events, gap_seconds, path, ts) -> DataFrame:
    """Bursts inside (path, time share) first; only those at the edge of a share are joined on."""
    gap = int(round(gap_seconds * 1_000_000))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    data = bucketed(events.select(path, micros.alias("_t")), "_t")
    cell = Window.partitionBy(path, "_bucket").orderBy("_t")
    opens = F.coalesce((F.col("_t") - F.lag("_t").over(cell) > gap).cast("int"), F.lit(1))
    marked = data.withColumn("_open", opens).withColumn("_nth", F.sum("_open").over(cell))
    parts = marked.groupBy(path, "_bucket", "_nth").agg(
        F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    whole_cell = Window.partitionBy(path, "_bucket")
    parts = parts.withColumn("_last", F.max("_nth").over(whole_cell))
    edge = (F.col("_nth") == 1) | (F.col("_nth") == F.col("_last"))
    along = Window.partitionBy(path).orderBy("_bucket", "_nth")
    chain = F.coalesce((F.col("_a") - F.lag("_b").over(along) > gap).cast("int"), F.lit(1))
    edges = parts.where(edge).withColumn("_open", chain).withColumn("_chain", F.sum("_open").over(along))
    joined = edges.groupBy(path, "_chain").agg(
        F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("_n").alias("_n")
    )
    inner = parts.where(~edge).select(path, "_a", "_b", "_n")
    return inner.unionByName(joined.select(path, "_a", "_b", "_n")).select(
        path, F.timestamp_micros("_a").alias("first_ts"), F.timestamp_micros("_b").alias("last_ts"),
        F.col("_n").alias("n"),
    )


def debounced_operations(
    routed: DataFrame, gap_seconds: float = GAP_SECONDS, watermark: str = WATERMARK
) -> DataFrame:
    """Deletes at once, upserts after their burst: operation, path, ts."""
    upserts = debounce(routed.where("operation = 'upsert'"), gap_seconds, watermark=watermark)
    later = upserts.select(F.lit("upsert").alias("operation"), "path", F.col("last_ts").alias("ts"))
    now = routed.where("operation = 'delete'").select("operation", "path", F.col("ts").cast("timestamp").alias("ts"))
    return now.unionByName(later)


def latest_operation(batch: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """The last operation per path; at the same instant a delete stands."""
    newest = F.max_by("operation", F.struct("ts", (F.col("operation") == "delete").alias("d")))
    return batch.groupBy(*on).agg(newest.alias("operation"), F.max("ts").alias("ts"))


def maintain_index(
    operations: DataFrame, root: str, load_units: Callable[[DataFrame], DataFrame],
    checkpoint: str, on: Sequence[str] = ("path",), buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Keep the table of units at ``root``, begun with ``start_table``, up to date from a stream of operations.

    A micro-batch writes the buckets of the paths it changes and no others. A file is replaced whole, so a batch that
    is run again after a failure leads to the same state.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        latest = cut_lineage(latest_operation(batch, on))
        wanted = latest.where("operation = 'upsert'").select(*on)
        replace_paths(load_units(wanted), latest, root, on, buckets)

    writer = operations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def refresh_documents(
    changed: DataFrame, root: str, load_docs: Callable[[DataFrame], DataFrame], checkpoint: str,
    encode="hashed64", buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Keep the tables documents, chunks and keywords below ``root``, begun with ``start_table``, up to date from a
    stream of changed paths. A micro-batch indexes the documents it names and writes their buckets only."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        paths = cut_lineage(batch.select("path").distinct())
        for name, rows in build_index(load_docs(paths), encode=encode)._asdict().items():
            replace_paths(rows, paths, f"{root}/{name}", buckets=buckets)

    writer = changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
