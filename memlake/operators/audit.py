"""Integrity audit, embedding drift, index profile and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.vectors import cosine

# Drift gate and the number of failed deliveries that raises the alarm.
MEAN_GATE = 0.999
MIN_GATE = 0.99
FAILED_ALARM = 100


def audit(index: DataFrame, docs: DataFrame, path: str = "file_path") -> DataFrame:
    """Findings of an index against its documents: path, key, finding, field, index_value, doc_value.

    ``index`` has key, file_path, status and title; ``docs`` has file_path, status, title and may
    carry an ``error`` for documents that could not be read.
    """
    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    left = index.select(path, "key", F.col("status").alias("_is"), F.col("title").alias("_it"),
                        F.lit(True).alias("_in_index"))
    right = docs.select(path, F.col("status").alias("_ds"), F.col("title").alias("_dt"),
                        error.alias("_err"), F.lit(True).alias("_in_docs"))
    text = lambda c: F.lit(c).cast("string") if c is None else c

    def finding(name, field, mine, theirs):
        return F.struct(
            F.lit(name).alias("finding"), F.lit(field).cast("string").alias("field"),
            text(mine).alias("index_value"), text(theirs).alias("doc_value"),
        )

    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    both = F.col("_in_index").isNotNull() & F.col("_in_docs").isNotNull()
    readable = both & F.col("_err").isNull()
    found = F.array(
        F.when(F.col("_in_docs").isNull(), finding("orphan", None, None, None)),
        F.when(F.col("_in_index").isNull(), finding("dangling", None, None, None)),
        F.when(both & F.col("_err").isNotNull(), finding("unreadable", None, None, F.col("_err"))),
        F.when(readable & differs("_is", "_ds"), finding("mismatch", "status", F.col("_is"), F.col("_ds"))),
        F.when(readable & differs("_it", "_dt"), finding("mismatch", "title", F.col("_it"), F.col("_dt"))),
    )
    rows = left.join(right, path, "full_outer")
    return rows.select(path, "key", F.inline(F.array_compact(found)))


def audit_summary(index: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: healthy or unhealthy, counts per kind, number of index rows."""
    total = index.agg(F.count(F.lit(1)).alias("n")).scalar()
    kind = F.col("finding")
    counts = findings.agg(
        F.count_if(kind == "orphan").alias("orphans"),
        F.count_if(kind == "dangling").alias("dangling"),
        F.count_if(kind.isin("mismatch", "unreadable")).alias("inconsistencies"),
    )
    bad = F.col("orphans") + F.col("dangling") + F.col("inconsistencies")
    return counts.select(
        F.when(bad == 0, "healthy").otherwise("unhealthy").alias("status"),
        "orphans", "dangling", "inconsistencies", total.alias("total_index_records"),
    )


def drift_pairs(current: DataFrame, baseline: DataFrame, key: str = "key", vector: str = "vector") -> DataFrame:
    """Cosine of every key's current and baseline vector."""
    now = current.select(key, F.col(vector).alias("_now"))
    old = baseline.select(key, F.col(vector).alias("_old"))
    return now.join(old, key).select(key, cosine("_now", "_old").alias("cosine"))


def embedding_drift(
    current: DataFrame, baseline: DataFrame, key: str = "key", vector: str = "vector",
    mean_gate: float = MEAN_GATE, min_gate: float = MIN_GATE,
) -> DataFrame:
    """One row: pairs, mean and lowest cosine, whether the gate holds."""
    stats = drift_pairs(current, baseline, key, vector).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("cosine").alias("mean_cosine"),
        F.min("cosine").alias("min_cosine"),
    )
    ok = (F.col("mean_cosine") >= mean_gate) & (F.col("min_cosine") >= min_gate)
    return stats.withColumn("passed", F.coalesce(ok, F.lit(False)))


def profile_index(units: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """Counts per project: rows, file rows, test and other rows, and their combinations."""
    is_file, test = F.col("chunk_type") == "file", F.col("is_test")
    return units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_file).alias("files"),
        F.count_if(test).alias("tests"),
        F.count_if(~test).alias("not_tests"),
        F.count_if(is_file & ~test).alias("files_not_tests"),
    )


def profile_sample(units: DataFrame, n: int = 5) -> DataFrame:
    """A few rows of an index for the eye, always the same ones."""
    cols = ["project", "path", "chunk_type", "chunk_name", "is_test"]
    return units.select(*cols).orderBy(*cols).limit(n)


def failed_alarm(ledger: DataFrame, threshold: int = FAILED_ALARM) -> DataFrame:
    """One row: failed deliveries and whether there are too many."""
    failed = F.count_if(F.col("status") == "failed")
    return ledger.agg(failed.alias("failed"), (failed >= threshold).alias("alarm"))


def run_report(steps: DataFrame, keep_errors: int = 100) -> DataFrame:
    """One row for a run: steps, created, skipped, failed, and the first error messages.

    ``steps`` has step, outcome (created, skipped, error) and message. All errors are counted; the
    message list is cut before it is gathered, and the full list is ``errors_of``.
    """
    totals = steps.agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )
    first = errors_of(steps).orderBy("step", "message").limit(keep_errors)
    listed = first.agg(F.array_sort(F.collect_list(F.concat_ws(": ", "step", "message"))).alias("m"))
    return totals.withColumn("ok", F.col("errors") == 0).withColumn(
        "messages", F.array_join(listed.scalar(), "\n")
    )


def errors_of(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("outcome") == "error").select("step", "message")
