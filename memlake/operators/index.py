"""Index tables: per-file merges, renames, pruning, deletes and snapshot writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.skew import broadcast_if_small, dealt_by_rows, salted_join
from memlake.session import cut_lineage

FILE_KEY = ("project", "path")


def _drop_keys(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Target rows whose key is not listed. Rows of one file may be many, so they stay spread."""
    on = list(on)
    listed = keys.select(*on).distinct()
    return salted_join(target, listed, on, "left_anti", spread=target.columns, sized=True).select(*target.columns)


def _keep_keys(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    on = list(on)
    listed = keys.select(*on).distinct()
    return salted_join(target, listed, on, "left_semi", spread=target.columns, sized=True).select(*target.columns)


def merge_units(
    target: DataFrame, batch: DataFrame, cleared: DataFrame | None = None, on: Sequence[str] = FILE_KEY
) -> DataFrame:
    """New state of an index after a batch of whole files.

    A file of the batch ends up with exactly the rows of the batch; a file listed in ``cleared``
    ends up with none; every other file is untouched.
    """
    on = list(on)
    touched = batch.select(*on)
    if cleared is not None:
        touched = touched.unionByName(cleared.select(*on))
    return _drop_keys(target, touched, on).unionByName(batch.select(*target.columns))


def merge_report(
    target: DataFrame, batch: DataFrame, cleared: DataFrame | None = None,
    on: Sequence[str] = FILE_KEY, row_key: Sequence[str] = ("chunk_type", "chunk_name"),
) -> DataFrame:
    """What a merge does, as one row of counts: updated, inserted, deleted."""
    on, full = list(on), [*on, *row_key]
    # Written once: the batch is counted, names the touched files and is compared.
    new = cut_lineage(batch.select(*full, F.lit(1).alias("n")))
    touched = new.select(*on)
    if cleared is not None:
        touched = touched.unionByName(cleared.select(*on))
    old = _keep_keys(target, touched, on).select(*full, F.lit(1).alias("o"))
    rows = max(target.count(), new.count())
    both = dealt_by_rows(old, full, rows).join(dealt_by_rows(new, full, rows), full, "full_outer")
    return both.agg(
        F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("updated"),
        F.count_if(F.col("o").isNull()).alias("inserted"),
        F.count_if(F.col("n").isNull()).alias("deleted"),
    )


def upsert_by_path(target: DataFrame, updates: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Delete-then-insert per path: updated paths keep only their new rows."""
    return merge_units(target, updates, on=on)


def delete_paths(
    target: DataFrame, keys: DataFrame, on: Sequence[str] = FILE_KEY
) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, number of rows deleted per key)."""
    gone = _keep_keys(target, keys, on).groupBy(*on).agg(F.count(F.lit(1)).alias("deleted"))
    return _drop_keys(target, keys, on), gone


def rename_paths(
    index: DataFrame, renames: DataFrame, path: str = "path"
) -> tuple[DataFrame, DataFrame]:
    """(index with old paths replaced, renames that had no rows and need indexing anew).

    ``renames`` has old_path and new_path. Rows that were at a new path
    before give way. Of several new paths for one old path the first in order is taken, and so is the first of several
    old paths for one new path, so that no two documents become one; the other renames come back for indexing, and
    nothing stays at their old paths.
    """
    first = renames.groupBy("old_path").agg(F.min("new_path").alias("new_path"))
    taken = first.groupBy("new_path").agg(F.min("old_path").alias("old_path")).select("old_path", "new_path")
    moves = broadcast_if_small(taken)
    on_old = F.col(path) == F.col("old_path")
    moved = index.join(moves, on_old).withColumn(path, F.col("new_path")).select(*index.columns)
    reached = taken.select(F.col("new_path").alias(path)).unionByName(renames.select(F.col("old_path").alias(path)))
    vacated = broadcast_if_small(reached.distinct())
    staying = index.join(vacated, path, "left_anti").select(*index.columns)
    known = index.select(F.col(path).alias("old_path")).distinct()
    done = taken.join(known, "old_path", "left_semi")
    fallback = renames.select("old_path", "new_path").join(done, ["old_path", "new_path"], "left_anti")
    return staying.unionByName(moved), fallback


#: How a table tells which paths are alive: any DataFrame in, a ``path`` column out.
EXISTENCE: dict[str, Callable[[DataFrame], DataFrame]] = {"table": lambda live: live.select("path")}


def register_existence(name: str, strategy: Callable[[DataFrame], DataFrame]) -> None:
    EXISTENCE[name] = strategy


def prune_ghosts(
    tables: dict[str, DataFrame], live: DataFrame, path: str = "path", by: str = "chunks",
    existence: str = "table",
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(index tables without rows of vanished documents, the vanished paths).

    ``by`` names the table whose paths decide; the same paths go from every table. ``existence`` is the
    registered strategy that reads the living paths from ``live``.
    """
    alive = EXISTENCE[existence](live).select(F.col("path").alias(path)).distinct()
    known = tables[by].select(path).distinct()
    ghosts = known.join(alive, path, "left_anti")
    kept = {name: _drop_keys(df, ghosts, [path]) for name, df in tables.items()}
    return kept, ghosts


def chunk_keywords(
    chunks: DataFrame, keywords: DataFrame, on: Sequence[str] = ("path", "start_line", "end_line")
) -> DataFrame:
    """Chunks with their keywords and a state: missing, empty or extracted."""
    lane = keywords.select(*on, F.col("keywords"), F.lit(True).alias("_seen"))
    state = (
        F.when(F.col("_seen").isNull(), "missing")
        .when(F.coalesce("keywords", F.lit("")) == "", "empty")
        .otherwise("extracted")
    )
    return chunks.join(lane, list(on), "left").withColumn("keyword_state", state).drop("_seen")


def fill_section(
    hits: DataFrame, chunks: DataFrame, on: Sequence[str] = ("path", "start_line", "end_line")
) -> DataFrame:
    """Give keyword-only hits the section name of their chunk, the first one of those lines."""
    names = chunks.groupBy(*on).agg(F.min("section").alias("_section"))
    base = hits if "section" in hits.columns else hits.withColumn("section", F.lit(None).cast("string"))
    own = F.nullif(F.col("section"), F.lit(""))
    return (
        base.join(names, list(on), "left")
        .withColumn("section", F.coalesce(own, F.col("_section"), F.lit("")))
        .drop("_section")
    )
