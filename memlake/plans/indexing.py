"""Corpus indexing: clean, chunk, embed and tag documents, whole or only what changed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.chunking import MAX_CHARS, OVERLAP
from memlake.functions.embedding import Encoder, embed
from memlake.functions.exprs import is_blank
from memlake.functions.text import clean
from memlake.operators.index import delete_paths, upsert_by_path
from memlake.plans.registry import EXTRACTORS, chunk_column


class IndexTables(NamedTuple):
    documents: DataFrame
    chunks: DataFrame
    keywords: DataFrame | None


def clean_view(docs: DataFrame) -> DataFrame:
    """Documents as they are indexed and as passages are read back: cleaned text."""
    return docs.withColumn("content", clean("content"))


def chunk_documents(
    docs: DataFrame, max_chars: int = MAX_CHARS, overlap: float = OVERLAP
) -> DataFrame:
    """path, position, section, start_line, end_line, text of every chunk. Row-local, no shuffle."""
    chunks = chunk_column(F.col("path"), F.col("content"), max_chars, overlap)
    keep = [c for c in ("updated",) if c in docs.columns]
    exploded = docs.select("path", *keep, F.posexplode(chunks).alias("position", "c"))
    return exploded.select("path", "position", "c.*", *keep)


def keyword_rows(chunks: DataFrame, extractor: str = "identifiers") -> DataFrame:
    """path, lines, section, keywords (joined by blanks) and the terms that did not fit."""
    found = EXTRACTORS[extractor](F.col("section"), F.col("text"))
    keep = [F.col("updated").alias("extracted_at")] if "updated" in chunks.columns else []
    rows = chunks.select("path", "start_line", "end_line", "section", found.alias("_k"), *keep)
    return rows.withColumn("keywords", F.array_join(F.col("_k")["kept"], " ")).withColumn(
        "dropped", F.col("_k")["dropped"]
    ).drop("_k")


def build_index(
    docs: DataFrame, *, encode: Encoder | str = "hashed64", keywords: bool = True,
    max_chars: int = MAX_CHARS, overlap: float = OVERLAP,
) -> IndexTables:
    """All index tables from a scan. Blank documents have no vector and no chunks."""
    cleaned = clean_view(docs)
    keep = [c for c in ("updated",) if c in docs.columns]
    whole = embed(cleaned.where(~is_blank(F.col("content"))), "content", encode=encode)
    chunks = chunk_documents(cleaned, max_chars, overlap)
    lane = keyword_rows(chunks) if keywords else None
    return IndexTables(
        whole.select("path", *keep, "vector"), embed(chunks, "text", encode=encode, cap=None), lane
    )


def refresh_index(tables: IndexTables, docs: DataFrame, changed: DataFrame, **options) -> IndexTables:
    """Re-index exactly the changed paths; the rest of every table is carried over."""
    fresh = build_index(
        docs.join(changed.select("path").distinct(), "path", "left_semi"),
        keywords=tables.keywords is not None, **options,
    )
    swap = lambda old, new: _replace(old, new, changed)
    lane = swap(tables.keywords, fresh.keywords) if tables.keywords is not None else None
    return IndexTables(swap(tables.documents, fresh.documents), swap(tables.chunks, fresh.chunks), lane)


def _replace(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    kept, _ = delete_paths(old, changed, ["path"])
    return kept.unionByName(new.select(*old.columns))


def changed_paths(results: DataFrame) -> DataFrame:
    """Paths with at least one successful edit."""
    return results.where(F.col("status") == "success").select("path").distinct()


def reindex(docs: DataFrame, dry_run: bool = False, **options) -> IndexTables | DataFrame:
    """Replace the whole index from a scan. A dry run only counts what would be indexed."""
    if dry_run:
        return clean_view(docs).agg(
            F.count(F.lit(1)).alias("documents"), F.count_if(is_blank(F.col("content"))).alias("blank")
        )
    return build_index(docs.where(~_unreadable()), **options)


def _unreadable() -> Column:
    return F.col("path").isNull() | F.col("content").isNull()


def reindex_rejects(docs: DataFrame) -> DataFrame:
    """Documents that a reindex leaves out, with the reason; the others are indexed all the same."""
    reason = F.when(F.col("path").isNull(), "no path").otherwise("no content")
    return docs.where(_unreadable()).select("path", reason.alias("reason"))


def write_index(tables: IndexTables, root: str, files: int | None = None) -> IndexTables:
    """Write every table of an index below a folder and read it back; ``files`` compacts each of them."""
    spark = tables.documents.sparkSession
    written = []
    for name, df in zip(IndexTables._fields, tables):
        if df is not None:
            target = f"{root.rstrip('/')}/{name}"
            (df.repartition(files) if files else df).write.mode("overwrite").parquet(target)
            df = spark.read.schema(df.schema).parquet(target)
        written.append(df)
    return IndexTables(*written)


__all__ = [
    "IndexTables", "build_index", "changed_paths", "chunk_documents", "clean_view", "keyword_rows",
    "refresh_index", "reindex", "reindex_rejects", "upsert_by_path", "write_index",
]
