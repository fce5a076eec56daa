"""Search plans: sections, hybrid, cascade, tasks and code, for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.embedding import Encoder, embed
from memlake.functions.text import snippet
from memlake.operators.code import code_prefilter
from memlake.operators.index import fill_section
from memlake.operators.knn import knn_join
from memlake.operators.postings import PostingIndex, bm25_postings
from memlake.operators.reading import GREP_CAP, grep
from memlake.operators.retrieval import CHUNK_KEY, CHUNK_ROW, bm25, hydrate, rrf
from memlake.operators.skew import asked_for, salted_join, top_k_per_key
from memlake.operators.vector_index import VectorIndex, search_vectors
from memlake.session import cut_lineage

# Default numbers of results.
TOP_SECTIONS = 5
TOP_TASKS = 5
TOP_CODE = 10
CASCADE_DOCUMENTS = 10


def _with_vectors(queries: DataFrame, encode: Encoder | str) -> DataFrame:
    """Queries with vectors; a blank query finds nothing in the vector lane."""
    if "vector" in queries.columns:
        return queries
    return embed(queries, "query", encode=encode, cap=None)


def vector_sections(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_SECTIONS, *, encode: Encoder | str = "hashed64",
    scopes: str | None = None, metric: str = "l2", probes: int | None = None, recall: float | None = None,
) -> DataFrame:
    """Nearest chunks per query with their section name.

    ``chunks`` is a table of chunks with vectors, or a ``VectorIndex`` of one: then ``probes`` or ``recall`` may limit
    the lists that a query looks into, and ``metric`` is the index's.
    """
    asked = _with_vectors(queries, encode)
    if isinstance(chunks, VectorIndex):
        return search_vectors(asked, chunks, k, keys=CHUNK_ROW, scopes=scopes, probes=probes, recall=recall)
    return knn_join(asked, chunks, k, keys=CHUNK_ROW, scopes=scopes, metric=metric)


def search_sections(queries: DataFrame, chunks: DataFrame | VectorIndex, docs: DataFrame, k: int = TOP_SECTIONS,
                    **options) -> DataFrame:
    """Nearest chunks, or indexed chunks, with their live lines. ``docs`` is the view the chunks were cut from."""
    hits = vector_sections(queries, chunks, k, **options)
    return hydrate(hits, docs, spread=["qid", "rank"])


def hybrid_search(
    queries: DataFrame, chunks: DataFrame | VectorIndex, keywords: DataFrame | PostingIndex | None, docs: DataFrame | None = None,
    k: int = TOP_SECTIONS, *, encode: Encoder | str = "hashed64", scopes: str | None = None,
) -> DataFrame:
    """Vector lane and keyword lane fused; without a keyword table the vector lane alone.

    Either lane may be a stored index: a ``VectorIndex`` of the chunks, a ``PostingIndex`` of their keywords.
    """
    vector = vector_sections(queries, chunks, k, encode=encode, scopes=scopes)
    if keywords is None:
        fused = vector.withColumn("match", F.lit("vector"))
    else:
        stored = isinstance(keywords, PostingIndex)
        keys = keywords.keys if stored else CHUNK_ROW if "section" in keywords.columns else CHUNK_KEY
        lane = bm25_postings(queries, keywords, k, scopes=scopes) if stored else bm25(queries, keywords, k, keys=keys, scopes=scopes)
        fused = rrf(vector, lane.drop("score").withColumn("distance", F.lit(0.0)), k)
        rows = chunks.rows if isinstance(chunks, VectorIndex) else chunks
        fused = fused if "section" in keys else fill_section(fused, rows)
    return fused if docs is None else hydrate(fused, docs, spread=["qid", "rank"])


def cascade(
    queries: DataFrame, documents: DataFrame, docs: DataFrame, *, encode: Encoder | str = "hashed64",
    n_documents: int = CASCADE_DOCUMENTS, cap: int = GREP_CAP,
) -> DataFrame:
    """Per query the nearest documents with a snippet, then grep lines, ``cap`` rows in all."""
    near = cut_lineage(knn_join(_with_vectors(queries, encode), documents, n_documents, keys=["path"]))
    heads = docs.select("path", snippet("content").alias("content"))
    semantic = salted_join(near, asked_for(heads, near, ["path"]), ["path"], "left", spread=["qid", "rank"]).select(
        "qid", F.lit(0).alias("lane"), F.col("rank").alias("nth"), "path", F.lit(1).alias("line"),
        F.coalesce("content", F.lit("[Semantic vector match in file] (Read file for details)")).alias("content"),
        "distance",
    )
    lines = grep(docs, queries, cap).select(
        "qid", F.lit(1).alias("lane"), F.lit(0).alias("nth"), "path", "line", "content",
        F.lit(None).cast("double").alias("distance"),
    )
    both = semantic.unionByName(lines)
    return top_k_per_key(both, ["qid"], ["lane", "nth", "path", "line"], cap).drop("nth")


def search_tasks_semantic(
    queries: DataFrame, tasks: DataFrame, k: int = TOP_TASKS, *, encode: Encoder | str = "hashed64"
) -> DataFrame:
    """Nearest tasks by title and problem: qid, key, title, status, score (a distance)."""
    corpus = tasks
    if "vector" not in tasks.columns:
        text = F.concat_ws(" ", "title", "problem")
        corpus = embed(tasks.withColumn("_text", text), "_text", encode=encode).drop("_text")
    near = knn_join(_with_vectors(queries, encode), corpus, k, keys=["key"])
    return near.join(tasks.select("key", "title", "status"), "key").select(
        "qid", "rank", "key", "title", "status", F.col("distance").alias("score")
    )


def search_code(
    queries: DataFrame, units: DataFrame, k: int = TOP_CODE, *, encode: Encoder | str = "hashed64",
    project: str | None = None, chunk_type: str | None = None, include_tests: bool = False,
    root: str | None = None,
) -> DataFrame:
    """Nearest code units after the prefilter, without their vectors."""
    seen = code_prefilter(units, project, chunk_type, include_tests, root)
    keys = ["project", "path", "chunk_type", "chunk_name"]
    near = knn_join(_with_vectors(queries, encode), seen, k, keys=keys)
    facts = seen.select(*keys, "skeleton_text", "start_line", "end_line")
    return near.join(facts, keys)
