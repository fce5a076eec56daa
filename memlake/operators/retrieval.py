"""BM25, rank fusion, hydration and the small rules around search results."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.exprs import col, join_lines, split_lines
from memlake.functions.paths import ancestors
from memlake.operators.knn import PathTree, keep_best, pick_smallest, query_blocks
from memlake.operators.skew import asked_for, broadcast_if_small, salted_join, top_k_per_key
from memlake.session import cut_lineage

CHUNK_KEY = ("path", "start_line", "end_line")
# Windows of one long line share their line numbers; the section tells them apart.
CHUNK_ROW = (*CHUNK_KEY, "section")
# Fixed value: rank constant of the fusion.
RRF_K = 60


def search_terms(text: Column | str) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


def bm25_stats(corpus: DataFrame, text: str = "keywords") -> DataFrame:
    """One row: number of rows and mean length in terms."""
    return corpus.select(F.size(search_terms(text)).alias("dl")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len")
    )


def document_frequency(
    corpus: DataFrame, text: str = "keywords", only: DataFrame | None = None
) -> DataFrame:
    """Rows per term, optionally for the terms of ``only``; combined before the shuffle."""
    terms = corpus.select(F.explode(F.array_distinct(search_terms(text))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Counted first, so that a term in most rows is one row when it meets the others.
    return counts if only is None else counts.join(only, "term", "left_semi")


# Most weights (queries times their distinct terms) that one block of queries shares with the tasks, about 80 MB.
MAX_WEIGHTS = 10_000_000


def bm25(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    qid: str = "qid",
    query: str = "query",
    keys: Sequence[str] = CHUNK_KEY,
    text: str = "keywords",
    scopes: str | None = None,
    path: str = "path",
    k1: float = 1.2,
    b: float = 0.75,
    max_weights: int = MAX_WEIGHTS,
    stats: DataFrame | None = None,
    frequency: DataFrame | None = None,
) -> DataFrame:
    """Top-k corpus rows per query by BM25: qid, keys, score, rank. ``keys`` identify a row.

    Equal scores (to nine digits) are ordered by ``keys``. The weights of the queries go to the tasks
    that scan the corpus, in blocks of at most about ``max_weights`` queries times distinct terms and one
    scan for each block: rows are scored by matrix products and a task hands on at most k rows per query,
    so no posting is shuffled. ``stats`` and ``frequency`` are the results of ``bm25_stats`` and
    ``document_frequency`` as stored with an index; without them the corpus is read for them.
    """
    keys = list(keys)
    asked = queries.select(qid, F.explode(F.array_distinct(search_terms(query))).alias("term"))
    vocabulary = asked.select("term").distinct()
    if stats is None:
        stats = bm25_stats(corpus, text)
    if frequency is None:
        frequency = document_frequency(corpus, text, broadcast_if_small(vocabulary))
    totals = stats.first()
    n, df = F.lit(totals["n_docs"]), F.col("df")
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    found = frequency.select("term", idf.alias("idf"))
    ids = asked.schema[qid]
    opts = {
        "qid": qid, "keys": keys, "k": k, "path": path, "by": [], "k1": k1, "b": b, "scopes": scopes,
        "names": [qid, *keys, "score"], "descending": True,
    }
    schema = T.StructType([ids, *[corpus.schema[c] for c in keys], T.StructField("score", T.DoubleType())])
    blocks = _weight_blocks(queries, asked, qid, max_weights)
    if len(blocks) > 1:
        # Every block weighs its terms; the corpus is not to be counted again for each.
        found = cut_lineage(found.join(broadcast_if_small(vocabulary), "term", "left_semi"))
    near = [_score_block(b, found, totals["avg_len"], corpus, query, text, opts, schema) for b in blocks]
    return top_k_per_key(
        functools.reduce(DataFrame.unionAll, near), [qid], [F.desc(F.round("score", 9)), *keys], k
    )


def _weight_blocks(queries: DataFrame, asked: DataFrame, qid: str, max_weights: int) -> list[DataFrame]:
    """Blocks of queries that have about ``max_weights`` cells of query and term between them."""
    size = asked.agg(
        F.count_distinct("term").alias("t"), F.count_distinct(qid).alias("q"), F.count(F.lit(1)).alias("n")
    ).first()
    if not size["n"]:
        return [queries]
    # Few queries have few terms: a block of q has no more than q times the terms of one query.
    most = max(max_weights / size["t"], math.sqrt(max_weights * size["q"] / size["n"]), 1)
    return query_blocks(queries, [qid], int(most))


def _score_block(queries, found, mean, corpus, query, text, opts, schema) -> DataFrame:
    """Score whole batches of the corpus against the shared weights of a block of queries."""
    qid, keys, scopes, path = opts["qid"], opts["keys"], opts["scopes"], opts["path"]
    asked = queries.select(qid, F.explode(F.array_distinct(search_terms(query))).alias("term"))
    weights = found.join(F.broadcast(asked), "term").select(qid, "term", "idf").toArrow()
    sides = queries.select(qid, *([scopes] if scopes else [])).toArrow()
    shared = corpus.sparkSession.sparkContext.broadcast((weights, sides, mean))
    cols = list(dict.fromkeys([*keys, *([path] if scopes else [])]))

    def run(batches):
        weights, sides, mean = shared.value
        scorer = BlockScorer(weights, sides, mean, opts)
        best = None
        for batch in batches:
            rows = scorer.best(pa.Table.from_batches([batch]))
            if rows is not None:
                best = rows if best is None else keep_best([best, rows.cast(best.schema)], opts)
        if best is not None:
            yield from best.to_batches()

    # A row without text has no terms.
    bag = F.coalesce(search_terms(text), F.array().cast("array<string>"))
    return corpus.select(*cols, bag.alias("_bag")).mapInArrow(run, schema)


class BlockScorer:
    """BM25 of all queries over a block of tokenised rows."""

    _ROWS = 512
    _CELLS = 4_000_000

    def __init__(self, weights: pa.Table, sides: pa.Table, mean: float, opts: dict):
        self.opts, self.mean = opts, mean
        self.ids = sides.column(opts["qid"]).combine_chunks()
        self.scopes = (
            [tuple(s or ()) for s in sides.column(opts["scopes"]).to_pylist()] if opts["scopes"] else None
        )
        self.terms = pc.unique(weights.column("term")).cast(pa.string())
        self.matrix = np.zeros((len(self.terms), len(self.ids)))
        at = pc.index_in(weights.column("term").cast(pa.string()), value_set=self.terms).to_numpy()
        to = pc.index_in(weights.column(opts["qid"]), value_set=self.ids).to_numpy()
        self.matrix[at, to] = weights.column("idf").to_numpy()

    def __len__(self) -> int:
        return len(self.ids)

    def best(self, rows: pa.Table) -> pa.Table | None:
        if not len(self.terms) or not rows.num_rows:
            return None
        rows = rows.sort_by([(c, "ascending") for c in self.opts["keys"]])
        step = max(1, min(self._ROWS, self._CELLS // max(len(self.terms), len(self.ids))))
        parts = [self._block(rows.slice(at, step)) for at in range(0, rows.num_rows, step)]
        parts = [p for p in parts if p.num_rows]
        return keep_best(parts, self.opts) if parts else None

    def _block(self, rows: pa.Table) -> pa.Table:
        opts, width = self.opts, len(self.terms)
        bags = rows.column("_bag").combine_chunks()
        length = pc.list_value_length(bags).to_numpy(zero_copy_only=False)
        term = pc.index_in(bags.flatten().cast(pa.string()), value_set=self.terms)
        owner = np.repeat(np.arange(rows.num_rows), length)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        cell = owner[known] * width + term.drop_null().to_numpy()
        tf = np.bincount(cell, minlength=rows.num_rows * width).reshape(rows.num_rows, width)
        damp = opts["k1"] * (1 - opts["b"] + opts["b"] * length / self.mean)
        gain = tf * (opts["k1"] + 1) / (tf + damp[:, None])
        score = (gain @ self.matrix).T
        rank_by = np.where(score > 0, -np.round(score, 9), np.inf)
        if self.scopes is not None:
            tree = PathTree(rows.column(opts["path"]))
            inside = {scopes: tree.below(scopes) for scopes in set(self.scopes)}
            rank_by[~np.stack([inside[scopes] for scopes in self.scopes])] = np.inf
        q, d = pick_smallest(rank_by, opts["k"])
        picked = rows.select(opts["keys"]).take(pa.array(d))
        arrays = [self.ids.take(pa.array(q)), *picked.columns, pa.array(score[q, d])]
        return pa.Table.from_arrays(arrays, names=opts["names"])


def rrf(
    vector: DataFrame,
    keyword: DataFrame,
    limit: int,
    *,
    k: int = RRF_K,
    qid: str = "qid",
    keys: Sequence[str] = CHUNK_KEY,
    rank: str = "rank",
) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lanes.

    A row found by both lanes keeps the vector lane's columns. Equal scores keep vector order,
    then keyword order. Adds ``score``, ``match`` and the new ``rank``.
    """
    on = [qid, *keys]
    payload = list(dict.fromkeys(c for c in [*vector.columns, *keyword.columns] if c not in (*on, rank, "score")))

    def lane(df, name, pick):
        """One row per key: a key met twice in a lane adds up, at the place of its first rank."""
        held = [c for c in payload if c in df.columns]
        cells = pick(F.struct(F.lit(1).alias("_one"), *held), F.col(rank)).alias(f"_{name}")
        part = F.sum(F.lit(1.0) / (F.lit(k) + F.col(rank))).alias(f"_{name}_part")
        rows = df.groupBy(*on).agg(cells, part, F.min(rank).alias(f"_{name}_rank"))
        return rows.select(
            *on, f"_{name}_part", f"_{name}_rank", *[F.col(f"_{name}")[c].alias(f"_{name}_{c}") for c in held]
        )

    both = lane(vector, "v", F.max_by).join(lane(keyword, "k", F.min_by), on, "full_outer")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def value(c):
        v, w = f"_v_{c}", f"_k_{c}"
        if c not in vector.columns:
            return F.when(F.col("_v_rank").isNull(), F.col(w)).alias(c)
        if c not in keyword.columns:
            return F.col(v).alias(c)
        return F.when(F.col("_v_rank").isNotNull(), F.col(v)).otherwise(F.col(w)).alias(c)

    match = (
        F.when(F.col("_v_rank").isNotNull() & F.col("_k_rank").isNotNull(), "both")
        .when(F.col("_v_rank").isNotNull(), "vector")
        .otherwise("keyword")
    )
    fused = both.select(
        *on,
        *[value(c) for c in payload],
        (part("_v_part") + part("_k_part")).alias("score"),
        match.alias("match"),
        "_v_rank",
        "_k_rank",
    )
    order = [F.desc("score"), F.asc_nulls_last("_v_rank"), F.asc_nulls_last("_k_rank"), *keys]
    return top_k_per_key(fused, [qid], order, limit, name=rank).drop("_v_rank", "_k_rank")


def hydrate(
    hits: DataFrame, docs: DataFrame, *, path: str = "path", content: str = "content",
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Attach the lines of every hit. A missing document leaves null content and a warning.

    The hits are few beside what it took to find them, so they are written once and read from there.
    A document hit by many queries is copied to several tasks instead of drawing all its hits
    into one.
    """
    hits = cut_lineage(hits)
    text = docs.select(F.col(path), F.col(content).alias("_text"), F.lit(True).alias("_known"))
    found = salted_join(hits, asked_for(text, hits, [path]), [path], "left", spread=spread or hits.columns)
    lines = F.slice(
        split_lines(F.col("_text")), F.col("start_line"),
        F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)),
    )
    warning = (
        F.when(
            F.col("_known").isNull(),
            F.concat(F.lit("Source file no longer exists at path: "), F.col(path), F.lit(".")),
        ).when(F.col("_text").isNull(), F.concat(F.lit("Could not read content: "), F.col(path)))
    )
    return found.withColumn("content", join_lines(lines)).withColumn("warning", warning).drop(
        "_text", "_known"
    )


def scope_filter(df: DataFrame, scopes: DataFrame, path: str = "path", scope: str = "scope") -> DataFrame:
    """Rows strictly below any directory of a table, as an equality join on the directories above."""
    dirs = scopes.select(F.col(scope).alias("_dir")).distinct()
    above = df.select(path).distinct().select(path, F.explode(ancestors(path)).alias("_dir"))
    inside = above.join(dirs, "_dir", "left_semi").select(path).distinct()
    return salted_join(df, inside, [path], "left_semi", spread=df.columns)


def empty_scopes(queries: DataFrame, hits: DataFrame, qid: str = "qid", scopes: str = "scopes") -> DataFrame:
    """A message row for every scoped query without hits; an unscoped one gives nothing."""
    message = F.concat(
        F.lit("No artifacts found under scopes: "),
        F.array_join(F.col(scopes), ", "),
        F.lit(". Scopes are directories."),
    )
    return (
        queries.where(F.size(scopes) > 0)
        .join(hits.select(qid).distinct(), qid, "left_anti")
        .select(qid, message.alias("message"))
    )


def limit_lanes(lanes: Sequence[DataFrame], n: int, order: Sequence[str] = ("path", "line")) -> DataFrame:
    """First ``n`` rows of the lanes one after the other."""
    out = None
    for i, df in enumerate(lanes):
        lane = df.withColumn("lane", F.lit(i))
        out = lane if out is None else out.unionByName(lane, allowMissingColumns=True)
    return out.orderBy("lane", *order).limit(n)
