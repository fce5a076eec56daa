"""Mixing sources to target weights: every source is cut at its exact word budget in a hash-random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.exprs import col
from memlake.llm.base import field, narrow, packed, unpacked
from memlake.operators.skew import broadcast_if_small
from memlake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Hex digits of the random key that name a document's cell: 4,096 cells for each source.
CELL_DIGITS = 3


def word_count(text: Column | str) -> Column:
    """Words between ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column | str, seed: str) -> Column:
    """Hex digits that look random, but are the same on every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(col(doc_id).cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Words to take of every source. ``sizes``: one row per source with ``source`` and ``source_size``.

    Sources in code point order, null last, have the weights in turn and share ``share`` of all words.
    No target passes ``most`` times its source's words; what is cut off is shared again by weight among
    the others until none is above. That level is found directly: with the sources sorted by the words a
    unit of weight may get, those below the level are full, and the level left by the full ones is known
    from running sums. Sources of no words get none.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    limit = F.lit(float(most)) * F.col("source_size")
    fill = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = (
        ranked.withColumn("_limit", limit)
        .withColumn("_ratio", F.col("_limit") / F.col("weight"))
        .withColumn("_used", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("_level", (F.col("_budget") - F.col("_used")) / F.col("_open"))
        .withColumn("_place", F.row_number().over(fill))
        # The level of the first source that isn't full holds for all that follow.
        .withColumn("_rest", F.min(F.when(
            F.col("_ratio") > F.col("_level"), F.struct("_place", "_level"))).over(every)["_level"])
    )
    target = F.least("_limit", F.col("weight") * F.col("_rest"))
    return levels.select("source", "source_size", F.round(target, 6).alias("target"))


def _placed(docs: DataFrame, id: str, text: str, source: str, weights: Sequence[float], share: float,
            most: float, seed: str) -> DataFrame:
    """Every row with its place on its source's line: _key, _begin, _epochs (whole rounds) and _part (words
    taken in the round after them)."""
    sized = narrow(docs, doc_id=id, source=source, _text=text).select(
        "doc_id", "source", word_count("_text").alias("size"), random_key("doc_id", seed).alias("_key")
    )
    sized = cut_lineage(sized.withColumn("_cell", F.substring("_key", 1, CELL_DIGITS)))
    cells = sized.groupBy("source", "_cell").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    sources = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
    )
    # A null source is a source: both joins compare it as equal.
    starts = (
        cells.join(
            sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
        )
        .drop("_s", "_words")
        .withColumnsRenamed({"source": "_s", "_cell": "_c"})
    )
    inside = (
        Window.partitionBy("source", "_cell").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - F.col("_epochs") * F.col("source_size") - F.col("_begin")
    return (
        sized.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
        .withColumn("_begin", F.col("_start") + F.col("_before"))
        .withColumn("_epochs", whole.cast("long"))
        .withColumn("_part", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long"))
    )


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: str = "mix") -> DataFrame:
    """How many words of each document are taken so that every source meets its budget.

    Returns doc_id, size, source, source_size, target and taken, one row per input row. A source's documents
    lie on a line in the order of their random keys. The mix walks this line from its start, through it again
    in the next epoch if the budget is larger, and stops at the exact word; ``taken`` are a document's words
    on that way.

    The line is cut into cells by the leading digits of the key, so a source of any share of the rows is
    spread over thousands of cells: sums inside the cells, then sums over the cells before.

    Null text: no words, none taken. Null source: a source of its own. Null ids share one key. Ties and
    repeated rows follow each other in order of size; equal rows are interchangeable. Empty tables give
    no rows. Other columns are ignored.
    """
    return _placed(docs, id, text, source, weights, share, most, seed).select(
        "doc_id", "size", "source", "source_size", "target",
        (F.col("_epochs") * F.col("size") + F.col("_part")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
               weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
               seed: str = "mix") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as the walk enters it, all columns as they are.

    The row in which a source's walk ends comes whole; equal rows at that place all come. A row's number
    follows from its source's cut, a few values for each source, so the texts stay where they are. Rows
    without words go.
    """
    placed = _placed(docs, id, text, source, weights, share, most, seed)
    cuts = cut_lineage(placed.groupBy(F.col("source").alias("_of")).agg(
        F.max("_epochs").alias("_epochs"),
        F.max(F.when(F.col("_part") > 0, F.struct("_key", "size"))).alias("_cut")))
    here = F.struct(random_key(field(id), seed).alias("_key"), word_count(field(text)).alias("size"))
    times = F.when(here["size"] > 0, F.col("_epochs") + F.coalesce(here <= F.col("_cut"), F.lit(False)).cast("long"))
    rows = (
        packed(docs).join(broadcast_if_small(cuts), field(source).eqNullSafe(F.col("_of")))
        .withColumn("_times", F.coalesce(times, F.lit(0)))
        .where("_times > 0")
        .withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    )
    return unpacked(rows, docs)
