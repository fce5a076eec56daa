"""Benchmark decontamination: a broadcast set of normalised test windows, looked up by every training window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.exprs import let
from memlake.llm.base import ascii_lower, field, narrow, no_items, packed, unpacked
from memlake.operators.skew import broadcast_if_small
from memlake.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before they are made lower case.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and all characters beyond ASCII; none in a null text."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), no_items("string"))


def fingerprint(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(text)


def benchmark_windows(benchmark: DataFrame, id: str = "item_id", text: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: hash, long (words in it), window (the words), items (ids as strings).

    An item of fewer words is one window, an item without words or with a null text none. Items that share
    an id count as one; a null id is never named, but its windows still hit.
    """
    items = narrow(benchmark, item=id, _text=text).select("item", words_of(F.col("_text")).alias("w"))
    long = F.least(F.size("w"), F.lit(window))
    spans = items.where(F.size("w") > 0).select(
        "item", "w", long.alias("long"),
        F.explode(F.sequence(F.lit(1), F.size("w") - long + 1)).alias("_at"),
    )
    return (
        spans.select("item", "long", F.slice("w", F.col("_at"), F.col("long")).alias("window"))
        .groupBy("long", "window")
        .agg(F.collect_set(F.col("item").cast("string")).alias("items"))
        .withColumn("hash", _window_hash(F.transform("window", lambda w: F.xxhash64(w))))
    )


def _window_hash(hashes: Column) -> Column:
    return F.xxhash64(hashes)


def _hashes(long: int) -> Column:
    """The hash of every window of ``long`` words."""
    last = F.size("_hashes") - long
    at = let(F.col("_hashes"), lambda some: F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1),
        lambda i: _window_hash(F.slice(some, i, F.lit(long)))))
    return F.when(last >= 0, at).otherwise(no_items("bigint"))


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Which words of every document lie inside a window of the benchmark.

    Returns doc_id, fingerprint (of the text), n_words, hits (0-based positions of the words inside) and
    items (ids as strings, sorted), one row per input row. A window is looked up by its hash in the
    broadcast set of the benchmark's windows and confirmed by its words. The set's size is measured first;
    beyond the bound it is joined by shuffle.

    Null text: no words. Null ids and repeated rows each keep their row. Empty benchmark: no hits. Empty
    documents: no rows. Other columns are ignored.
    """
    wanted = benchmark_windows(benchmark, item_id, item_text, window)
    # ``window`` lengths at most, however large the benchmark is.
    lengths = sorted(r["long"] for r in wanted.select("long").distinct().collect())
    worded = narrow(docs, doc_id=id, _text=text).select(
        "doc_id", fingerprint(F.col("_text")).alias("fingerprint"), words_of(F.col("_text")).alias("_words")
    )
    hashed = worded.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # The first entry stands for the document itself and finds no window.
    entries = F.concat(F.array(F.lit(None).cast("bigint")), *[_hashes(n) for n in lengths])
    spots = hashed.select("doc_id", "fingerprint", "_words", F.posexplode(entries).alias("_spot", "_hash"))
    found = spots.join(broadcast_if_small(wanted), F.col("_hash") == F.col("hash"), "left")
    shorter = [
        F.when(F.col("long") > n, F.greatest(F.size("_words") - n + 1, F.lit(0))).otherwise(F.lit(0))
        for n in lengths
    ]
    at = F.col("_spot") - 1 - reduce(lambda a, b: a + b, shorter, F.lit(0))
    same = F.slice(F.col("_words"), F.greatest(at, F.lit(0)) + 1, F.col("long")) == F.col("window")
    hits = found.where((F.col("_spot") == 0) | same).select(
        "doc_id", "fingerprint", "items",
        F.when(F.col("_spot") == 0, F.size("_words")).alias("_size"),
        F.when(F.col("_spot") > 0, F.sequence(at, at + F.col("long") - 1)).alias("_covered"),
    )
    grouped = hits.groupBy("doc_id", "fingerprint").agg(
        F.max("_size").cast("long").alias("n_words"),
        F.count("_size").cast("int").alias("_copies"),
        F.array_distinct(F.flatten(F.collect_list("_covered"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy", "_copies")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                        window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns stay as they are.

    The rows to remove are written first. If they fit into the measured bound they are broadcast, so the
    texts stay where they are; otherwise both sides are shuffled. A null id is compared like a value.
    """
    found = contamination(docs, benchmark, id, text, window=window).where(F.size("hits") > 0)
    bad = cut_lineage(
        found.select(F.col("doc_id").alias("_bad_id"), F.col("fingerprint").alias("_bad_print")).distinct()
    )
    same = field(id).eqNullSafe(F.col("_bad_id")) & (fingerprint(field(text)) == F.col("_bad_print"))
    return unpacked(packed(docs).join(broadcast_if_small(bad), same, "left_anti"), docs)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """Returns doc_id and text: the words inside benchmark windows are taken out of a document's text.

    The text before a word goes with it; what follows the last word stays. Documents without a hit come
    back unchanged.
    """
    found = contamination(docs, benchmark, id, text, window=window).where(F.size("hits") > 0)
    bad = cut_lineage(found.select(
        F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_print"), F.col("hits").alias("_hits")
    ).distinct())
    rows = narrow(docs, doc_id=id, text=text)
    joined = rows.join(
        broadcast_if_small(bad),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (fingerprint(F.col("text")) == F.col("_print")), "left",
    )
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).*?{ANY_CASE}"), F.lit(0))
    tail = F.regexp_replace("text", f"(?s)^.*{ANY_CASE}", "")
    kept = F.filter(pieces, lambda _, i: ~F.array_contains(F.col("_hits"), i))
    cleaned = F.concat(F.array_join(kept, ""), tail)
    return joined.select("doc_id", F.when(F.col("_hits").isNull(), F.col("text")).otherwise(cleaned).alias("text"))
