"""Line ranges, paged and sectioned reads, grep and outlines over many documents at once."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import markdown
from memlake.functions.exprs import let, raw_lines, split_lines, strip
from memlake.functions.paths import hidden
from memlake.operators.knn import query_blocks
from memlake.operators.skew import asked_for, fits_broadcast, salted_join, top_k_per_key
from memlake.session import cut_lineage

# Largest text read in one piece, default page, usual most of grep rows.
MAX_FULL_BYTES = 1024 * 1024
PAGE_CHARS = 10_000
GREP_CAP = 100


def read_lines(requests: DataFrame, docs: DataFrame, *, rid: str = "rid") -> DataFrame:
    """Lines start_line..end_line of a document per request, or the reason why not."""
    text = docs.select("path", F.col("content").alias("_text"), F.lit(True).alias("_known"))
    joined = salted_join(requests, asked_for(text, requests, ["path"]), ["path"], "left", spread=[rid])
    bad = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))
    error = (
        F.when(bad, "start_line must be >= 1 and end_line must be >= start_line.")
        .when(F.col("path").contains("../") | F.col("path").startswith(".."),
              "Path traversal detected in requested path.")
        .when(F.col("_known").isNull(), F.concat(F.lit("File not found: "), F.col("path")))
    )
    span = F.slice(
        split_lines(F.col("_text")),
        F.greatest(F.col("start_line"), F.lit(1)),
        F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)),
    )
    return joined.select(
        *requests.columns,
        F.when(error.isNull(), F.array_join(span, "\n")).alias("content"),
        F.when(error.isNull(), F.size(span)).alias("n_lines"),
        error.alias("error"),
    )


def numbered(lines: Column, on: Column, first: Column) -> Column:
    """Lines with their number in front when asked for."""
    return F.when(
        on, F.transform(lines, lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x))
    ).otherwise(lines)


def page(
    text: Column, max_chars: Column, skip_chars: Column, line_numbers: Column, from_end: Column,
    first_line: Column | None = None,
) -> Column:
    """A window of the (optionally numbered) text with markers where something was left out.

    ``max_chars`` of null or 0 means no limit. Reading from the end shifts the window so that it
    closes ``skip_chars`` before the end, counting one newline per line.
    """
    first = first_line if first_line is not None else F.lit(1)
    limit = F.coalesce(max_chars, F.lit(0))

    def build(lines):
        body = F.array_join(lines, "\n")
        total = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(x) + 1)
        skip = F.when(
            from_end & (limit > 0), F.greatest(F.lit(0), total - skip_chars - limit)
        ).otherwise(skip_chars)
        return let(F.struct(body.alias("body"), skip.alias("skip")), cut)

    def cut(s):
        rest = F.substring(s["body"], s["skip"] + 1, F.length(s["body"]))
        over = (limit > 0) & (F.length(rest) >= limit)
        shown = F.when(
            over,
            F.concat(
                F.substring(rest, F.lit(1), limit),
                F.format_string("\n... [Text truncated: limit %d characters exceeded]", limit),
            ),
        ).otherwise(rest)
        head = F.format_string("[Text truncated: %d characters skipped at the beginning]\n... ", s["skip"])
        return F.when(s["skip"] > 0, F.concat(head, shown)).otherwise(shown)

    return let(numbered(split_lines(text), line_numbers, first), build)


def read_docs(requests: DataFrame, docs: DataFrame, *, rid: str = "rid") -> DataFrame:
    """Batch read. Every request names a mode (full, paged, section, lines) and gets text or an error.

    Request columns: rid, path, mode and, where the mode uses them, max_chars, skip_chars,
    line_numbers, direction, section_name, start_line, end_line. Missing columns take defaults.
    """
    defaults = {
        "max_chars": F.lit(PAGE_CHARS), "skip_chars": F.lit(0), "line_numbers": F.lit(False),
        "direction": F.lit("begin"), "section_name": F.lit(None).cast("string"),
        "start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int"),
    }
    full = requests
    for name, value in defaults.items():
        given = F.coalesce(F.col(name), value) if name in requests.columns else value
        full = full.withColumn(name, given)
    text = docs.select("path", F.col("content").alias("_text"), F.lit(True).alias("_known"))
    joined = salted_join(full, asked_for(text, requests, ["path"]), ["path"], "left", spread=[rid])
    mode, body, skip = F.col("mode"), F.col("_text"), F.col("skip_chars")
    numbers, tail = F.col("line_numbers"), F.col("direction") == "end"
    found = markdown.section(body, F.col("section_name"))
    first = markdown.section_start_line(body, F.col("section_name"))
    size = F.octet_length(body)
    error = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("File not found: "), F.col("path")))
        .when((mode == "full") & (size > MAX_FULL_BYTES),
              "File too large (>1MB). Use mode='paged' or mode='lines'.")
        .when((mode == "paged") & (size > MAX_FULL_BYTES) & (skip == 0),
              "File too large (>1MB). Use pagination (skip_chars) or 'lines' mode.")
        .when((mode == "section") & (F.coalesce(F.col("section_name"), F.lit("")) == ""),
              "Mode 'section' (read) requires 'section_name'.")
        .when((mode == "section") & found.isNull(),
              F.concat(F.lit("Section '"), F.col("section_name"), F.lit("' not found in "), F.col("path"), F.lit(".")))
        .when((mode == "lines") & F.col("start_line").isNull() & F.col("end_line").isNull(),
              "Mode 'lines' (read) requires 'start_line' or 'end_line'.")
        .when(~mode.isin("full", "paged", "section", "lines"), F.concat(F.lit("Unknown read mode: "), mode))
    )
    no_limit, nothing = F.lit(None).cast("int"), F.lit(0)
    start = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    lines = split_lines(body)
    stop = F.coalesce(F.nullif(F.col("end_line"), F.lit(0)), F.size(lines))
    span = F.array_join(F.slice(lines, start, F.greatest(stop - start + 1, F.lit(0))), "\n")
    value = (
        F.when(mode == "full", page(body, no_limit, nothing, numbers, F.lit(False)))
        .when(mode == "paged", page(body, F.col("max_chars"), skip, numbers, tail))
        .when(mode == "section", page(found, no_limit, skip, numbers, tail, first))
        .when(mode == "lines", page(span, no_limit, skip, numbers, tail, start))
    )
    return joined.select(
        *requests.columns, F.when(error.isNull(), value).alias("text"), error.alias("error")
    )


def doc_lines(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per line: path, 1-based line, text."""
    return docs.select(path, F.posexplode(raw_lines(F.col(content))).alias("line", "text")).withColumn(
        "line", F.col("line") + 1
    )


#: Bytes of the blocks that a text is cut into; a pattern uses the widest of which it covers one wherever it stands.
GRAM_WIDTHS = (16, 4)
GRAM_BUCKETS = 64
#: Patterns too short to cover a block that are tested on the texts at once, one scan for each such number.
SHORT_PATTERNS = 1000


def _patterns(queries: DataFrame, qid: str, query: str) -> DataFrame:
    return queries.where(F.col(query).isNotNull() & (F.col(query) != "")).select(
        F.col(qid).alias("_qid"), F.lower(query).alias("_pattern")
    )


def _gram(value: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` bytes from the 0-based byte ``at`` on."""
    return F.xxhash64(F.lit(width), F.substring(value, at + 1, F.lit(width)))


def grams(docs: DataFrame, widths: Sequence[int] = GRAM_WIDTHS, path: str = "path", content: str = "content") -> DataFrame:
    """path and gram: the hashed blocks of each document's lower-cased text, for every width.

    Blocks lie side by side, so a text of n bytes has n / width of them. A text is found by a pattern of at least
    2 * width - 1 bytes, which covers a whole block wherever it stands: one of its grams at the offsets 0 to width - 1
    is that block.
    """
    low = F.lower(F.col(content)).cast("binary")

    def of_width(text, width):
        each = F.sequence(F.lit(0), F.floor(F.length(text) / width).cast("int") - 1)
        found = F.transform(each, lambda i: _gram(text, i * width, width))
        return F.when(F.length(text) >= width, found).otherwise(F.array().cast("array<long>"))

    def blocks(text):
        return F.array_distinct(F.concat(*[of_width(text, w) for w in widths]))

    named = docs.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), low.alias("_low"))
    return named.select("path", F.explode(let(F.col("_low"), blocks)).alias("gram"))


def write_grams(docs: DataFrame, root: str, *, path: str = "path", content: str = "content") -> None:
    """Store the grams of documents in buckets of grams, so a search reads the buckets of its patterns only.

    Several tasks share a bucket by hashed paths: a block that stands in most documents is no single task's work. Within
    a bucket the grams keep the order of their documents: a search meets them by hash, and sorting them costs more than
    all else.
    """
    found = grams(docs, path=path, content=content).withColumn("bucket", _gram_bucket())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("path"), F.lit(max(4, 2 * parts // GRAM_BUCKETS)))
    found.repartition(parts, "bucket", share).write.partitionBy("bucket").parquet(root)


def read_grams(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("path string, gram long, bucket int").parquet(root)


def _gram_bucket() -> Column:
    return F.pmod(F.col("gram"), F.lit(GRAM_BUCKETS)).cast("int")


def _anchors(patterns: DataFrame) -> DataFrame:
    """gram, _qid, _pattern: the grams of which a text that holds the pattern has at least one."""
    def of_width(width):
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: _gram(F.col("_raw"), i, width))

    raw = patterns.withColumn("_raw", F.col("_pattern").cast("binary"))
    cases = F.coalesce(*[F.when(_width(F.length("_raw")) == w, of_width(w)) for w in GRAM_WIDTHS])
    return raw.select(F.explode(F.array_distinct(cases)).alias("gram"), "_qid", "_pattern")


def grep(
    docs: DataFrame, queries: DataFrame, cap: int | None = None, *, qid: str = "qid",
    query: str = "query", max_bytes: int | None = None, max_patterns: int = 5000, index: DataFrame | None = None,
) -> DataFrame:
    """Case-insensitive substring search: qid, path, line, content (trimmed).

    Hidden documents are not searched; all others are, whatever their size. A caller may set ``max_bytes``
    to leave larger documents out, and ``cap`` to keep the first rows per query in path and line order.

    The grams of the documents, stored ones (``index``, from ``read_grams`` of these documents) or those of the widths
    in use, meet the grams of the patterns; only the documents that share one are looked at, by the pattern that they
    share it with. Patterns are sent to the grams where they are at most ``max_patterns``, beyond it both are spread.
    Patterns of fewer than 7 bytes have no gram and are tested on every text, in blocks of ``SHORT_PATTERNS``.
    """
    seen = docs.where(~hidden("path") & F.col("content").isNotNull())
    if max_bytes is not None:
        seen = seen.where(F.octet_length("content") <= max_bytes)
    patterns = cut_lineage(_patterns(queries, qid, query).distinct().withColumn("_width", _width(F.octet_length("_pattern"))))
    widths = [w for (w,) in patterns.select("_width").distinct().collect()]
    hits = []
    if None in widths:
        short = query_blocks(patterns.where("_width IS NULL"), ["_qid", "_pattern"], SHORT_PATTERNS)
        hits += [_test_all(seen, block) for block in short]
    used = sorted((w for w in widths if w), reverse=True)
    if used:
        long = patterns.where("_width IS NOT NULL").drop("_width")
        hits.append(_test_shared(seen, long, used, index, fits_broadcast(long, max_rows=max_patterns)))
    found = functools.reduce(DataFrame.unionAll, hits) if hits else seen.select(
        F.lit(None).cast(queries.schema[qid].dataType).alias("_qid"), "path", F.lit(0).alias("line"), F.lit("").alias("text")).limit(0)
    rows = found.select(F.col("_qid").alias(qid), "path", (F.col("line") + 1).alias("line"), F.col("text").alias("content"))
    first = rows if cap is None else top_k_per_key(rows, [qid], ["path", "line"], cap).drop("rank")
    return first.withColumn("content", strip(F.col("content")))


def _test_all(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """A bounded block of patterns as one array value beside every text; only texts that hold one are split."""
    every = patterns.agg(F.array_sort(F.collect_list(F.struct("_qid", "_pattern"))).alias("a")).scalar()

    def holding(text, asked):
        # Bound once, or every pattern would fold the case of the whole text again.
        return let(F.lower(text), lambda low: F.filter(asked, lambda x: F.contains(low, x["_pattern"])))

    some = docs.withColumn("_every", every).withColumn("_asked", holding(F.col("content"), F.col("_every")))
    some = some.where(F.size("_asked") > 0)
    lines = some.select("path", "_asked", F.posexplode(raw_lines(F.col("content"))).alias("line", "text"))
    hits = lines.withColumn("_hit", F.explode(holding(F.col("text"), F.col("_asked"))))
    return hits.select(F.col("_hit")["_qid"].alias("_qid"), "path", "line", "text")


def _test_shared(docs: DataFrame, patterns: DataFrame, widths: Sequence[int], index: DataFrame | None, sent: bool) -> DataFrame:
    """Texts and patterns that share a gram meet; whole patterns are tested on those texts, then on their lines."""
    anchors = _anchors(patterns)
    held = grams(docs, widths) if index is None else _stored_grams(index, anchors)
    shared = held.join(F.broadcast(anchors), "gram") if sent else salted_join(
        held, anchors, ["gram"], spread=["path"], find_hot=False)
    pairs = cut_lineage(shared.select("path", "_qid", "_pattern").distinct())
    # The case of a text is folded once, before it meets its patterns, and not again for each of them.
    text = asked_for(docs.select("path", "content"), pairs, ["path"]).withColumn("_low", F.lower("content"))
    if fits_broadcast(pairs):
        near = text.join(F.broadcast(pairs), "path")
    else:
        near = salted_join(pairs, text, ["path"], spread=["_qid", "_pattern"])
    some = near.where(F.contains("_low", F.col("_pattern")))
    lines = some.select("_qid", "_pattern", "path", F.posexplode(raw_lines(F.col("content"))).alias("line", "text"))
    return lines.where(F.contains(F.lower("text"), F.col("_pattern"))).select("_qid", "path", "line", "text")


def _stored_grams(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Only the buckets in which a pattern has a gram are read."""
    buckets = [r["bucket"] for r in anchors.select(_gram_bucket().alias("bucket")).distinct().collect()]
    return index.where(F.col("bucket").isin(buckets)).select("path", "gram")


def _width(n: Column) -> Column:
    """The widest gram of which a pattern of ``n`` bytes covers one, if there is one."""
    return F.coalesce(*[F.when(n >= 2 * w - 1, w) for w in GRAM_WIDTHS])


def outline_rows(docs: DataFrame) -> DataFrame:
    """Heading lines of every document: path, position, heading."""
    heads = markdown.outline(F.col("content"))
    return docs.select("path", F.posexplode(heads).alias("position", "heading")).withColumn(
        "position", F.col("position") + 1
    )


def list_docs(docs: DataFrame, rel_dir: str = "", recursive: bool = False) -> DataFrame:
    """Entries below a directory: name, type; hidden ones left out, directories first."""
    root = rel_dir.strip("/")
    inside = docs.select("path")
    if root:
        inside = inside.where(F.col("path").startswith(root + "/")).select(
            F.substring("path", len(root) + 2, 2**31 - 1).alias("path")
        )
    parts = F.split("path", "/")
    shown = inside.where(~hidden("path"))
    depth = F.size(parts) if recursive else F.lit(1)
    level = F.explode(F.sequence(F.lit(1), depth))
    cut = shown.select(parts.alias("_parts"), level.alias("_n"))
    name = F.array_join(F.slice("_parts", F.lit(1), F.col("_n")), "/")
    is_dir = F.col("_n") < F.size("_parts")
    return (
        cut.select(
            F.when(is_dir, F.concat(name, F.lit("/"))).otherwise(name).alias("name"),
            F.when(is_dir, "dir").otherwise("file").alias("type"),
        )
        .distinct()
        .orderBy(F.col("type") != "dir", "name")
    )
