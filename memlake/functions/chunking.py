"""Chunkers as Column expressions: text in, array<struct<section,start_line,end_line,text>> out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.exprs import (
    col,
    is_blank,
    join_lines,
    let,
    newline_count,
    raw_lines,
    split_lines,
    strip,
)
from memlake.functions.markdown import outside_fences

MAX_CHARS = 2000
OVERLAP = 0.15
LOOKBACK = 40

CHUNKS = "array<struct<section:string,start_line:int,end_line:int,text:string>>"


def overlap_chunks(
    text: Column | str, max_chars: int = MAX_CHARS, overlap: float = OVERLAP
) -> Column:
    """Sliding windows of at most ``max_chars``, cut at the last space of the final 40 characters.

    Blank text has no chunks; a text that fits is one chunk.
    """
    text = col(text)
    shared = int(max_chars * overlap)
    if max_chars <= LOOKBACK:
        raise ValueError(f"max_chars must exceed {LOOKBACK}")
    size = F.length(text)
    steps = F.ceil(size / F.lit(max(1, max_chars - shared - LOOKBACK))).cast("int") + 1
    # Cutting a string costs its whole length, so windows are taken from two pages of it.
    page = 2 * max_chars

    def view(pages, pos):
        """At most one window of text from a position on."""
        first = (pos / page).cast("int")
        two = F.concat(F.get(pages, first), F.coalesce(F.get(pages, first + 1), F.lit("")))
        return F.substring(two, pos - first * page + 1, F.lit(max_chars))

    def step(pages, size, acc):
        left = size - acc["pos"]

        def window(raw):
            back = let(
                F.reverse(F.right(raw, F.lit(LOOKBACK))),
                lambda tail: F.coalesce(
                    F.nullif(F.instr(tail, " "), F.lit(0)), F.nullif(F.instr(tail, "\n"), F.lit(0)), F.lit(0)
                ),
            )
            n = F.when(left <= max_chars, left).otherwise(F.lit(max_chars) - back)
            return let(n, lambda n: emit(F.substring(raw, F.lit(1), n), n))

        def emit(body, n):
            move = F.greatest(n - F.lit(shared), F.lit(1))
            end_line = acc["line"] + newline_count(body)
            return F.struct(
                (acc["pos"] + move).alias("pos"),
                (acc["line"] + newline_count(F.substring(body, F.lit(1), move))).alias("line"),
                (acc["pos"] + n >= size).alias("done"),
                F.concat(acc["out"], F.array(acc["pos"], n, acc["line"], end_line)).alias("out"),
            )

        return F.when(acc["done"], acc).otherwise(let(view(pages, acc["pos"]), window))

    start = F.struct(
        F.lit(0).alias("pos"),
        F.lit(1).alias("line"),
        F.lit(False).alias("done"),
        F.array().cast("array<int>").alias("out"),
    )
    pages = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{page}}}"), 0)

    def walk(doc):
        """Four numbers per window: position, length, first and last line. Plain numbers copy fast."""
        return F.aggregate(
            F.sequence(F.lit(1), steps),
            start,
            lambda acc, _: step(doc["pages"], doc["size"], acc),
            lambda acc: acc["out"],
        )

    def chunks(doc, cells):
        def chunk(i):
            cell = lambda j: F.get(cells, i * 4 + j)
            return F.struct(
                F.concat(F.lit("chunk_"), (i + 1).cast("string")).alias("section"),
                cell(2).alias("start_line"),
                cell(3).alias("end_line"),
                F.substring(view(doc["pages"], cell(0)), F.lit(1), cell(1)).alias("text"),
            )

        return F.transform(F.sequence(F.lit(0), (F.size(cells) / 4).cast("int") - 1), chunk)

    many = let(
        F.struct(pages.alias("pages"), size.alias("size")),
        lambda doc: let(walk(doc), lambda cells: chunks(doc, cells)),
    )
    one = F.array(
        F.struct(
            F.lit("chunk_1").alias("section"),
            F.lit(1).alias("start_line"),
            (newline_count(text) + 1).alias("end_line"),
            text.alias("text"),
        )
    )
    none = F.array().cast(CHUNKS)
    return (
        F.when(is_blank(text), none).when(size <= max_chars, one.cast(CHUNKS)).otherwise(many.cast(CHUNKS))
    )


def _headings(lines: Column) -> Column:
    """Headings of level 1 to 3 outside fences, in order."""
    found = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line"))),
        lambda x: x["line"].rlike(r"(?U)^#{1,3}[ \t]+\S"),
    )
    free = outside_fences(F.transform(found, lambda x: x["at"]), lines)
    return F.transform(
        free,
        lambda at: let(
            F.get(lines, at),
            lambda line: F.struct(
                at.alias("at"), F.length(F.regexp_extract(line, r"^(#+)", 1)).alias("level"),
                strip(line).alias("title"),
            ),
        ),
    )


def _breadcrumbs(heads: Column) -> Column:
    """One (line, breadcrumb) per heading of level 2 or 3; a level-1 heading restarts the trail."""
    text = "string"

    def step(acc, h):
        h2 = F.when(h["level"] == 2, h["title"]).otherwise(acc["h2"])
        h3 = F.when(h["level"] == 3, h["title"])
        trail = F.concat_ws(" > ", acc["h1"], h2, h3)
        deeper = F.struct(
            acc["h1"].alias("h1"),
            h2.alias("h2"),
            F.concat(acc["out"], F.array(F.struct(h["at"].alias("at"), trail.alias("trail")))).alias("out"),
        )
        top = F.struct(
            h["title"].alias("h1"), F.lit(None).cast(text).alias("h2"), acc["out"].alias("out")
        )
        return F.when(h["level"] == 1, top).otherwise(deeper)

    empty = F.array().cast("array<struct<at:int,trail:string>>")
    start = F.struct(
        F.lit(None).cast(text).alias("h1"), F.lit(None).cast(text).alias("h2"), empty.alias("out")
    )
    return F.aggregate(heads, start, step, lambda acc: acc["out"])


def header_chunks(
    text: Column | str, max_chars: int = MAX_CHARS, overlap: float = OVERLAP
) -> Column:
    """One chunk per level-2 or level-3 heading, led by its breadcrumb.

    Headings inside fences do not count. A text without such headings gets sliding windows.
    """
    text = col(text)

    def build(lines, marks):
        total = F.size(split_lines(text))

        def chunk(m, i):
            nxt = F.get(marks, i + 1)["at"]
            stop = F.coalesce(nxt, F.size(lines))
            body = strip(join_lines(F.slice(lines, m["at"] + 1, stop - m["at"])))
            return F.struct(
                m["trail"].alias("section"),
                (m["at"] + 1).alias("start_line"),
                F.coalesce(nxt, total).alias("end_line"),
                F.concat(m["trail"], F.lit("\n"), body).alias("text"),
            )

        return F.transform(marks, chunk).cast(CHUNKS)

    structured = let(
        raw_lines(text),
        lambda lines: let(_breadcrumbs(_headings(lines)), lambda marks: build(lines, marks)),
    )
    # Only a text with a line that starts like '## ' can have structured chunks.
    maybe = text.rlike(r"(?m)^#{2,3}[ \t]")
    flat = overlap_chunks(text, max_chars, overlap)
    return F.when(
        maybe, let(structured, lambda s: F.when(F.size(s) > 0, s).otherwise(flat))
    ).otherwise(flat)
