"""Markdown structure: fences, headings, sections and section edits as Column expressions.

Everything works on the lines of one document inside its own row; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.exprs import (
    col,
    head_to,
    is_blank,
    join_lines,
    let,
    lstrip,
    raw_lines,
    rstrip,
    strip,
    strip_newlines,
    tail_from,
)

_RANGES = "array<struct<first:int,last:int>>"
_MARK = "struct<at:int,run:string,bare:boolean>"


def fence_ranges(lines: Column) -> Column:
    """0-based line ranges of fenced blocks.

    A fence opens at column 0 and closes at the next bare run of the same mark that is at
    least as long. An opener that never closes is ordinary text.
    """
    marks = F.filter(
        F.transform(
            lines,
            lambda line, i: F.struct(
                i.alias("at"),
                F.regexp_extract(line, r"^(`{3,}|~{3,})", 1).alias("run"),
                line.rlike(r"(?U)^(`{3,}|~{3,})\s*$").alias("bare"),
            ),
        ),
        lambda m: m["run"] != "",
    )

    none = F.array().cast(_RANGES)

    def closes(o, c):
        return (
            c["bare"]
            & (F.substring(c["run"], 1, 1) == F.substring(o["run"], 1, 1))
            & (F.length(c["run"]) >= F.length(o["run"]))
        )

    def pair(first, last):
        return F.array(F.struct(first.alias("first"), last.alias("last")))

    def walk(acc, m):
        opened = acc["open"].isNotNull()
        shut = opened & closes(acc["open"], m)
        return F.struct(
            F.when(shut, F.lit(None)).when(opened, acc["open"]).otherwise(m).alias("open"),
            F.when(shut, F.concat(acc["out"], pair(acc["open"]["at"], m["at"]))).otherwise(acc["out"]).alias("out"),
        )

    def search(ms):
        """Each opener looks for its closer: needed only behind an opener that never closes."""
        def closer(m):
            fits = F.filter(ms, lambda c: (c["at"] > m["at"]) & closes(m, c))
            return F.try_element_at(fits, F.lit(1))["at"]

        def step(acc, m):
            return F.when(m["at"] <= acc["until"], acc).otherwise(
                let(
                    closer(m),
                    lambda last: F.when(last.isNull(), acc).otherwise(
                        F.struct(last.alias("until"), F.concat(acc["out"], pair(m["at"], last)).alias("out"))
                    ),
                )
            )

        start = F.struct(F.lit(-1).alias("until"), none.alias("out"))
        return F.aggregate(ms, start, step, lambda acc: acc["out"])

    def ranges(ms):
        start = F.struct(F.lit(None).cast(_MARK).alias("open"), none.alias("out"))
        walked = F.aggregate(ms, start, walk)
        return let(
            walked,
            lambda w: F.when(w["open"].isNull(), w["out"]).otherwise(
                F.concat(
                    w["out"], let(F.filter(ms, lambda m: m["at"] > w["open"]["at"]), search)
                )
            ),
        )

    return F.coalesce(let(marks, ranges), none)


def outside_fences(positions: Column, lines: Column) -> Column:
    """Those of the 0-based line numbers that lie in no fenced block."""
    fenced = F.flatten(F.transform(fence_ranges(lines), lambda r: F.sequence(r["first"], r["last"])))
    return F.array_except(positions, fenced)


def _title_key(title: Column) -> Column:
    """Heading title compared without regard to case or the amount of white space."""
    return F.lower(strip(F.regexp_replace(title, r"(?U)\s+", " ")))


def clean_section_name(name: Column) -> Column:
    return strip(F.regexp_replace(name, r"\A#+", ""))


def _heading(line: Column, at: Column) -> Column:
    return F.struct(
        at.alias("at"),
        F.length(F.regexp_extract(line, r"^(#+)", 1)).alias("level"),
        line.rlike(r"(?U)^#+(\s|$)").alias("spaced"),
        _title_key(F.regexp_extract(line, r"(?s)^#+(.*)$", 1)).alias("title"),
    )


def _heading_rows(lines: Column) -> Column:
    return F.filter(F.transform(lines, _heading), lambda h: h["level"] > 0)


def section_ranges(lines: Column, name: Column, fence_aware: bool = False) -> Column:
    """Every section with this heading as (first, last, level): 0-based, ``last`` excluded.

    A section ends at the next heading of the same or a higher level.
    """
    wanted = _title_key(clean_section_name(name))

    def ranges(heads, ends):
        def stops(m):
            later = F.filter(
                ends, lambda h: (h["at"] > m["at"]) & (h["level"] <= m["level"]) & h["spaced"]
            )
            return F.coalesce(F.try_element_at(later, F.lit(1))["at"], F.size(lines))

        return F.transform(
            F.filter(heads, lambda h: h["title"] == wanted),
            lambda m: F.struct(
                m["at"].alias("first"), stops(m).alias("last"), m["level"].alias("level")
            ),
        )

    def open_heads(heads):
        free = outside_fences(F.transform(heads, lambda h: h["at"]), lines)
        return F.transform(free, lambda at: _heading(F.get(lines, at), at))

    return let(
        _heading_rows(lines),
        lambda heads: let(open_heads(heads), lambda ends: ranges(heads, ends))
        if fence_aware
        else ranges(heads, heads),
    )


def _span(lines: Column, r: Column) -> Column:
    return F.slice(lines, r["first"] + 1, r["last"] - r["first"])


def section(text: Column | str, name: Column, fence_aware: bool = False) -> Column:
    """First section with this heading, heading included; null when there is none."""
    return let(
        raw_lines(col(text)),
        lambda lines: let(
            F.try_element_at(section_ranges(lines, name, fence_aware), F.lit(1)),
            lambda r: F.when(r.isNotNull(), strip_newlines(join_lines(_span(lines, r)))),
        ),
    )


def section_start_line(text: Column | str, name: Column) -> Column:
    """1-based line of the first such heading, null when there is none."""
    return let(
        raw_lines(col(text)),
        lambda lines: F.try_element_at(section_ranges(lines, name), F.lit(1))["first"] + 1,
    )


def find_sections(text: Column | str, name: Column) -> Column:
    """All ranges of a heading as 1-based inclusive (start_line, end_line)."""
    return let(
        raw_lines(col(text)),
        lambda lines: F.transform(
            section_ranges(lines, name),
            lambda r: F.struct(
                (r["first"] + 1).alias("start_line"), r["last"].alias("end_line")
            ),
        ),
    )


def drop_section(text: Column, name: Column) -> Column:
    """The text without the first section of this name."""
    def cut(lines, r):
        rest = F.concat(head_to(lines, r["first"]), tail_from(lines, r["last"]))
        at_end = (r["last"] == F.size(lines)) & (r["first"] > 0)
        return F.concat(join_lines(rest), F.when(at_end, F.lit("\n")).otherwise(F.lit("")))

    return let(
        raw_lines(text),
        lambda lines: let(
            F.try_element_at(section_ranges(lines, name), F.lit(1)),
            lambda r: F.when(r.isNull(), text).otherwise(cut(lines, r)),
        ),
    )


def outline(text: Column | str) -> Column:
    """Heading lines of a document in order, trimmed."""
    lines = F.transform(F.split(col(text), r"\r?\n", -1), lambda x: strip(x))
    return F.filter(lines, lambda x: x.startswith("#"))


# --- edits: every function returns struct<content, error>; content is null on error ---------


def _ok(content: Column) -> Column:
    return F.struct(content.alias("content"), F.lit(None).cast("string").alias("error"))


def _err(message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(None).cast("string").alias("content"), message.alias("error"))


def _without_own_header(new: Column, name: Column) -> Column:
    """New section text without a first line that repeats the heading."""
    body = lstrip(new)
    first = F.substring_index(body, "\n", 1)
    same = first.rlike(r"^#") & (_title_key(F.regexp_extract(first, r"(?s)^#+(.*)$", 1)) == _title_key(name))
    rest = F.regexp_replace(F.substring(body, F.length(first) + 1, F.length(body)), r"\A\n+", "")
    return F.when(same, rest).otherwise(new)


def _section_header(name: Column, level: Column) -> Column:
    return F.concat(
        F.lit("\n\n"), F.repeat(F.lit("#"), F.coalesce(level, F.lit(2))), F.lit(" "), name, F.lit("\n")
    )


def _guarded(checks: list[tuple[Column, Column | str]], result: Column) -> Column:
    """The first failing check as an error, else the result."""
    out = None
    for bad, message in checks:
        out = F.when(bad, _err(message)) if out is None else out.when(bad, _err(message))
    return result if out is None else out.otherwise(result)


def _missing_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("")) == ""


def replace_file(text: Column, new: Column) -> Column:
    return _guarded(
        [(is_blank(new), "Mode 'replace_file' requires non-empty content.")], _ok(new)
    )


def append_section(text: Column, name: Column, new: Column, level: Column) -> Column:
    def body(clean):
        exists = F.size(section_ranges(raw_lines(text), clean)) > 0
        done = F.concat(
            rstrip(text), _section_header(clean, level), _without_own_header(new, clean), F.lit("\n")
        )
        taken = F.concat(F.lit("Section '"), clean, F.lit("' already exists."))
        return _guarded([(exists, taken)], _ok(done))

    return _guarded(
        [
            (_missing_name(name), "Mode 'append_section' (write) requires 'section_name'."),
            (is_blank(new), "Mode 'append_section' requires non-empty content."),
        ],
        let(clean_section_name(name), body),
    )


def _one_section(text: Column, name: Column, build, verb: str) -> Column:
    """Apply ``build(lines, range)`` when the heading occurs exactly once."""
    def pick(lines):
        return let(
            section_ranges(lines, name),
            lambda rs: _guarded(
                [
                    (F.size(rs) == 0, F.concat(F.lit("Section '"), name, F.lit("' not found."))),
                    (
                        F.size(rs) > 1,
                        F.concat(F.lit("Multiple sections named '"), name, F.lit(f"' found. {verb} manually.")),
                    ),
                ],
                let(F.try_element_at(rs, F.lit(1)), lambda r: _ok(build(lines, r))),
            ),
        )

    return let(raw_lines(text), pick)


def replace_section(text: Column, name: Column, new: Column, level: Column) -> Column:
    def build(lines, r):
        clean = clean_section_name(name)
        return F.concat(
            rstrip(join_lines(head_to(lines, r["first"]))),
            _section_header(clean, level),
            _without_own_header(new, clean),
            F.lit("\n"),
            lstrip(join_lines(tail_from(lines, r["last"]))),
        )

    return _guarded(
        [
            (_missing_name(name), "Mode 'replace_section' (write) requires 'section_name'."),
            (is_blank(new), "Mode 'replace_section' requires non-empty content."),
        ],
        _one_section(text, name, build, "Fix"),
    )


def delete_section(text: Column, name: Column) -> Column:
    def build(lines, r):
        kept = F.concat(
            rstrip(join_lines(head_to(lines, r["first"]))),
            F.lit("\n\n"),
            lstrip(join_lines(tail_from(lines, r["last"]))),
        )
        return F.concat(strip(kept), F.lit("\n"))

    return _guarded(
        [(_missing_name(name), "Mode 'delete_section' requires 'section_name'.")],
        _one_section(text, name, build, "Delete"),
    )


def replace_chunk(text: Column, start: Column, end: Column, new: Column) -> Column:
    """Replace the 1-based lines start..end (end defaults to start); every line ends in a newline."""
    def build(lines):
        first = start - 1
        last = F.coalesce(end, start)
        closed = F.transform(lines, lambda x: F.concat(x, F.lit("\n")))
        body = F.coalesce(new, F.lit(""))
        body = F.when((body != "") & ~body.endswith("\n"), F.concat(body, F.lit("\n"))).otherwise(body)
        message = F.format_string("Invalid start line: %d. File has %d lines.", start, F.size(lines))
        spliced = F.concat(
            F.array_join(head_to(closed, F.greatest(first, F.lit(0))), ""),
            body,
            F.array_join(tail_from(closed, F.least(F.greatest(last, F.lit(0)), F.size(lines))), ""),
        )
        return _guarded([((start < 1) | (start > F.size(lines) + 1), message)], _ok(spliced))

    whole = F.regexp_replace(text, r"\n\z", "")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(raw_lines(whole))
    return _guarded(
        [(start.isNull(), "Mode 'replace_chunk' requires start_line and end_line (1-indexed).")],
        let(lines, build),
    )


def patch(text: Column, old: Column, new: Column) -> Column:
    """Replace a text that occurs exactly once."""
    def build(n):
        many = F.format_string("Patch target string found %d times. The match must be unique.", n)
        return _guarded(
            [(n == 0, "Patch target string not found."), (n > 1, many)],
            _ok(F.when(old == "", new).otherwise(F.replace(text, old, new))),
        )

    # An empty target occurs once in an empty text and between all characters of any other.
    hits = F.when(old == "", F.length(text) + 1).otherwise(
        ((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("int")
    )
    return _guarded(
        [
            (old.isNull(), "Mode 'patch' requires 'old_str'."),
            (is_blank(new), "Mode 'patch' requires non-empty replacement content."),
        ],
        let(hits.cast("int"), build),
    )
