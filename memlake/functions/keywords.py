"""Identifier-like keywords of a chunk, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.exprs import col, let

# Keyword budget and words that look like acronyms but only stress a sentence.
MAX_TERMS = 20
MAX_BYTES = 512
MAX_TERM_CHARS = 64
STUB_MIN_TOKENS = 3
ACRONYM_CHARS = (2, 6)
EMPHASIS_WORDS = ("NOT", "ALWAYS", "NEVER", "MUST", "ONLY", "ALSO")

_NONE = "array<string>"


def chunk_body(section: Column | str, text: Column | str) -> Column:
    """Chunk text without its breadcrumb line and its own heading line."""
    section, text = F.coalesce(col(section), F.lit("")), col(text)
    prefix = F.concat(section, F.lit("\n"))
    rest = F.substring(text, F.length(prefix) + 1, F.length(text))
    first = F.substring_index(rest, "\n", 1)
    headless = F.substring(rest, F.length(first) + 2, F.length(rest))
    headed = first.rlike(r"(?U)^#{1,3}\s")
    return F.when((section == "") | ~F.startswith(text, prefix), text).otherwise(
        F.when(headed, headless).otherwise(rest)
    )


def is_stub(body: Column | str, min_tokens: int = STUB_MIN_TOKENS) -> Column:
    return F.regexp_count(col(body), F.lit(r"(?U)[^\W_]+")) < min_tokens


def fold_case(text: Column | str) -> Column:
    """Lower case with the sharp s spelled out, so both spellings meet."""
    return F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))


def token_class(token: Column) -> Column:
    """0 letters with digits, 1 joined, 2 mixed case, 3 acronym, 4 digit groups; null otherwise."""
    letters = token.rlike(r"\p{L}")
    digits = token.rlike(r"\p{Nd}")
    upper = token.rlike(r"\p{Lu}")
    joined = token.rlike(r"(?s)^.+[-_.:/].+$")
    marked = digits | upper | token.rlike(r"[-_]") | token.rlike(r"(?U)\w{2,}\.[A-Za-z0-9]{1,5}$")
    low, high = ACRONYM_CHARS
    acronym = (
        token.rlike(rf"^\p{{L}}{{{low},{high}}}$")
        & upper
        & ~token.rlike(r"[\p{Ll}\p{Lt}]")
        & ~token.isin(*EMPHASIS_WORDS)
    )
    return (
        F.when(letters & digits & ~joined, 0)
        .when(letters & joined & marked, 1)
        .when(token.rlike(r"[\p{Ll}\p{Lt}]") & token.rlike(r"(?s)^.+\p{Lu}"), 2)
        .when(acronym, 3)
        .when(digits & ~letters & joined & (F.length(token) >= 5), 4)
        .cast("int")
    )


def identifier_terms(body: Column | str, max_chars: int | None = MAX_TERM_CHARS) -> Column:
    """Case-folded identifier-like terms, first occurrence kept, ordered by class then position.

    Longer tokens than ``max_chars`` are no terms; without it all are, for ``budget`` to report.
    """
    # Every class needs a digit, or a capital or joiner past the first character; most words
    # have none and stop here.
    likely = F.filter(
        F.split(col(body), r"(?U)\s+", -1), lambda t: t.rlike(r"(?s)\p{Nd}|.\p{Lu}|.[-_.:/].")
    )
    tokens = F.transform(likely, lambda t: F.regexp_replace(t, r"(?U)\A\W+|\W+\z", ""))
    if max_chars is not None:
        tokens = F.filter(tokens, lambda t: F.length(t) <= max_chars)
    classed = F.filter(
        F.transform(
            tokens,
            lambda t, i: F.struct(fold_case(t).alias("term"), i.alias("at"), token_class(t).alias("class")),
        ),
        lambda x: x["class"].isNotNull(),
    )
    firsts = let(
        F.array_sort(classed),
        lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["term"] != x["term"])),
    )
    ordered = F.array_sort(
        F.transform(
            firsts, lambda x: F.struct(x["class"].alias("class"), x["at"].alias("at"), x["term"].alias("term"))
        )
    )
    return F.transform(ordered, lambda x: x["term"])


def budget(
    terms: Column, max_terms: int = MAX_TERMS, max_bytes: int = MAX_BYTES, max_chars: int = MAX_TERM_CHARS
) -> Column:
    """Greedy struct<kept, dropped>: a term that is too long or over the byte budget is dropped, later ones may fit."""
    none = F.array().cast(_NONE)

    def step(acc, term):
        cost = F.octet_length(term) + F.when(F.size(acc["kept"]) > 0, 1).otherwise(0)
        short = F.length(term) <= max_chars
        fits = short & (F.size(acc["kept"]) < max_terms) & (acc["bytes"] + cost <= max_bytes)
        keep = F.struct(
            F.concat(acc["kept"], F.array(term)).alias("kept"),
            acc["dropped"].alias("dropped"),
            (acc["bytes"] + cost).alias("bytes"),
        )
        drop = F.struct(
            acc["kept"].alias("kept"),
            F.concat(acc["dropped"], F.array(term)).alias("dropped"),
            acc["bytes"].alias("bytes"),
        )
        return F.when(fits, keep).otherwise(drop)

    start = F.struct(none.alias("kept"), none.alias("dropped"), F.lit(0).alias("bytes"))
    return F.aggregate(
        terms, start, step,
        lambda acc: F.struct(acc["kept"].alias("kept"), acc["dropped"].alias("dropped")),
    )


def extract_keywords(section: Column | str, text: Column | str) -> Column:
    """struct<kept, dropped> of a chunk; a stub of fewer than three words has neither."""
    none = F.array().cast(_NONE)
    return let(
        chunk_body(section, text),
        lambda body: F.when(
            is_stub(body), F.struct(none.alias("kept"), none.alias("dropped"))
        ).otherwise(budget(identifier_terms(body, None))),
    )
