"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text go too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.exprs import let
from memlake.llm.base import narrow, no_items
from memlake.llm.mixing import WORD, word_count

SPACES = " \t\n\x0b\x0c\r"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: A document must keep this share of its words.
LEAST_KEPT = 0.5

# Fixed values of the line rules.
SENTENCE_END = r"""[.!?…:;,。！？]["'”’»)\]]*(?:[\x20\x09-\x0D]|$)"""
SEPARATOR = r"[|»›•·]"
SYMBOL_RUN = r"[#*$%&<>=~^_\\]{2,}|!{2,}"
BOILERPLATE = (
    r"(?i)(?<![a-z])(?:cookies?|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|"
    r"subscribe (?:now|to)|sign (?:in|up)|log in|click here|read more|share this|back to top|skip to content|"
    r"add to cart|follow us|contact us|site ?map|page not found|powered by)(?![a-z])"
)
BOILERPLATE_WORDS = 30


def line_rules(line: Column) -> dict[str, Column]:
    """Which rule a line fails; a line without words fails none.

    punctuation: no sentence or clause ends in it, or every third word carries a run of symbols.
    navigation: three separators or more, and one for every five words.
    boilerplate: a short line with a phrase of page furniture.
    """
    words = F.regexp_count(line, F.lit(WORD))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    runs = F.regexp_count(line, F.lit(SYMBOL_RUN))
    return {
        "punctuation": ~line.rlike(SENTENCE_END) | (runs * 3 > words),
        "navigation": (separators >= 3) & (separators * 5 >= words),
        "boilerplate": (words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE),
    }


def _fails(line: Column) -> Column:
    rules = list(line_rules(line).values())
    return rules[1] | rules[2] | rules[0]


def _lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return F.coalesce(lines, no_items("string"))


def _repeated(words: Column) -> Column:
    """How many words lie in a run of three that comes twice or more.

    Equal runs lie side by side once they are sorted. Each step is bound to a variable, so a filter on the
    result may be evaluated anywhere without computing a step again for each element.
    """
    def runs(h):
        return F.when(F.size(h) >= 3, F.sort_array(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("at")),
        ))).otherwise(no_items("struct<h:bigint,at:int>"))

    def inside(r):
        again = F.filter(r, lambda x, i: (F.get(r, i - 1)["h"] == x["h"]) | (F.get(r, i + 1)["h"] == x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(
            again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(runs(h), inside))


def clean_lines(docs: DataFrame, id: str = "doc_id", text: str = "text",
                least_kept: float = LEAST_KEPT) -> DataFrame:
    """Judge every document by its lines.

    Returns doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words (words
    of the lines that pass), cleaned (those lines), base_failed and kept, one row per input row. All of it is
    computed inside the row.

    A line is what lies between newlines; one without words is neither judged nor kept. A word counts as
    repeated if a run of three words that holds it comes twice or more; runs are compared by a 64-bit hash.
    Null text: no words and no lines, fails. A document without words fails. Empty tables give no rows;
    other columns are ignored; ids and repeated rows don't matter.
    """
    rows = narrow(docs, doc_id=id, text=text)
    words = F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), no_items("string"))
    judged = rows.select(
        "doc_id", "text",
        let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("again"))).alias("_w"),
        let(_lines(F.col("text")), lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).alias("again"),
            F.array_join(F.filter(x, lambda line: ~_fails(line)), "\n").alias("good"))).alias("_l"),
    )
    counted = judged.select(
        "doc_id", "text",
        F.col("_w")["n"].cast("long").alias("n_words"),
        F.coalesce(F.char_length(F.translate("text", SPACES, "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOL)), F.lit(0)).cast("long").alias("n_symbols"),
        F.col("_l")["again"].cast("long").alias("n_dup_lines"),
        F.col("_w")["again"].cast("long").alias("n_repeat_words"),
        F.col("_l")["good"].alias("cleaned"),
    ).withColumn("n_kept_words", word_count("cleaned"))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    enough = F.col("n_kept_words") >= F.lit(float(least_kept)) * F.col("n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)
