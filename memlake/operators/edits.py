"""Ordered batch edits over many documents."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import markdown, rules
from memlake.functions.exprs import let
from memlake.functions.paths import base_name
from memlake.operators.skew import asked_for, broadcast_if_small, split_rank
from memlake.operators.versions import snapshot
from memlake.session import cut_lineage

EDIT_FIELDS = {
    "content": "string", "old_str": "string", "section_name": "string",
    "start_line": "int", "end_line": "int", "header_level": "int",
}
EDITS_PER_ROUND = 256

Mode = Callable[[Column, Column], Column]

EDIT_MODES: dict[str, Mode] = {
    "replace_file": lambda text, e: markdown.replace_file(text, e["content"]),
    "create": lambda text, e: markdown.replace_file(text, e["content"]),
    "new": lambda text, e: markdown.replace_file(text, e["content"]),
    "append_section": lambda text, e: markdown.append_section(
        text, e["section_name"], e["content"], e["header_level"]
    ),
    "replace_section": lambda text, e: markdown.replace_section(
        text, e["section_name"], e["content"], e["header_level"]
    ),
    "replace_chunk": lambda text, e: markdown.replace_chunk(
        text, e["start_line"], e["end_line"], e["content"]
    ),
    "patch": lambda text, e: markdown.patch(text, e["old_str"], e["content"]),
    "delete_section": lambda text, e: markdown.delete_section(text, e["section_name"]),
}

Hook = Callable[[Column, Column], Column]


def prepend_only(text: Column, e: Column) -> Column:
    """Reason why an edit would not keep a log whole: only patches that start at its top may pass."""
    old = F.coalesce(e["old_str"], F.lit(""))
    return (
        F.when(e["mode"] != "patch", F.concat(F.lit("mode '"), e["mode"], F.lit("' is not permitted: only 'patch' may prepend to this log.")))
        .when((text == "") & (old != ""), "The first entry must have an empty 'old_str'.")
        .when((text != "") & ((old == "") | ~F.startswith(text, old)),
              "Only edits anchored at the very start of the file are allowed.")
    )


INTEGRITY_HOOKS: dict[str, Hook] = {"history.md": prepend_only}


def register_mode(name: str, mode: Mode, fields: list[str]) -> None:
    """Add a write mode: (text, edit) to struct<content, error>, and the fields it uses."""
    EDIT_MODES[name] = mode
    rules.MODE_FIELDS[name] = fields


def register_hook(file_name: str, hook: Hook) -> None:
    """Guard every document of this name: (text, edit) to a reason or null."""
    INTEGRITY_HOOKS[file_name] = hook


class EditResult(NamedTuple):
    docs: DataFrame
    results: DataFrame
    versions: DataFrame


def order_edits(edits: DataFrame) -> DataFrame:
    """Number the edits of every path: line replacements from the bottom up, then input order."""
    lines = F.col("mode") == "replace_chunk"
    chunk = split_rank(edits.where(lines), ["path"], "start_line", ties=["seq"], descending=True, name="position")
    rest = split_rank(edits.where(~lines), ["path"], "seq", name="position")
    ahead = edits.where(lines).groupBy("path").agg(F.count(F.lit(1)).alias("_ahead"))
    later = rest.join(ahead, "path", "left").withColumn(
        "position", F.col("position") + F.coalesce("_ahead", F.lit(0))
    )
    return chunk.unionByName(later.drop("_ahead"))


def _sorted_edit() -> Column:
    """An edit as a struct that sorts into application order."""
    is_lines = F.col("mode") == "replace_chunk"
    return F.struct(
        (~is_lines).alias("late"),
        F.when(is_lines, -F.coalesce("start_line", F.lit(0))).otherwise(0).alias("down"),
        "seq", "mode", *EDIT_FIELDS,
    )


def _step(text: Column, path: Column, e: Column) -> Column:
    """struct<content, error> of one edit."""
    applied = None
    for name, mode in EDIT_MODES.items():
        test = e["mode"] == name
        applied = F.when(test, mode(text, e)) if applied is None else applied.when(test, mode(text, e))
    for file_name, hook in INTEGRITY_HOOKS.items():
        reason = hook(text, e)
        refused = F.struct(F.lit(None).cast("string").alias("content"), reason.alias("error"))
        applied = F.when((base_name(path) == file_name) & reason.isNotNull(), refused).otherwise(applied)
    return applied


_RESULTS = "array<struct<seq:bigint,error:string>>"


def _fold(text: Column, path: Column, edits: Column) -> Column:
    """struct<content, results> after applying edits in order; a failing edit changes nothing."""
    def step(acc, e):
        def settle(out):
            entry = F.struct(e["seq"].cast("long").alias("seq"), out["error"].alias("error"))
            return F.struct(
                F.when(out["error"].isNull(), out["content"]).otherwise(acc["content"]).alias("content"),
                F.concat(acc["results"], F.array(entry)).alias("results"),
            )

        return let(_step(acc["content"], path, e), settle)

    start = F.struct(text.alias("content"), F.array().cast(_RESULTS).alias("results"))
    return F.aggregate(edits, start, step)


def _round(state: DataFrame, batch: DataFrame) -> DataFrame:
    """path, content, whether anything was changed so far, and the results of this round."""
    grouped = batch.groupBy("path").agg(F.array_sort(F.collect_list(_sorted_edit())).alias("_edits"))
    folded = state.join(grouped, "path").withColumn("_f", _fold(F.col("content"), F.col("path"), F.col("_edits")))
    results = F.col("_f")["results"]
    written = folded.select(
        "path", F.col("_f")["content"].alias("content"),
        (F.col("changed") | F.exists(results, lambda r: r["error"].isNull())).alias("changed"),
        results.alias("results"),
    )
    # Documents and results are both read from it, so no edit is applied twice.
    return cut_lineage(written)


def _rounds(state: DataFrame, valid: DataFrame, most: int, per_round: int) -> tuple[DataFrame, DataFrame]:
    """(final documents, result rows). A document leaves the rounds with its last edit."""
    if most <= per_round:
        folded = _round(state, valid)
        return folded.drop("results"), folded.select("path", F.inline("results"))
    numbered = cut_lineage(order_edits(valid))
    finished, outcomes = [], []
    for low in range(0, most, per_round):
        high = low + per_round
        batch = numbered.where((F.col("position") > low) & (F.col("position") <= high))
        folded = _round(state, batch.drop("position"))
        more = broadcast_if_small(numbered.where(F.col("position") > high).select("path").distinct())
        outcomes.append(folded.select("path", F.inline("results")))
        finished.append(folded.drop("results").join(more, "path", "left_anti"))
        state = folded.drop("results").join(more, "path", "left_semi")
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(finished), union(outcomes)


def apply_edits(
    docs: DataFrame, edits: DataFrame, now: Column, per_round: int = EDITS_PER_ROUND
) -> EditResult:
    """Apply a batch of edits: new documents, a result per edit, versions of what was overwritten.

    ``edits`` has seq, path, mode and the fields of EDIT_FIELDS; ``docs`` has path and content. An
    edit that cannot be applied is reported and the others of its document go on. A document that
    does not exist starts empty.

    Edits of one document must follow each other, so they meet in one row, at most ``per_round`` at
    a time: a document with more goes through several rounds, its state kept in between. Rounds are
    written as they are computed; only documents with edits left go into the next one.
    """
    have = set(edits.columns)
    full = edits.select(
        F.col("seq").cast("long").alias("seq"), "path", "mode",
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in EDIT_FIELDS.items()],
    )
    judged = full.withColumn("_reason", rules.edit_reason())
    refused = judged.where(F.col("_reason").isNotNull()).select(
        "seq", "path", "mode", F.lit("error").alias("status"), F.col("_reason").alias("message")
    )
    valid = judged.where(F.col("_reason").isNull()).drop("_reason")
    touched = valid.select("path").distinct()
    state = touched.join(asked_for(docs.select("path", "content"), touched, ["path"]), "path", "left").select(
        "path", F.coalesce("content", F.lit("")).alias("content"), F.lit(False).alias("changed")
    )
    most = valid.groupBy("path").count().agg(F.max("count").alias("m")).first()["m"] or 0
    state, outcome = _rounds(state, valid, most, per_round)
    message = F.coalesce(
        F.col("error"), F.concat(F.lit("Applied "), F.col("mode"), F.lit(" to memory successfully. File saved."))
    )
    results = valid.select("seq", "path", "mode").join(outcome, ["seq", "path"]).select(
        "seq", "path", "mode", F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"),
        message.alias("message"),
    )
    changed = state.where("changed").select("path", "content")
    kept = snapshot(docs, changed, now)
    fresh = broadcast_if_small(changed.withColumnRenamed("content", "_new"))
    replaced = docs.join(fresh, "path", "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")
    known = asked_for(docs.select("path"), changed, ["path"])
    added = changed.join(known, "path", "left_anti")
    new_docs = replaced.select(*docs.columns).unionByName(added, allowMissingColumns=True)
    return EditResult(new_docs, results.unionByName(refused), kept)
