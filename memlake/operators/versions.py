"""Document versions: listing, restore, snapshots, retention, role transitions, log checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.exprs import col, join_lines, let, split_lines, strip
from memlake.functions.paths import base_name, extension
from memlake.operators.skew import salted_join, split_lag, split_rank

# Time stamp of a version name and the lines that make up a session header.
STAMP = "yyyyMMdd_HHmmss"
HEADER_PREFIXES = (
    "# Session State",
    "## SESSION STATE",
    "**Current Task:**",
    "**next_agent_role:**",
    "next_agent_role:",
)
_ROLE = r"(?md)^\*\*next_agent_role:\*\*(?U:\s*)([^\n]+?)(?U:\s*)$"
_TASK = r"(?md)^\*\*Current Task:\*\*([^\n]*)$"
_BLOCK = r"(?msdi)^#{1,2}[ \t]*SESSION STATE[ \t]*$(.*?)(?=^#{1,2}[ \t]+\S|\z)"
_HEADING = r"(?mdi)^#{1,2}[ \t]*session state\b"


def version_name(path: Column | str, ts: Column | str) -> Column:
    return F.concat(F.date_format(col(ts), STAMP), extension(path))


def versions(hist: DataFrame, path: str = "path") -> DataFrame:
    """Every version of every document, newest first: rank 1 is the latest. At one time, the later text leads."""
    ranked = split_rank(
        hist, [path], "version_ts", ties=[F.desc("content")], descending=True, name="rank")
    return ranked.select(
        path, "rank", version_name(path, "version_ts").alias("name"), "version_ts",
        F.octet_length("content").alias("size"),
    )


def latest_versions(hist: DataFrame, path: str = "path") -> DataFrame:
    """The newest version per document, found by a maximum that is combined before the shuffle."""
    newest = hist.groupBy(path).agg(F.max(F.struct("version_ts", "content")).alias("v"))
    return newest.select(path, "v.version_ts", "v.content")


def find_version(hist: DataFrame, path: str, version_ts: Column) -> DataFrame:
    return hist.where((F.col("path") == path) & (F.col("version_ts") == version_ts))


def snapshot(docs: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    """Versions that keep the present content of documents about to be overwritten."""
    keys = changed.select("path").distinct()
    return docs.join(keys, "path", "left_semi").select("path", now.alias("version_ts"), "content")


def restore(
    docs: DataFrame, hist: DataFrame, requests: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, history, report). The content replaced is first kept as a new version.

    ``requests`` names one (path, version_ts) per document; of several the newest counts. An unknown
    version changes nothing.
    """
    wanted = requests.groupBy("path").agg(F.max("version_ts").alias("version_ts"))
    old = hist.groupBy("path", "version_ts").agg(F.max("content").alias("_old"))
    chosen = wanted.join(old, ["path", "version_ts"], "left")
    error = F.when(F.col("_old").isNull(), F.concat(F.lit("Version not found for "), F.col("path")))
    report = chosen.select("path", "version_ts", error.alias("error"))
    found = chosen.where(F.col("_old").isNotNull()).select("path", "_old")
    joined = docs.join(found, "path", "full_outer")
    restored = joined.withColumn("content", F.coalesce("_old", "content")).select(*docs.columns)
    return restored, hist.unionByName(snapshot(docs, found, now)), report


def retain(hist: DataFrame, hours: float, now: Column, path: str = "path") -> DataFrame:
    """Versions younger than ``hours``, and of every document at least the latest."""
    limit = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0).cast("decimal(18,6)"))
    newest = hist.groupBy(path).agg(F.max("version_ts").alias("version_ts"))
    old = hist.where(F.col("version_ts") < limit)
    # The join key includes the time stamp, so one busy document does not make one heavy key.
    kept = old.join(newest, [path, "version_ts"], "left_semi").select(*hist.columns)
    return hist.where(F.col("version_ts") >= limit).unionByName(kept)


def _find(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(1))


def next_agent_role(content: Column | str) -> Column:
    """Role named in the session block, or anywhere when there is no such block."""
    content = col(content)
    return _find(F.coalesce(_find(content, _BLOCK), content), _ROLE)


def current_task(content: Column | str) -> Column:
    return strip(_find(col(content), _TASK))


def handover(content: Column | str) -> Column:
    """struct<body, fallback>: text under the handover heading or mention, else the whole body."""
    def build(lines):
        at = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lower(x).alias("x")))
        named = F.filter(at, lambda s: F.contains(s["x"], F.lit("handover")))
        heading = F.try_element_at(
            F.filter(named, lambda s: s["x"].rlike(r"(?U)^[\s#*]*handover\b")), F.lit(1)
        )["i"]
        start = F.coalesce(heading, F.try_element_at(named, F.lit(1))["i"])
        stop = F.coalesce(
            F.try_element_at(
                F.filter(at, lambda s: (s["i"] > start) & s["x"].rlike(r"^#{2,3} ")), F.lit(1)
            )["i"],
            F.size(lines),
        )
        body = strip(join_lines(F.slice(lines, start + 2, stop - start - 1)))
        top = F.coalesce(
            F.try_element_at(
                F.filter(
                    F.transform(lines, lambda x, i: F.struct(i.alias("i"), strip(x).alias("x"))),
                    lambda s: s["x"].isin("# Session State", "## SESSION STATE"),
                ),
                F.lit(1),
            )["i"] + 1,
            F.lit(0),
        )
        whole = strip(join_lines(F.slice(lines, top + 1, F.size(lines))))
        return let(
            body,
            lambda b: F.when(
                b != "", F.struct(b.alias("body"), F.lit(False).alias("fallback"))
            ).otherwise(F.struct(whole.alias("body"), F.lit(True).alias("fallback"))),
        )

    return let(split_lines(col(content)), build)


def role_transitions(history: DataFrame, project: str = "project") -> DataFrame:
    """A log entry for every change of the next role between two versions of a session.

    The entry tells the task, the old role and the handover note of the version before. Nothing
    is logged when either version names no role or the old one says nothing useful.
    """
    facts = history.select(
        project, "version_ts", "content",
        next_agent_role("content").alias("role"),
        current_task("content").alias("task"),
        handover("content").alias("note"),
        (F.coalesce("content", F.lit("")) == "").alias("empty"),
    )
    pairs = split_lag(facts, [project], "version_ts", ["role", "task", "note", "empty"], ties=["content"])
    useful = F.col("prev_task").isNotNull() | ~F.col("prev_note")["fallback"]
    moved = pairs.where(
        ~F.col("prev_empty") & F.col("role").isNotNull() & F.col("prev_role").isNotNull()
        & (F.col("role") != F.col("prev_role")) & useful
    )
    day = F.date_format("version_ts", "yyyy-MM-dd")
    title = F.coalesce("prev_task", F.lit("Session Handoff"))
    body = F.col("prev_note")["body"]
    entry = F.concat(
        F.lit("## "), day, F.lit(" — "), title, F.lit("\n**next_agent_role:** "), F.col("prev_role"),
        F.when(body != "", F.concat(F.lit("\n\n### Handover Note\n"), body)).otherwise(""),
    )
    return moved.select(
        project, "version_ts", F.col("prev_role").alias("old_role"), F.col("role").alias("new_role"),
        title.alias("task_title"), entry.alias("entry"),
    )


def check_prepend_only(history: DataFrame, path: str = "path") -> DataFrame:
    """Per version: whether all earlier text is still there, below what was added."""
    pairs = split_lag(history, [path], "version_ts", ["content"], ties=["content"])
    valid = F.col("prev_content").isNull() | F.endswith(F.col("content"), F.col("prev_content"))
    return pairs.select(path, "version_ts", valid.alias("valid"))


def has_session_header(content: Column | str) -> Column:
    return col(content).rlike(_HEADING) & col(content).contains("next_agent_role:")


def header_block(content: Column | str) -> Column:
    """Header lines of a session document with a blank line after them, null without a header."""
    lines = F.filter(
        split_lines(col(content)), lambda x: F.greatest(*[x.startswith(p) for p in HEADER_PREFIXES])
    )
    return F.when(
        has_session_header(content) & (F.size(lines) > 0), F.concat(join_lines(lines), F.lit("\n\n"))
    )


def repair_header(docs: DataFrame, hist: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Session documents with a lost header get it back from the live text or the newest valid version."""
    blocks = hist.select("path", "version_ts", header_block("content").alias("_block"))
    newest = blocks.where(F.col("_block").isNotNull()).groupBy("path").agg(
        F.max_by("_block", "version_ts").alias("_old_block")
    )
    joined = docs.join(newest, "path", "left")
    if live is not None:
        stored = live.select("path", header_block("content").alias("_live_block"))
        joined = joined.join(stored, "path", "left")
    else:
        joined = joined.withColumn("_live_block", F.lit(None).cast("string"))
    broken = ~has_session_header("content")
    block = F.coalesce("_live_block", "_old_block")
    repaired = broken & block.isNotNull()
    return joined.withColumn("repaired", repaired).withColumn(
        "content", F.when(F.col("repaired"), F.concat(block, F.col("content"))).otherwise(F.col("content"))
    ).select(*docs.columns, "repaired")


def recycle(docs: DataFrame, paths: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining documents, recycled ones under a dated name, paths that were not there)."""
    keys = paths.select("path").distinct()
    gone = docs.join(keys, "path", "left_semi")
    stem = F.regexp_replace(base_name("path"), r"(?<=.)\.[^.]*$", "")
    ext = F.regexp_extract(base_name("path"), r"[^.](\.[^.]*)$", 1)
    recycled = gone.withColumn("recycled_name", F.concat(stem, F.lit("_"), F.date_format(now, STAMP), ext))
    missing = keys.join(docs.select("path"), "path", "left_anti")
    return docs.join(keys, "path", "left_anti"), recycled, missing
