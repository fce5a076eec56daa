"""Row rules. Every rule is a reason Column: null when the row passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.exprs import col, is_blank, strip

# Task vocabulary, allowed moves, protected log, edit modes and the fields they use.
STATUSES = ("open", "in_progress", "paused", "done", "closed")
PRIORITIES = ("critical", "high", "medium", "low")
TYPES = ("F", "B", "TD")
TRANSITIONS = {
    "open": ["paused", "closed", "analysis", "blocked"],
    "blocked": ["closed", "paused", "open"],
    "paused": ["open", "closed"],
    "analysis": ["open", "closed", "paused"],
    "closed": [],
}
DECISION_LOG = "memory/decisions.md"
MODE_FIELDS = {
    "replace_file": ["content"],
    "create": ["content"],
    "new": ["content"],
    "append_section": ["content", "section_name", "header_level"],
    "replace_section": ["content", "section_name", "header_level"],
    "replace_chunk": ["content", "start_line", "end_line"],
    "patch": ["content", "new_str", "old_str"],
    "delete_section": ["section_name"],
}
FRAMEWORK_FIELDS = ["path", "mode", "extra_fields"]
MIN_RESOLUTION = 5


def first_reason(*reasons: Column) -> Column:
    """The first failing rule speaks for the row."""
    return F.coalesce(*reasons)


def resolution_reason(old: Column | str, new: Column | str, resolution: Column | str) -> Column:
    """A status change needs a resolution of at least five characters."""
    old, new = F.lower(F.coalesce(col(old), F.lit(""))), F.lower(col(new))
    note = F.length(strip(F.coalesce(col(resolution), F.lit(""))))
    changes = new.isNotNull() & (new != "") & (old != new)
    return F.when(
        changes & (note < MIN_RESOLUTION),
        F.concat(
            F.lit("Field 'resolution' (min 5 chars) required when changing status from '"),
            old, F.lit("' to '"), new, F.lit("'."),
        ),
    )


def transitions_table(spark: SparkSession, moves: dict[str, list[str]] | None = None) -> DataFrame:
    """Allowed moves as rows (old_status, allowed)."""
    rows = list((moves or TRANSITIONS).items())
    return spark.createDataFrame(rows, "old_status string, allowed array<string>")


def transition_reason(old: Column | str, new: Column | str, allowed: Column | str) -> Column:
    """``allowed`` is null for a status the table does not know, which may go anywhere."""
    old, new, allowed = F.lower(col(old)), F.lower(col(new)), col(allowed)
    bad = allowed.isNotNull() & (old != new) & ~F.array_contains(allowed, new)
    return F.when(
        bad, F.concat(F.lit("Invalid transition from '"), old, F.lit("' to '"), new, F.lit("'"))
    )


def check_transitions(
    moves: DataFrame, table: DataFrame, old: str = "old_status", new: str = "new_status"
) -> DataFrame:
    """Moves with a ``reason``. The table holds one row per status."""
    known = table.select(F.col("old_status").alias("_from"), "allowed")
    return (
        moves.join(known, F.lower(F.col(old)) == F.col("_from"), "left")
        .withColumn("reason", transition_reason(old, new, "allowed"))
        .drop("_from", "allowed")
    )


def new_task_reason(
    title: str = "title", problem: str = "problem", solution: str = "solution",
    type_: str = "type", status: str = "status", priority: str = "priority",
) -> Column:
    """Rules of a new task: text present, vocabulary known. Null status and priority take defaults."""
    blanks = [
        F.when(is_blank(col(c)), F.lit(f"{c}: Field cannot be empty")) for c in (title, problem, solution)
    ]
    return first_reason(
        *blanks,
        F.when(~F.coalesce(col(type_).isin(*TYPES), F.lit(False)), F.lit("type: unknown value")),
        F.when(~col(status).isin(*STATUSES), F.lit("status: unknown value")),
        F.when(~col(priority).isin(*PRIORITIES), F.lit("priority: unknown value")),
    )


def edit_reason(path: Column | str = "path", mode: Column | str = "mode") -> Column:
    """Why an edit cannot be tried at all."""
    path, mode = col(path), col(mode)
    missing = (F.coalesce(path, F.lit("")) == "") | (F.coalesce(mode, F.lit("")) == "")
    escapes = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | path.contains("\\")
    return first_reason(
        F.when(missing, F.lit("Missing 'path' or 'mode'")),
        F.when(
            (path == DECISION_LOG) & (mode != "append_section"),
            F.concat(
                F.lit("Domain protection: "), mode,
                F.lit(f" on {DECISION_LOG} is forbidden. ONLY append_section is permitted."),
            ),
        ),
        F.when(escapes, F.concat(F.lit("Invalid artifact path: "), path)),
        F.when(~mode.isin(*MODE_FIELDS), F.concat(F.lit("Unknown write mode: "), mode)),
    )


def unknown_fields(mode: Column | str, supplied: Column | str) -> Column:
    """Supplied field names the mode does not use, sorted."""
    mode, supplied = col(mode), col(supplied)
    used = F.create_map(
        *[x for m, fields in MODE_FIELDS.items() for x in (F.lit(m), F.array(*map(F.lit, fields)))]
    )
    allowed = F.coalesce(F.element_at(used, mode), F.array().cast("array<string>"))
    framework = F.array(*map(F.lit, FRAMEWORK_FIELDS))
    return F.array_sort(F.array_except(F.array_except(supplied, allowed), framework))


def unknown_fields_warning(mode: Column | str, supplied: Column | str) -> Column:
    names = unknown_fields(mode, supplied)
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    return F.when(
        F.size(names) > 0,
        F.concat(
            F.lit("Field(s) "), quoted, F.lit(" are not used by write mode '"), col(mode),
            F.lit("' and were ignored."),
        ),
    )


def title_key(title: Column | str) -> Column:
    return F.lower(strip(col(title)))
