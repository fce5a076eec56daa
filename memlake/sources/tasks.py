"""Task documents with front matter, and the load of legacy backlog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.exprs import col, strip
from memlake.functions.paths import route_dir, route_path
from memlake.functions.text import flat_mapping, flow_list, key_number

# Fields and sections of a task document, legacy states, spellings and id ranges.
META_KEYS = ("id", "key", "title", "type", "status", "priority", "blocked_by", "where", "updated", "project")
SECTIONS = ("Problem", "Solution", "Comments", "Resolution")
FILE_STATUS = {"active": "open", "paused": "paused", "done": "closed"}
LEGACY_TYPES = {"Ф": "F", "Б": "B", "ТД": "TD"}
TYPE_OFFSETS = {"F": 1_000_000, "B": 2_000_000, "TD": 3_000_000}
OTHER_OFFSET = 4_000_000


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _section(body: Column, header: str) -> Column:
    """Text from a section marker to the next level-2 marker, null without the marker."""
    marker = f"## {header}"
    after = F.substring(body, F.instr(body, marker) + len(marker), F.length(body))
    return F.when(F.contains(body, F.lit(marker)), strip(F.substring_index(after, "## ", 1)))


def read_task_docs(docs: DataFrame) -> DataFrame:
    """Task documents as columns: path, the metadata fields, the four sections, error.

    A field of the metadata block wins over the section of the same name.
    """
    parts = F.split("content", "---", 3)
    error = (
        F.when(~F.col("content").startswith("---"), "Invalid document (no front matter)")
        .when(F.size(parts) < 3, "Invalid document (front matter is not closed)")
    )
    staged = docs.withColumn("error", error)
    staged = staged.withColumn("_meta", F.when(F.col("error").isNull(), flat_mapping(parts[1])))
    staged = staged.withColumn("_body", F.when(F.col("error").isNull(), strip(parts[2])))
    value = lambda name: F.element_at("_meta", F.lit(name))
    fields = []
    for name in META_KEYS:
        v = value(name)
        if name == "id":
            v = v.try_cast("long")
        elif name in ("blocked_by", "where"):
            v = flow_list(F.coalesce(v, F.lit("")))
        fields.append(v.alias(name))
    sections = [F.coalesce(value(s.lower()), _section(F.col("_body"), s)).alias(s.lower()) for s in SECTIONS]
    return staged.select("path", *fields, *sections, "error")


def task_document(columns: list[str]) -> Column:
    """A task row as document text; only fields that are there are written."""
    lines = []
    for name in META_KEYS:
        if name not in columns:
            continue
        value = F.col(name)
        if name in ("blocked_by", "where"):
            value = F.concat(F.lit("["), F.array_join(F.coalesce(value, F.array()), ", "), F.lit("]"))
        lines.append(F.concat(F.lit(f"{name}: "), value.cast("string")))
    sections = [
        F.when(F.coalesce(F.col(s.lower()), F.lit("")) != "", F.concat(F.lit(f"## {s}\n"), F.col(s.lower()), F.lit("\n")))
        for s in SECTIONS
        if s.lower() in columns
    ]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.concat_ws("\n", *sections))


def task_documents(tasks: DataFrame) -> DataFrame:
    """Tasks as documents with their place: key, status_dir, year, path, content."""
    year = F.year("updated") if "updated" in tasks.columns else F.lit(None).cast("int")
    return tasks.select(
        "key", route_dir("status").alias("status_dir"), year.alias("year"),
        route_path("key", "status", year).alias("path"), task_document(tasks.columns).alias("content"),
    )


def write_task_documents(tasks: DataFrame, target: str, per_file: int = 100_000) -> None:
    """Write task documents below a folder, divided by state and year."""
    (
        task_documents(tasks)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", per_file)
        .partitionBy("status_dir", "year")
        .parquet(target)
    )


def etl_legacy_tasks(
    rows: DataFrame, project: str, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, errors, report) from legacy rows.

    ``rows`` has file_key, id, title, type, status, priority, updated, problem, solution, comments and
    blocked_by, where as arrays (null when the source was not a list). A row without an id is an error.
    """
    no_id = F.coalesce(F.col("id").cast("string"), F.lit("")) == ""
    kind = F.coalesce(F.col("type"), F.lit("F"))
    kind = F.coalesce(F.element_at(_lookup(LEGACY_TYPES), kind), kind)
    offset = F.coalesce(F.element_at(_lookup(TYPE_OFFSETS), kind), F.lit(OTHER_OFFSET))
    none = F.array().cast("array<string>")
    known = rows.where(F.col("file_key").isin(*FILE_STATUS))
    good = known.where(~no_id).select(
        (offset + key_number("id")).cast("long").alias("id"),
        F.col("id").cast("string").alias("key"),
        F.coalesce("title", F.lit("No Title")).alias("title"),
        kind.alias("type"),
        F.coalesce("status", F.element_at(_lookup(FILE_STATUS), F.col("file_key"))).alias("status"),
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("updated", now).alias("updated"),
        F.lit(project).alias("project"),
        "problem", "solution", "comments",
        F.coalesce("blocked_by", none).alias("blocked_by"),
        F.coalesce("where", none).alias("where"),
    )
    errors = known.where(no_id).select("file_key", "title", F.lit("Missing task ID").alias("error"))
    report = known.groupBy("file_key").agg(
        F.count_if(~no_id).alias("created"), F.count_if(no_id).alias("errors")
    )
    return good, errors, report
