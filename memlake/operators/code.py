"""Code-unit catalogue: prefilters, lookups, outlines, project maps and file summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.paths import is_test
from memlake.operators.skew import broadcast_if_small, split_rank, top_k_per_key

UNIT_KEY = ("project", "path", "chunk_type", "chunk_name")
# Unit kinds shown per outline depth, and whether their text is left out.
OUTLINE_DEPTH = {
    1: (("file", "imports", "namespace", "class"), True),
    2: (("file", "imports", "namespace", "class", "method"), False),
}
SUMMARY_NAMES = 10


def flag_tests(units: DataFrame) -> DataFrame:
    return units.withColumn("is_test", is_test("path"))


def code_prefilter(
    units: DataFrame, project: str | None = None, chunk_type: str | None = None,
    include_tests: bool = False, root: str | None = None,
) -> DataFrame:
    """Units a code search may see; every given condition must hold."""
    if project:
        units = units.where(F.col("project") == project)
    if chunk_type:
        units = units.where(F.col("chunk_type") == chunk_type)
    if not include_tests:
        units = units.where(~F.col("is_test"))
    if root:
        units = units.where(F.col("path").contains(root))
    return units


def find_units(
    units: DataFrame, names: DataFrame | Sequence[str], chunk_type: str | None = None,
    include_tests: bool = False,
) -> DataFrame:
    """Units with exactly one of the names; a table of names has a ``chunk_name`` column."""
    seen = code_prefilter(units, chunk_type=chunk_type, include_tests=include_tests)
    if isinstance(names, DataFrame):
        wanted = broadcast_if_small(names.select("chunk_name").distinct())
        return seen.join(wanted, "chunk_name", "left_semi").select(*units.columns)
    return seen.where(F.col("chunk_name").isin(*names))


def file_outline(
    units: DataFrame, path: str | DataFrame, project: str | None = None, depth: int = 0,
    summary_only: bool = False,
) -> DataFrame:
    """Units of files in line order. A file is named by its path or by the end of it after a '/'.

    Depth 0 shows everything, 1 names down to classes, 2 adds methods with their text. With
    ``summary_only`` depth 0 hides properties and texts. Imports always keep their text.
    """
    if project:
        units = units.where(F.col("project") == project)
    if isinstance(path, DataFrame):
        parts = F.split("path", "/")
        tails = F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"),
        )
        files = units.select("path").distinct().withColumn("asked", F.explode(tails))
        asked = path.select(F.col("path").alias("asked")).distinct()
        matched = files.join(broadcast_if_small(asked), "asked", "left_semi").select("path").distinct()
        chosen = units.join(matched, "path", "left_semi")
    else:
        posix = path.replace("\\", "/")
        chosen = units.where((F.col("path") == posix) | F.col("path").endswith("/" + posix))
    kinds, names_only = OUTLINE_DEPTH.get(depth, (None, False))
    if kinds:
        chosen = chosen.where(F.col("chunk_type").isin(*kinds))
    elif summary_only:
        chosen = chosen.where(F.col("chunk_type") != "property")
    text = F.col("skeleton_text")
    if names_only or (depth == 0 and summary_only):
        text = F.when(F.col("chunk_type") == "imports", text)
    return chosen.select(
        "path", "project", "chunk_type", "chunk_name", "start_line", "end_line",
        text.alias("skeleton_text"),
    ).orderBy("project", "path", "start_line", "chunk_type", "chunk_name")


def indexed_paths(df: DataFrame, project: str | None = None, include_tests: bool = True) -> DataFrame:
    """Distinct paths of an index; of a code index, those with a file unit."""
    if project and "project" in df.columns:
        df = df.where(F.col("project") == project)
    if "chunk_type" in df.columns:
        df = df.where(F.col("chunk_type") == "file")
        if not include_tests:
            df = df.where(~F.col("is_test"))
    return df.select("path").distinct()


def indexed_projects(df: DataFrame) -> DataFrame:
    return df.select("project").distinct()


def project_map(paths: DataFrame, depth: int = 2) -> DataFrame:
    """Directory tree of distinct paths cut at a depth: node, parent, depth, is_leaf, n_files.

    Directories end in '/'. Whatever stands at the cut is shown as a leaf.
    """
    parts = F.split(F.regexp_replace("path", r"\\", "/"), "/")
    files = paths.select("path").distinct().select(parts.alias("_parts"))
    cut = files.withColumn("_top", F.least(F.lit(depth), F.size("_parts"))).withColumn(
        "depth", F.explode(F.sequence(F.lit(1), F.col("_top")))
    )
    prefix = lambda n: F.array_join(F.slice("_parts", F.lit(1), n), "/")
    leaf = F.col("depth") == F.col("_top")
    node = F.when(leaf, prefix(F.col("depth"))).otherwise(F.concat(prefix(F.col("depth")), F.lit("/")))
    parent = F.when(F.col("depth") == 1, F.lit(".")).otherwise(
        F.concat(prefix(F.col("depth") - 1), F.lit("/"))
    )
    return (
        cut.select(node.alias("node"), parent.alias("parent"), "depth", leaf.alias("is_leaf"))
        .groupBy("node", "parent", "depth", "is_leaf")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


def dedupe_names(units: DataFrame, order: str = "position", project: str = "project") -> DataFrame:
    """Make (path, type, name) unique: the first keeps its name, later ones get ``_L<start_line>``.

    Should two of those fall on the same line, the later ones also get their occurrence number.
    """
    keys = [c for c in (project, "path", "chunk_type", "chunk_name") if c in units.columns]
    ranked = split_rank(units, keys, order, name="_nth")
    lined = F.concat(F.col("chunk_name"), F.lit("_L"), F.col("start_line").cast("string"))
    renamed = ranked.withColumn("_base", F.col("chunk_name")).withColumn(
        "chunk_name", F.when(F.col("_nth") == 1, F.col("chunk_name")).otherwise(lined)
    )
    again = split_rank(renamed, keys, order, name="_same")
    return again.withColumn(
        "chunk_name",
        F.when(F.col("_same") == 1, F.col("chunk_name")).otherwise(
            F.concat(F.col("chunk_name"), F.lit("_"), F.col("_nth").cast("string"))
        ),
    ).drop("_nth", "_same", "_base")


def file_summary(units: DataFrame, order: str = "start_line") -> DataFrame:
    """One summary row per file: the first ten class and method names, or a remark.

    Names are limited to ten per file and kind before they are gathered.
    """
    named = units.where(F.col("chunk_type").isin("class", "method"))
    counts = named.groupBy("project", "path", "chunk_type").agg(F.count(F.lit(1)).alias("n"))
    first = top_k_per_key(
        named, ["project", "path", "chunk_type"], [order, "chunk_name"], SUMMARY_NAMES, name="_nth"
    )
    lists = first.groupBy("project", "path", "chunk_type").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "chunk_name"))).alias("names")
    )
    label = F.when(F.col("chunk_type") == "class", "Classes: ").otherwise("Methods: ")
    joined = lists.join(counts, ["project", "path", "chunk_type"]).select(
        "project", "path", "chunk_type",
        F.concat(
            label,
            F.array_join(F.transform("names", lambda x: x["chunk_name"]), ", "),
            F.when(F.col("n") > SUMMARY_NAMES, "...").otherwise(""),
        ).alias("part"),
    )
    parts = joined.groupBy("project", "path").agg(
        F.max(F.when(F.col("chunk_type") == "class", F.col("part"))).alias("c"),
        F.max(F.when(F.col("chunk_type") == "method", F.col("part"))).alias("m"),
    )
    spans = units.groupBy("project", "path").agg(F.max("end_line").alias("end_line"))
    summary = F.coalesce(F.nullif(F.concat_ws(" | ", "c", "m"), F.lit("")), F.lit("No structural units found."))
    return spans.join(parts, ["project", "path"], "left").select(
        "project", "path", F.lit("file").alias("chunk_type"), F.lit("file").alias("chunk_name"),
        F.concat(F.lit("File Structure: "), summary).alias("skeleton_text"),
        F.lit(1).alias("start_line"), "end_line",
    )


def import_summary(imports: DataFrame) -> DataFrame:
    """One imports row per file from its import lines (project, path, line, text), in order.

    A file's import lines are part of one document, so a group is never larger than a document.
    """
    grouped = imports.groupBy("project", "path").agg(
        F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return grouped.select(
        "project", "path", F.lit("imports").alias("chunk_type"), F.lit("imports").alias("chunk_name"),
        text.alias("skeleton_text"),
    )
