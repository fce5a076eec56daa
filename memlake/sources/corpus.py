"""Scans of document and source trees."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.paths import base_name, has_extension, hidden, in_skipped_dir, relative_to
from memlake.operators.skew import asked_for
from memlake.session import cut_lineage

# What a corpus scan takes, where a source file shows that it is binary, and the usual bound of one.
CORPUS_EXTS = (".md", ".txt", ".json")
BINARY_PROBE = 8192
MAX_SOURCE_BYTES = 3 * 1024 * 1024
#: Tasks of a listing or a scan for each core, unless the bytes ask for more.
TASKS_PER_CORE = 4
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _glob(exts: Sequence[str]) -> str:
    """File name pattern for any of the extensions in any case."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*{" + ",".join(either(e) for e in exts) + "}"


def _listed(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """What ``load`` returns, its folders listed by a few tasks for each core and not by up to 10,000 for each folder."""
    before = spark.conf.get(_LISTING_TASKS, None)
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING_TASKS, str(tasks if before is None else min(tasks, int(before))))
    try:
        return load()
    finally:
        if before is None:
            spark.conf.unset(_LISTING_TASKS)
        else:
            spark.conf.set(_LISTING_TASKS, before)


def _few_tasks(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of a scan of ``files`` in tasks that hold a split's bytes, however many small files these are.

    Spark counts each file as 4 MB, so a task of 16 MB would open four files.
    """
    spark = files.sparkSession
    size = int(str(files._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.coalesce(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-size // split)))


def scan_corpus(
    spark: SparkSession, root: str, exts: Sequence[str] = CORPUS_EXTS, since: str | None = None
) -> DataFrame:
    """Documents below a root: path, content, updated. Hidden directories and backlog files are left out.

    ``since`` (a time as ``yyyy-MM-ddTHH:mm:ss``) takes files changed after it only; the others are not opened.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(exts))
    if since is not None:
        files = files.option("modifiedAfter", since)
    raw = _listed(spark, lambda: files.text(root, wholetext=True))
    rows = raw.select(
        relative_to(F.col("_metadata.file_path"), root).alias("path"),
        F.regexp_replace("value", "^\ufeff", "").alias("content"),
        F.col("_metadata.file_modification_time").alias("updated"),
    )
    return _few_tasks(rows.where(~hidden("path") & ~base_name("path").startswith("backlog_")), raw)


def _binary_files(spark: SparkSession, root: str, exts: Sequence[str], since: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(exts))
    if since is not None:
        # Older files are not even listed for the scan.
        files = files.option("modifiedAfter", since)
    return _listed(spark, lambda: files.load(root))


def _code_files(files: DataFrame, root: str, exts: Sequence[str]) -> DataFrame:
    named = files.withColumn("path", relative_to(F.col("path"), root))
    return named.where(has_extension("path", exts) & ~hidden("path") & ~in_skipped_dir("path"))


def _binary() -> Column:
    head = F.decode(F.substring("content", 1, BINARY_PROBE), "ISO-8859-1")
    return F.contains(head, F.lit("\u0000"))


def scan_code(
    spark: SparkSession, root: str, exts: Sequence[str], max_bytes: int | None = None, since: str | None = None
) -> DataFrame:
    """Source files below a root: path, content, length, updated.

    Binary files are left out and so are, if the caller sets a bound, larger ones, which are not opened at all;
    ``scan_code_rejects`` names them. ``since`` (a time as ``yyyy-MM-ddTHH:mm:ss``) takes files changed after it only.
    """
    files = _binary_files(spark, root, exts, since)
    opened = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    found = _code_files(opened, root, exts).where(~_binary()).select(
        "path", F.decode("content", "UTF-8").alias("content"), "length",
        F.col("modificationTime").alias("updated"),
    )
    return _few_tasks(found, files)


def scan_code_rejects(
    spark: SparkSession, root: str, exts: Sequence[str], max_bytes: int | None = None
) -> DataFrame:
    """The files that ``scan_code`` leaves out: path, length, reason (binary or too large)."""
    files = _binary_files(spark, root, exts)
    opened = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    found = _code_files(opened, root, exts).where(_binary()).select("path", "length", F.lit("binary").alias("reason"))
    found = _few_tasks(found, files)
    if max_bytes is None:
        return found
    large = _code_files(files.where(F.col("length") > max_bytes).drop("content"), root, exts)
    large = large.select("path", "length", F.lit("too large").alias("reason"))
    return found.unionByName(_few_tasks(large, files))


def list_files(spark: SparkSession, root: str, exts: Sequence[str] = CORPUS_EXTS) -> DataFrame:
    """path, length and updated of the files of a scan. None of them is opened."""
    return _listing(_binary_files(spark, root, exts), root, exts)


def _listing(files: DataFrame, root: str, exts: Sequence[str]) -> DataFrame:
    found = _code_files(files.select("path", "length", "modificationTime"), root, exts)
    return _few_tasks(found.select("path", "length", F.col("modificationTime").alias("updated")), files)


def scan_changed(
    spark: SparkSession, root: str, known: DataFrame, exts: Sequence[str] = CORPUS_EXTS
) -> DataFrame:
    """What happened below a root since the scan that ``known`` (path, length, updated) comes from.

    path, state (new, changed or vanished), content, length, updated; a vanished file has its path and state only. A
    file counts as changed if its time or its length is another. Files are compared by a listing that opens none. Of
    the others only those are opened whose time and length lie within the bounds of what is new or changed, which the
    scan gets as pushed filters; files that stayed as they were and lie within them by chance are dropped by their path.
    """
    files = _binary_files(spark, root, exts)
    listing = cut_lineage(_listing(files, root, exts))
    before = known.select("path", F.col("length").alias("_length"), F.col("updated").alias("_updated"), F.lit(True).alias("_known"))
    both = listing.join(before, "path", "full_outer")
    state = (
        F.when(F.col("length").isNull(), "vanished").when(F.col("_known").isNull(), "new")
        .when((F.col("length") != F.col("_length")) | ~F.col("updated").eqNullSafe(F.col("_updated")), "changed")
    )
    moved = cut_lineage(both.withColumn("state", state).where(F.col("state").isNotNull()).select("path", "state", "length", "updated"))
    bounds = moved.where("state <> 'vanished'").agg(
        F.min("updated").alias("a"), F.max("updated").alias("b"), F.min("length").alias("c"), F.max("length").alias("d")).first()
    within = files.where(
        F.col("modificationTime").between(F.lit(bounds["a"]), F.lit(bounds["b"])) & F.col("length").between(bounds["c"], bounds["d"])
    ) if bounds["a"] is not None else files.where(F.lit(False))
    text = _few_tasks(_code_files(within, root, exts).select("path", F.decode("content", "UTF-8").alias("content")), files)
    return moved.join(asked_for(text, moved, ["path"]), "path", "left").select("path", "state", "content", "length", "updated")
