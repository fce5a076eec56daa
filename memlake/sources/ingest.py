"""Ingest of embedded code chunks delivered as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.paths import is_test

# Version of the delivery format and the kinds of code unit.
SCHEMA_VERSION = "1.0"
CHUNK_TYPES = ("file", "imports", "namespace", "class", "method", "property")

PAYLOAD = (
    "schema_version string, project_name string, path string, file_summary string, chunks array<struct<"
    "type:string, name:string, skeleton_text:string, vector:array<float>, line_start:int, line_end:int>>"
)


def ingest_chunks(
    deliveries: DataFrame, dim: int, now: Column, payload: str = "payload"
) -> tuple[DataFrame, DataFrame]:
    """(code units, rejects) from JSON deliveries.

    A delivery with a wrong version, an unreadable body or no chunks is rejected whole; so is one
    with a vector of the wrong width. A chunk that breaks the contract is dropped and the others stay.
    """
    parsed = deliveries.withColumn("_p", F.from_json(payload, PAYLOAD))
    chunks = F.col("_p")["chunks"]
    incomplete = F.exists(
        chunks, lambda c: c["vector"].isNull() | (F.size(c["vector"]) != F.lit(dim))
    )
    reason = (
        F.when(F.col("_p").isNull() | F.col("_p")["path"].isNull(), "unreadable payload")
        .when(~F.col("_p")["schema_version"].eqNullSafe(F.lit(SCHEMA_VERSION)), "schema_version_mismatch")
        .when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, "chunks list must not be empty")
        .when(incomplete, F.lit(f"vector must have {dim} dimensions"))
    )
    judged = parsed.withColumn("reason", reason)
    delivery = [c for c in deliveries.columns if c != payload]
    rejected = judged.where(F.col("reason").isNotNull()).select(
        *delivery, F.col("_p")["path"].alias("path"), F.lit(None).cast("int").alias("position"), "reason"
    )
    rows = judged.where(F.col("reason").isNull()).select(
        *delivery, F.col("_p")["project_name"].alias("project"), F.col("_p")["path"].alias("path"),
        F.posexplode(chunks).alias("position", "c"),
    )
    fault = (
        F.when(~F.coalesce(F.col("c")["type"].isin(*CHUNK_TYPES), F.lit(False)), "malformed chunk: type")
        .when(F.coalesce(F.col("c")["name"], F.lit("")) == "", "malformed chunk: name")
        .when(F.col("c")["skeleton_text"].isNull(), "malformed chunk: skeleton_text")
        .when(F.col("c")["line_start"].isNull() | F.col("c")["line_end"].isNull(), "malformed chunk: lines")
    )
    checked = rows.withColumn("reason", fault)
    units = checked.where(F.col("reason").isNull()).select(
        *delivery, "project", "path", "position",
        F.col("c")["type"].alias("chunk_type"), F.col("c")["name"].alias("chunk_name"),
        F.col("c")["skeleton_text"].alias("skeleton_text"),
        F.col("c")["line_start"].alias("start_line"), F.col("c")["line_end"].alias("end_line"),
        is_test("path").alias("is_test"), now.alias("updated"), F.col("c")["vector"].alias("vector"),
    )
    dropped = checked.where(F.col("reason").isNotNull()).select(*delivery, "path", "position", "reason")
    return units, rejected.unionByName(dropped)
