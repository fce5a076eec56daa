"""Registry of the subpackage's queries and small helpers its operators share."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.catalog.base import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the tables of a folder, with equivalent SQL where there is any."""
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_key(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash with them."""
    return df.select(*[as_key(c).alias(k) for k, c in columns.items()])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def no_items(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def packed(df: DataFrame) -> DataFrame:
    """All columns in one, ``row``, so that no name of theirs meets a name of the operator."""
    return df.select(F.struct(*[as_key(c).alias(c) for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select([F.col("row").getField(c).alias(c) for c in like.columns])


def field(name: str) -> Column:
    return F.col("row").getField(name)
