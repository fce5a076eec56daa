"""Joins, ranks and look-backs that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.exprs import let
from memlake.session import cut_lineage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
#: Rows of the left side that one task of a sized join sorts.
TASK_ROWS = 500_000


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure whether a side is small enough to send to every executor.

    Reads no more than ``max_rows`` + 1 rows.
    """
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long")
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """A broadcast hint after measuring; beyond the bound the join shuffles as usual."""
    return F.broadcast(df) if fits_broadcast(df, **limits) else df


def asked_for(df: DataFrame, requests: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key some request names, before a join that would shuffle them all.

    The distinct keys are measured and sent to the rows, so large values that nobody asks for stay where
    they are. Beyond the bound the rows come back as they are, for the join to sort out.
    """
    wanted = requests.select(*on).distinct()
    return df.join(F.broadcast(wanted), list(on), "left_semi") if fits_broadcast(wanted) else df


def hot_keys(df: DataFrame, on: Sequence[str], parts: int | None = None) -> DataFrame:
    """Keys with more rows than an even share of a partition, and _n, the number of shares they fill.

    Fewer than ``parts`` keys can have that many rows. Counts are combined on the map side before they are
    shuffled.
    """
    parts = parts or _parts(df)
    counts = df.groupBy(*on).count()
    share = counts.agg(F.greatest(F.sum("count") / parts, F.lit(1.0)).alias("s")).scalar()
    return counts.where(F.col("count") > share).select(*on, F.ceil(F.col("count") / share).cast("int").alias("_n"))


def hot_keys_by_buckets(df: DataFrame, on: Sequence[str], parts: int | None = None) -> tuple[int, DataFrame | None]:
    """The number of rows, and what ``hot_keys`` finds, or None if there is no such key. Runs at once.

    Rows are counted by bucket of hashed keys first, 64 buckets a partition however many keys there are. A key with more
    than a share lies in a bucket with more than a share; only the keys of such buckets are counted one by one.
    """
    parts = parts or _parts(df)
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on]), F.lit(64 * parts)).cast("int")
    sizes = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in sizes)
    share = max(total / parts, 1.0)
    heavy = [r["_b"] for r in sizes if r["n"] > share]
    if not heavy:
        return total, None
    counts = df.where(bucket.isin(heavy)).groupBy(*on).count().where(F.col("count") > share)
    hot = cut_lineage(counts.select(*on, F.ceil(F.col("count") / F.lit(share)).cast("int").alias("_n")))
    return total, hot if hot.head(1) else None


def dealt_by_rows(df: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """``df`` in as many partitions as ``rows`` rows need, where the session's number of them gives a task too many."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *on) if parts > _parts(df) else df


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    salts: int = SALTS,
    find_hot: bool = True,
    sized: bool = False,
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    A key with more than a partition's share of the left rows is spread over as many tasks as it fills
    shares, by a hash of ``spread``; only the matching right rows are copied that often. Left rows with a
    null key match nothing and are spread as well. ``how`` must keep left rows at most: inner, left,
    left_semi or left_anti.

    Finding the heavy keys reads the left side once more, so a left side that is dear to compute is
    written first (``cut_lineage``). Where the right side is small, ``find_hot`` off spreads all keys over
    ``salts`` tasks without looking.

    ``sized`` is for a left side that may have many more rows than the session's partitions hold well: its heavy keys are
    found by buckets, at once, and the join has a partition for every ``TASK_ROWS`` rows, so that neither the counts nor
    the sorts of a task grow with the table.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do a {how} join")
    on = list(on)
    spread = list(spread or left.columns)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in spread])
    if not find_hot:
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        copied = right.withColumn("_salt", F.explode(every))
        salt = F.pmod(hashed, F.lit(salts)).cast("int")
        return left.withColumn("_salt", salt).join(copied, [*on, "_salt"], how).drop("_salt")
    rows, found = hot_keys_by_buckets(left, on) if sized else (0, hot_keys(left, on))
    if found is None:
        # No key is split; the sides meet as they are.
        return dealt_by_rows(left, on, rows).join(dealt_by_rows(right, on, rows), on, how)
    hot = F.broadcast(found)
    lost = F.lit(False)
    for c in on:
        lost |= F.col(f"`{c}`").isNull()
    shares = F.when(lost, F.lit(_parts(left))).otherwise(F.coalesce("_n", F.lit(1)))
    spread_left = left.join(hot, on, "left").withColumn("_salt", F.pmod(hashed, shares).cast("int")).drop("_n")
    copies = F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)
    copied_right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_n")
    salted = [*on, "_salt"]
    return dealt_by_rows(spread_left, salted, rows).join(dealt_by_rows(copied_right, salted, rows), salted, how).drop("_salt")


def _splits(df: DataFrame, value: Column, parts: int, step: int) -> Column:
    """Cut points that share out the rows evenly, all of them and every ``step``-th, as a sub-query."""
    points = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(value, points, 10_000).alias("s"))
    coarse = F.filter("s", lambda _, i: i % step == 0)
    return cuts.select(F.struct(F.col("s").alias("fine"), coarse.alias("coarse")).alias("c")).scalar()


def _parts(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _as_number(df: DataFrame, split_on: str) -> Column:
    kind = dict(df.dtypes)[split_on]
    value = F.col(split_on)
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp"))
    return value.cast("double") if kind in ("float", "double") else value.cast("long")


def bucketed(df: DataFrame, split_on: str, descending: bool = False, parts: int | None = None) -> DataFrame:
    """Add ``_bucket``: an even share of all rows by ``split_on``, numbered in sort order.

    A row finds its share in two steps, so thousands of shares cost it little.
    """
    value = _as_number(df, split_on)
    parts = parts or _parts(df)
    step = max(1, math.isqrt(parts))
    cut = df.withColumn("_cuts", _splits(df, value, parts, step))
    fine, coarse = F.col("_cuts")["fine"], F.col("_cuts")["coarse"]

    def within(k):
        first = (k - 1) * step
        near = F.filter(F.slice(fine, first + 1, F.lit(step)), lambda s: s < value)
        return F.when(k > 0, first + F.size(near)).otherwise(F.lit(0))

    below = F.coalesce(let(F.size(F.filter(coarse, lambda s: s < value)), within), F.lit(0))
    return cut.withColumn("_bucket", -below if descending else below).drop("_cuts")


_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_EXACT = {"timestampFormat": _MICROS, "timestampNTZFormat": _MICROS}


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Sequence[str], parts: int | None):
    """All rows in order of keys and ``order``, dealt out by ranges and written once, and the ends of the ranges.

    Adds _local (number within its key and range, from 1), _head (the row is in the first key of its range), _part and
    _prev (the ``values`` of the row before within key and range). Rows that are equal in all of that are spread too:
    no range holds much more than its share, whatever is repeated.

    The ends are a row for each range, in order: the values of its last row, how many rows of the last key it has, and
    whether that key is its only one.
    """
    spark, keys = df.sparkSession, list(keys)
    key = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), _EXACT) if keys else F.lit("")
    packed = F.struct(*values) if values else F.struct(F.lit(None).cast("int").alias("none"))
    marked = df.withColumns({"_key": key, "_spread": F.monotonically_increasing_id(), "_values": packed})
    sort = [*keys, *order, "_spread"]
    ranged = marked.repartitionByRange(parts or _parts(df), *sort).sortWithinPartitions(*sort).drop("_spread")
    added = [
        T.StructField("_local", T.LongType()), T.StructField("_head", T.BooleanType()), T.StructField("_part", T.IntegerType()),
        T.StructField("_prev", marked.schema["_values"].dataType), T.StructField("_at", T.LongType()),
    ]
    written = cut_lineage(ranged.mapInArrow(_numbered, T.StructType([*ranged.schema.fields, *added])))
    last = F.max_by(F.struct("_key", "_local", "_head", "_values"), "_at").alias("e")
    first = F.min_by("_key", "_at").alias("first")
    ends = written.groupBy("_part").agg(last, first).select("_part", "first", "e.*")
    return written, ends


def _numbered(batches):
    """Add _local, _head, _part, _prev and _at to rows in order; a row is compared with the one before only."""
    part, at, run, head, last = TaskContext.get().partitionId(), 0, 0, True, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, values = batch.column("_key"), batch.column("_values")
        changed = np.ones(n, bool)
        changed[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        changed[0] = last is None or keys[0].as_py() != last[0]
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(changed, place, -1))
        local = np.where(start < 0, run + place + 1, place - start + 1)
        later = np.cumsum(changed) + (0 if head else 1) - (1 if at == 0 else 0) > 0
        # The last row of the batch before stands ahead of the first one of this.
        before = pa.concat_arrays([last[1] if last is not None else values[:1], values])
        prev = before.take(pa.array(place, mask=changed))
        extra = [pa.array(local), pa.array(~later), pa.array(np.full(n, part, np.int32)), prev, pa.array(at + place)]
        names = ["_local", "_head", "_part", "_prev", "_at"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])
        at, run, head, last = at + n, int(local[-1]), not later[-1], (keys[n - 1].as_py(), values[n - 1 : n])


def _carried(ends: DataFrame) -> dict[int, tuple[int, int]]:
    """For every range whose first key goes on from before: rows of that key before it, and the range they end in.

    There is one row for each range, so they are few.
    """
    carried, before = {}, None
    for end in ends.select("_part", "first", "_key", "_local", "_head").orderBy("_part").collect():
        goes_on = before is not None and end["first"] == before[0]
        if goes_on:
            carried[end["_part"]] = (before[1], before[2])
        rows = end["_local"] + (before[1] if goes_on and end["_head"] else 0)
        before = (end["_key"], rows, end["_part"])
    return carried


def _first_of_ranges(written: DataFrame, carried: dict[int, tuple[int, int]]) -> DataFrame:
    rows = [(part, n, origin) for part, (n, origin) in carried.items()]
    found = written.sparkSession.createDataFrame(rows, "_part int, _before long, _origin int")
    return written.join(F.broadcast(found), "_part", "left")


def split_rank(
    df: DataFrame,
    keys: Sequence[str],
    split_on: str,
    ties: Sequence[Column | str] = (),
    descending: bool = False,
    name: str = "rank",
    parts: int | None = None,
) -> DataFrame:
    """``row_number`` over (keys, split_on, ties) without sending a whole key to one task.

    Rows are dealt out by ranges of (keys, split_on, ties) and numbered there; what a key had in the ranges before is
    added. With no keys this numbers the whole table. Any number of rows may be equal in all of it.
    """
    order = [F.desc(split_on) if descending else F.asc(split_on), *ties]
    written, ends = _in_order(df, keys, order, [], parts)
    more = F.when(F.col("_head"), F.coalesce("_before", F.lit(0))).otherwise(F.lit(0))
    return _first_of_ranges(written, _carried(ends)).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_local") + more).alias(name))


def split_lag(
    df: DataFrame,
    keys: Sequence[str],
    split_on: str,
    values: Sequence[str],
    ties: Sequence[str] = (),
    prefix: str = "prev_",
    parts: int | None = None,
) -> DataFrame:
    """``lag(value, 1)`` over (keys, split_on, ties) without sending a whole key to one task.

    The first row of a range takes the last row of the range before, if that has its key.
    """
    written, ends = _in_order(df, keys, [F.asc(split_on), *ties], list(values), parts)
    found = _first_of_ranges(written, _carried(ends))
    tails = ends.select(F.col("_part").alias("_origin"), F.col("_values").alias("_tail"))
    joined = found.join(F.broadcast(tails), "_origin", "left")
    opens = F.col("_head") & (F.col("_local") == 1) & F.col("_before").isNotNull()
    prev = F.when(opens, F.col("_tail")).otherwise(F.col("_prev"))
    return joined.withColumn("_prev", prev).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col("_prev")[v].alias(prefix + v) for v in values])


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                  name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key in a total order.

    Catalyst limits each partition to ``k`` rows per key before the shuffle.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)
