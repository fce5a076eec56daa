"""Best-fit-decreasing packing of indivisible groups into shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.base import narrow, partitions
from memlake.session import cut_lineage

#: Bytes that a document needs besides its text.
OVERHEAD = 8
#: Units that one task packs, about.
UNITS_PER_TASK = 8_192
#: Crates that a level makes for every shard, if one task can hold them all.
CRATES_PER_SHARD = 256
#: A group with a larger share of all rows is looked up by broadcast: there are fewer of them than its inverse.
HEAVY_SHARE = 1 / 4096


class RoomTree:
    """Bins by remaining room in a treap: the tightest that fits an item is found in logarithmic time.

    A node is a bin; nodes are sorted by (room, bin). Priorities are hashed bin numbers, so the shape is
    the same on every run.
    """

    def __init__(self) -> None:
        self.room: list[int] = []
        self.rank: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.root = -1

    def _key(self, node: int) -> tuple[int, int]:
        return self.room[node], node

    def _split(self, node: int, key: tuple[int, int]) -> tuple[int, int]:
        """Parts with keys below ``key`` and the rest."""
        low, high = [], []
        while node >= 0:
            if self._key(node) < key:
                low.append(node)
                node = self.right[node]
            else:
                high.append(node)
                node = self.left[node]
        a = b = -1
        for n in reversed(low):
            self.right[n] = a
            a = n
        for n in reversed(high):
            self.left[n] = b
            b = n
        return a, b

    def _join(self, a: int, b: int) -> int:
        """One tree out of two of which the first has the smaller keys."""
        if a < 0 or b < 0:
            return max(a, b)
        root, trail = -1, None
        while a >= 0 and b >= 0:
            if self.rank[a] > self.rank[b]:
                top, step = a, (self.right, a)
                a = self.right[a]
            else:
                top, step = b, (self.left, b)
                b = self.left[b]
            if trail is None:
                root = top
            else:
                trail[0][trail[1]] = top
            trail = step
        trail[0][trail[1]] = max(a, b)
        return root

    def _insert(self, node: int) -> None:
        self.left[node] = self.right[node] = -1
        a, b = self._split(self.root, self._key(node))
        self.root = self._join(self._join(a, node), b)

    def put(self, size: int, capacity: int) -> int:
        """The bin that takes the item: the tightest with room for it, or a new one."""
        below, fits = self._split(self.root, (size, -1))
        if fits < 0:
            node = len(self.room)
            self.room.append(capacity)
            self.rank.append((node * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 16)
            self.left.append(-1)
            self.right.append(-1)
            self.root = below
        else:
            node = fits
            while self.left[node] >= 0:
                node = self.left[node]
            rest = self._split(fits, (self.room[node], node + 1))[1]
            self.root = self._join(below, rest)
        self.room[node] -= size
        self._insert(node)
        return node


def best_fit_decreasing(sizes: np.ndarray, ties: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item. Items larger than the capacity get bins of their own."""
    bins = np.empty(len(sizes), np.int64)
    tree = RoomTree()
    for i in np.lexsort((ties, -sizes)):
        bins[i] = tree.put(int(sizes[i]), max(capacity, int(sizes[i])))
    return bins


def balanced(sizes: np.ndarray, ties: np.ndarray, shards: int) -> np.ndarray:
    """Best-fit-decreasing into the given number of bins at the least capacity that the search finds."""
    if not len(sizes):
        return np.empty(0, np.int64)
    # Units above an even share have their own bins; the others share the rest.
    down = np.sort(sizes)[::-1]
    own = 0
    while own < min(shards - 1, len(down)) and down[own] * (shards - own) > down[own:].sum():
        own += 1
    low = max(-(-int(down[own:].sum()) // (shards - own)), 1)
    high = max(low, int(sizes.max())) * 2
    best = None
    while low < high or best is None:
        capacity = (low + high) // 2
        bins = best_fit_decreasing(sizes, ties, capacity)
        if bins.max() < shards and np.bincount(bins, weights=sizes).max() <= max(capacity, sizes.max()):
            best, high = bins, capacity
        elif best is None and capacity >= high:
            high *= 2
        else:
            low = capacity + 1
        if high - low <= max(1, low // 10_000) and best is not None:
            break
    return best


def _packed(units: DataFrame, capacity: int, cells: int) -> DataFrame:
    """Pack units (unit, size) inside hashed cells into crates: unit, crate."""
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        order = part.sort_values("unit", kind="stable").reset_index(drop=True)
        bins = best_fit_decreasing(order["size"].to_numpy(), np.arange(len(order)), capacity)
        return pd.DataFrame({"unit": order["unit"], "size": order["size"], "crate": bins * cells + key[0]})

    cell = F.pmod(F.xxhash64("unit", F.lit(7)), F.lit(cells))
    kind = units.schema["unit"].dataType.simpleString()
    return units.groupBy(cell.alias("_cell")).applyInPandas(pack, f"unit {kind}, size long, crate long")


def assign_groups(groups: DataFrame, shards: int, units_per_task: int = UNITS_PER_TASK) -> DataFrame:
    """Shard of every group. ``groups``: distinct ``unit`` with ``size`` above 0; returns unit, shard.

    If one task can hold all groups, best-fit-decreasing packs them into the shards directly, at the least
    capacity that suffices. Otherwise the groups are dealt by hash to tasks that pack them by
    best-fit-decreasing into crates, each a small part of a shard; the crates are the units of the next
    level, until one task can hold them. A group larger than a crate is a crate. Sizes, not data, decide
    the number of levels: each divides the units by the number that a crate holds.
    """
    base = cut_lineage(groups.select("unit", "size"))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).first()
    level, n, chain = base, total["n"], []
    while n > units_per_task:
        cells = -(-n // units_per_task)
        # As many crates as leave the next level a tenth of the units, but enough to fill the shards evenly.
        fine = max(min(shards * CRATES_PER_SHARD, units_per_task // 2), 2 * shards, 2 * cells)
        crates = max(n // 10 if n > 10 * units_per_task else 0, fine)
        packed = cut_lineage(_packed(level, max(1, -(-(total["s"] or 0) // crates)), cells))
        chain.append(packed.select("unit", "crate"))
        level = packed.groupBy(F.col("crate").alias("unit")).agg(F.sum("size").alias("size"))
        fewer = level.count()
        if fewer >= n:
            break
        n = fewer

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        order = part.sort_values("unit", kind="stable").reset_index(drop=True)
        bins = balanced(order["size"].to_numpy(), np.arange(len(order)), shards)
        return pd.DataFrame({"unit": order["unit"], "shard": bins.astype(np.int32)})

    kind = level.schema["unit"].dataType.simpleString()
    placed = level.groupBy().applyInPandas(finish, f"unit {kind}, shard int")
    for packed in reversed(chain):
        found = placed.withColumnRenamed("unit", "crate")
        placed = packed.join(found, "crate").select("unit", "shard")
    return placed


def shard(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text",
          units_per_task: int = UNITS_PER_TASK) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes; rows of equal text stay together.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, shard and slot (gapless from 0 in each shard), one
    row per input row. A group is all rows of one text, known by its SHA-256. Groups are never split, so a
    group larger than an even share makes its shard larger, and the others share the rest evenly.

    Only ids, sizes and digests are shuffled. Few groups can hold a large share of the rows; they are found
    by their counts and looked up by broadcast, so no task gets their rows. Slots are numbered inside cells
    of hashed ids, after the rows of the cells before.

    Null texts are one group of size 8 without a checksum, empty texts one of their own. Null ids and
    repeated rows each keep their row and slot. Empty tables give no rows; other columns are ignored.
    """
    rows = narrow(docs, doc_id=id, _text=text).select(
        "doc_id",
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("_text", 256)), F.lit(b"")).alias("unit"),
    )
    rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("_rows")))
    placed = cut_lineage(
        assign_groups(groups, shards, units_per_task).join(groups.select("unit", "_rows"), "unit")
    )
    n = rows.count()
    heavy = F.col("_rows") > n * HEAVY_SHARE
    hot = F.broadcast(placed.where(heavy).select("unit", "shard"))
    light = placed.where(~heavy).select("unit", "shard")
    cold_rows = rows.join(hot.select("unit"), "unit", "left_anti")
    found = rows.join(hot, "unit").union(cold_rows.join(light, "unit")).drop("unit")
    cells = max(64, 4 * partitions(docs))
    spread = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)).cast("int")
    found = cut_lineage(found.withColumn("_cell", spread))
    earlier = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        found.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy("shard", "_cell").orderBy("doc_id", "size", "text_crc32")
    return (
        found.withColumn("_at", F.row_number().over(inside)).join(starts, ["shard", "_cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_at") - 1).alias("slot"))
    )
