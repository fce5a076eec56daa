"""Hard negatives of anchors by exact integer scores.

Scores are inner products of integer vectors. Each is computed modulo a few primes below 2^10 by float32 matrix
products, which are exact because no sum passes 2^24, and put together again by mixed-radix digits around zero.
The first pass finds each anchor's best rows of its own label, the second the rows of other labels whose scores lie in
a window below each of those. Tasks hand on only the best rows of each window.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.base import narrow
from memlake.operators.skew import top_k_per_key
from memlake.session import cut_lineage

#: Float32 holds every integer up to this one.
EXACT = 1 << 24
#: Bytes of anchors that go to the tasks at once, one scan of the rows for each such block.
BLOCK_BYTES = 16 << 20
#: Scores that are in memory at once, and anchors that they belong to at most.
CELLS = 1 << 20
ANCHORS = 1 << 10
#: Hits that a task holds before it keeps the best only.
HELD = 1 << 20
#: Components that are multiplied before the residues are taken anew.
WIDTH = 64
#: Sorts after all ids: rows without an id come last among equals.
NO_ID = (1 << 63) - 1


def _primes_below(top: int) -> Iterator[int]:
    return (n for n in range(top, 2, -1) if all(n % d for d in range(2, math.isqrt(n) + 1)))


def moduli(bound: int) -> list[int]:
    """Primes whose residues tell all integers from -bound to bound apart; float32 sums of ``WIDTH`` products fit."""
    found, product = [], 1
    for prime in _primes_below(2 * math.isqrt((EXACT - 1) // WIDTH) + 1):
        if product > 2 * bound:
            break
        found.append(prime)
        product *= prime
    return found


def _balanced(x: np.ndarray, prime: int) -> np.ndarray:
    """Residues from -(prime - 1) / 2 to (prime - 1) / 2, of whole numbers in float64."""
    return x - prime * np.rint(x / prime)


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Whole numbers below 2^53 as one float32 matrix for each prime."""
    vectors = vectors.astype(np.float64)
    return [_balanced(vectors, p).astype(np.float32) for p in primes]


def _product(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """Balanced residues of a @ b.T."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], WIDTH):
        total += _balanced((a[:, at : at + WIDTH] @ b[:, at : at + WIDTH].T).astype(np.float64), prime)
    return _balanced(total, prime)


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of two residue systems, as long integers."""
    value = np.zeros((len(a[0]), len(b[0])), np.int64)
    digits: list[np.ndarray] = []
    for k, prime in enumerate(primes):
        rest, weight = _product(a[k], b[k], prime), 1
        # Take off what the digits before account for, and divide by their weight modulo this prime.
        for digit, earlier in zip(digits, primes):
            rest = _balanced(rest - digit * (weight % prime), prime)
            weight *= earlier
        digits.append(_balanced(rest * pow(weight, -1, prime), prime))
        # Wraps around on the way at most; the sum itself fits.
        value += digits[-1].astype(np.int64) * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))
    return value


@dataclass
class Anchors:
    """A block of anchors. ``windows``: per anchor and place the number, id and score of its positives, or None."""

    ids: np.ndarray
    labels: np.ndarray
    residues: list[np.ndarray]
    positives: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


@dataclass
class _Best:
    """The best ``keep`` hits of each key: parallel arrays of key, score and id."""

    keep: int
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    held: int = 0

    def add(self, key: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        self.parts.append((key, score, id))
        self.held += len(key)
        if self.held > HELD:
            self.parts = [self.kept()]
            # What is kept is bounded by the block of anchors; the next clean-up waits for as much again.
            self.held = 0

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, score, id = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.lexsort((id, -score, key))
        key, score, id = key[order], score[order], id[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        among = np.arange(len(key)) - start < self.keep
        return key[among], score[among], id[among]


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as a matrix; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _same_label(
    found: _Best, block: Anchors, mine: list[np.ndarray], ids: np.ndarray, labels: np.ndarray, primes: list[int],
) -> None:
    """Other rows of each anchor's label; only these are multiplied."""
    order = np.argsort(labels, kind="stable")
    for label in np.intersect1d(labels, block.labels):
        cols = order[slice(*np.searchsorted(labels[order], [label, label + 1]))]
        every = np.flatnonzero(block.labels == label)
        for at in range(0, len(every), ANCHORS):
            rows = every[at : at + ANCHORS]
            value = scores([r[rows] for r in block.residues], [r[cols] for r in mine], primes)
            row, col = np.nonzero(block.ids[rows, None] != ids[None, cols])
            found.add(rows[row], value[row, col], ids[cols[col]])


def _in_windows(
    found: _Best, block: Anchors, at: slice, value: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: int, high: int,
) -> None:
    """Rows of other labels with low * positive <= 100 * score <= high * positive, for each positive by itself."""
    anchor, _, score = block.positives
    first, last = np.searchsorted(anchor, [at.start, at.stop])
    for place in range(first, last):
        row = anchor[place] - at.start
        # floor and ceil of Python integers are exact at any size.
        least, most = -(-low * int(score[place]) // 100), high * int(score[place]) // 100
        if least <= most:
            hit = np.flatnonzero(
                (value[row] >= least) & (value[row] <= most) & (labels != block.labels[anchor[place]]))
            if len(hit):
                found.add(np.full(len(hit), place, np.int64), value[row, hit], ids[hit])


def _scan(rows: DataFrame, block: Anchors, primes: list[int], width: int, keep: int, bounds: tuple[int, int] | None):
    """key, score, id: the best rows of each anchor of the block, or of each positive's window."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = shared.value, _Best(keep)
        step = max(1, CELLS // min(len(block.ids), ANCHORS))
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                mine = residues(vectors_of(part.column("vector"), width), primes)
                if bounds is None:
                    _same_label(found, block, mine, ids, labels, primes)
                    continue
                for start in range(0, len(block.ids), ANCHORS):
                    at = slice(start, min(start + ANCHORS, len(block.ids)))
                    value = scores([r[at] for r in block.residues], mine, primes)
                    _in_windows(found, block, at, value, ids, labels, *bounds)
        if found.parts:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found.kept()], names=["key", "score", "id"])

    return rows.mapInArrow(run, "key long, score long, id long")


def usable(df: DataFrame, id: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """id, label, vector (floor of ``scale`` times each component) of all rows that take part."""
    rows = narrow(df, id=id, label=label, vector=vector)
    whole = F.transform("vector", lambda x: x.cast("double"))
    # Not a number, infinite and null components all fail the comparison.
    finite = F.forall("vector", lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    rows = rows.withColumn("vector", whole).where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    scaled = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("label").cast("long"), scaled.alias("vector"))


def _blocks(anchors: DataFrame, width: int) -> list[DataFrame]:
    """Different anchors, with the number of their copies, in blocks of about ``BLOCK_BYTES`` by a hash of their rows."""
    anchors = cut_lineage(anchors.groupBy("id", "label", "vector").agg(F.count(F.lit(1)).cast("int").alias("copies")))
    # Half full on average, so that chance does not fill a block over its bound.
    blocks = -(-anchors.count() * (8 * width + 32) * 2 // BLOCK_BYTES)
    share = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks))
    return [anchors.where(share == k) for k in range(blocks)]


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, vector of longs).

    An anchor's positives are its best ``positives`` other rows of the same label; each positive's negatives are the
    best ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Higher scores come first, then smaller ids.

    Anchors go to the tasks that scan the rows in blocks of at most ``BLOCK_BYTES``, two scans for each block: rows are
    neither copied nor shuffled, and a task hands on ``negatives`` rows per window. What computes ``rows`` runs again in
    each scan. A positive without a fitting negative gives no row. Shorter vectors count as ending in zeros. Rows that repeat an id are rows of their own, but
    never partners of the anchors of that id. Rows without an id are ordered last, come back with a null id and are
    partners only; labels of any value are allowed. No anchors, or an empty table: no rows.
    """
    extent = rows.agg(
        F.max(F.size("vector")).alias("width"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("most"),
    ).first()
    width, most = max(extent["width"] or 0, 1), extent["most"] or 0
    bound = width * most * most
    if bound >= NO_ID // 2:
        raise ValueError(f"components up to {most} in {width} columns have scores beyond 64 bits")
    primes = moduli(bound)
    found = [
        _mined(rows, part, primes, width, positives, negatives, (low, high))
        for part in _blocks(rows.where(is_anchor & (F.col("id") != NO_ID)), width)
    ]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = [f for f in found if f is not None]
    return functools.reduce(DataFrame.unionAll, found) if found else rows.sparkSession.createDataFrame([], schema)


def _mined(rows, part, primes, width, positives, negatives, bounds) -> DataFrame | None:
    """Rows of one block of anchors."""
    table = part.toArrow().combine_chunks()
    if not table.num_rows:
        return None
    spark = rows.sparkSession
    matrix = vectors_of(table.column("vector").combine_chunks(), width)
    block = Anchors(table.column("id").to_numpy(), table.column("label").to_numpy(), residues(matrix, primes))
    order = [F.desc("score"), "id"]
    near = _scan(rows, block, primes, width, positives, None)
    # At most ``positives`` rows for each anchor of the block.
    best = top_k_per_key(near, ["key"], order, positives, "place").orderBy("key", "place").toArrow()
    if not best.num_rows:
        return None
    key, id, score = (best.column(c).to_numpy() for c in ("key", "id", "score"))
    block.positives = (key, id, score)
    hits = top_k_per_key(_scan(rows, block, primes, width, negatives, bounds), ["key"], order, negatives)
    places = pa.table({
        "key": np.arange(len(key)), "anchor_id": block.ids[key], "positive_id": id, "positive_score": score,
        "copies": table.column("copies").to_numpy()[key],
    })
    named = F.broadcast(spark.createDataFrame(places))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return hits.join(named, "key").withColumn("copy", each).select(
        "anchor_id", shown("positive_id").alias("positive_id"), "rank", shown("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
