"""Near-duplicates: MinHash bands find candidates, odd sketches sift them, full shingle sets confirm them."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.base import field, narrow, packed, unpacked
from memlake.llm.tokens import mix, shingles, words_of
from memlake.operators.skew import broadcast_if_small
from memlake.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.85
ROWS = 5
#: A pair at the threshold shares none of the bands with this chance at most.
MISSED = 1e-6
SKETCH_BITS = 512
#: A pair goes to the full comparison if its estimate is within this many deviations of the threshold.
DEVIATIONS = 5.5
#: Shingles of an open bucket that one block holds.
BLOCK_ITEMS = 1 << 20
#: Partners of one representative that one task compares.
STAR = 512
MAX_ROUNDS = 100

_WORDS = SKETCH_BITS // 64


def bands_for(threshold: float) -> int:
    """Bands that a pair at the threshold needs: it shares one with the chance threshold ** ROWS."""
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min(threshold, 1 - 1e-9) ** ROWS))))


#: 24 bands, 7.7e-7.
BANDS = bands_for(THRESHOLD)
#: Samples in an odd sketch, the same for every threshold.
_SAMPLES = BANDS * ROWS


@functools.cache
def _hash_family(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(85)
    return rng.integers(1, 1 << 32, samples, dtype=np.uint32) | np.uint32(1), rng.integers(
        0, 1 << 32, samples, dtype=np.uint32)


def minhash(items: np.ndarray, samples: int = _SAMPLES) -> np.ndarray:
    """The smallest hashed item under each function of the family.

    A multiplication and a shift of the folded hash stand for a random order.
    """
    a, b = _hash_family(samples)
    low, high = (items & np.uint64(0xFFFFFFFF)).astype(np.uint32), (items >> np.uint64(32)).astype(np.uint32)
    best = np.full(samples, 0xFFFFFFFF, np.uint32)
    step = max(1, 65_536 // samples)
    for at in range(0, len(items), step):
        h = low[at : at + step, None] * a
        h ^= h >> np.uint32(15)
        h += high[at : at + step, None]
        h *= b | np.uint32(1)
        h ^= h >> np.uint32(16)
        np.minimum(best, h.min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the first samples: each flips the bit that it and its place are hashed to."""
    place = np.arange(_SAMPLES, dtype=np.uint64) << np.uint64(32)
    bits = mix(samples[:_SAMPLES].astype(np.uint64) | place) % np.uint64(SKETCH_BITS)
    flips = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(len(samples) // ROWS, dtype=np.uint64) + np.uint64(1)
    for column in samples.reshape(-1, ROWS).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return key


def _cut(threshold: float) -> int:
    """The largest count of differing sketch bits that a linked pair may show.

    At the threshold the samples differ in 1 - J of their places on average, each puts two items into the
    symmetric difference, and a bit of it is odd with chance (1 - exp(-2 d / bits)) / 2. Both steps scatter.
    """
    differ = _SAMPLES * (1 - threshold)
    fade = np.exp(-4 * differ / SKETCH_BITS)
    odd = SKETCH_BITS * (1 - fade) / 2
    spread = np.sqrt((2 * fade) ** 2 * _SAMPLES * threshold * (1 - threshold) + odd / 2)
    return int(odd + DEVIATIONS * spread) + 1


def estimate(different_bits: Column) -> Column:
    """Similarity that the odd sketches of two sets suggest."""
    share = F.least(F.lit(2.0) * different_bits / F.lit(SKETCH_BITS), F.lit(1 - 1e-9))
    return F.greatest(F.lit(0.0), F.lit(1.0) + F.log(F.lit(1.0) - share) * F.lit(SKETCH_BITS / (4 * _SAMPLES)))


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for words in words_of(texts):
        for row, some in words.rows():
            yield row, np.unique(shingles(some, SHINGLE))


_SKETCHED = "doc_id long, n_shingles long, a long, b long, bands array<long>, sketch array<long>"


def _sketched(threshold: float):
    """Size, 128-bit digest, band keys and odd sketch of every document's shingle set."""
    # A sketch takes as many samples as the bands of the default threshold have.
    n_bands = bands_for(threshold)
    samples_each = max(n_bands * ROWS, _SAMPLES)

    def sketch_of(batches):
        for batch in batches:
            n, a, b, bands, sketch = [], [], [], [], []
            for _, items in _sets(batch.column("text")):
                n.append(len(items))
                a.append(np.add.reduce(items, dtype=np.uint64))
                b.append(np.add.reduce(mix(items ^ np.uint64(0xD1B54A32D192ED03)), dtype=np.uint64))
                samples = minhash(items, samples_each) if len(items) else None
                bands.append(np.empty(0, np.int64) if samples is None else band_keys(samples[: n_bands * ROWS]).view(np.int64))
                sketch.append(np.empty(0, np.int64) if samples is None else odd_sketch(samples).view(np.int64))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(n, pa.int64()),
                pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)),
                pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "a", "b", "bands", "sketch"])

    return sketch_of


def _full_sets(batches):
    """The sets whose digest begins as asked: another row of the same id may hold another text."""
    for batch in batches:
        asked = batch.column("a").to_numpy(zero_copy_only=False).view(np.uint64)
        rep, items = [], []
        for row, some in _sets(batch.column("text")):
            if np.add.reduce(some, dtype=np.uint64) == asked[row]:
                rep.append(batch.column("rep")[row])
                items.append(some.tobytes())
        yield pa.record_batch(
            [pa.array(rep, pa.int64()), pa.array(items, pa.binary())], names=["rep", "items"])


def connect(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v): node, comp, for every node with a link.

    Every node moves to its smallest neighbour and the links move along, until none are left. The order of
    the nodes changes with each round, so chains shrink by a constant factor on average, and a star goes at
    once when its centre is smallest, as in the first round. Nothing is held per node but one number.
    """
    edges = cut_lineage(links.select("u", "v").where("u <> v").distinct())
    moves: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        order = F.col("v") if turn == 0 else F.xxhash64("v", F.lit(turn))
        own = F.col("u") if turn == 0 else F.xxhash64("u", F.lit(turn))
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        near = both.groupBy("u").agg(F.min(F.struct(order.alias("k"), F.col("v").alias("to"))).alias("_m"))
        move = cut_lineage(near.select(
            F.col("u").alias("node"),
            F.when(F.col("_m")["k"] < own, F.col("_m")["to"]).otherwise(F.col("u")).alias("to"),
        ))
        moves.append(move)
        at = lambda c: move.select(F.col("node").alias(c), F.col("to").alias(c + "2"))
        moved = edges.join(at("u"), "u").join(at("v"), "v").select(
            F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
        edges = cut_lineage(moved.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components still open after {MAX_ROUNDS} rounds")
    if not moves:
        return links.select(F.col("u").alias("node"), F.col("u").alias("comp")).limit(0)
    ends = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        ends = ends.join(step, "to", "left").select("node", F.coalesce("_next", "to").alias("to"))
    ends = cut_lineage(ends)
    least = ends.groupBy("to").agg(F.min("node").alias("comp"))
    return cut_lineage(ends.join(least, "to").select("node", "comp"))


def _differing(left: str, right: str) -> Column:
    bits = [F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(_WORDS)]
    return functools.reduce(lambda x, y: x + y, bits)


def _similar_sizes(n: Column, m: Column, threshold: float) -> Column:
    return F.least(n, m) >= F.lit(threshold - 1e-9) * F.greatest(n, m)


def _sifted(pairs: DataFrame, sides: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose sizes and sketches allow a link."""
    side = lambda c: sides.select(
        F.col("rep").alias(c), F.col("n_shingles").alias("_n" + c), F.col("sketch").alias("_s" + c))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    near = _similar_sizes(F.col("_nu"), F.col("_nv"), threshold) & (_differing("_su", "_sv") <= _cut(threshold))
    return both.where(near).select("u", "v")


def _intersections(batches):
    for batch in batches:
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        both = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            for x, y in zip(left, right, strict=True)
        ]
        sizes = [(len(x) // 8 + len(y) // 8) for x, y in zip(left, right, strict=True)]
        yield pa.record_batch(
            [batch.column("u"), batch.column("v"), pa.array(both, pa.int64()), pa.array(sizes, pa.int64())],
            names=["u", "v", "both", "sizes"])


def _sets_of(wanted: DataFrame, sides: DataFrame, texts: DataFrame) -> DataFrame:
    """Full shingle sets of the wanted representatives only: rep, items (sorted 64-bit hashes as bytes)."""
    wanted = cut_lineage(wanted.join(sides.select("rep", "a"), "rep"))
    picked = texts.join(broadcast_if_small(wanted), "rep").select("rep", "text", "a")
    return cut_lineage(picked.mapInArrow(_full_sets, "rep long, items binary").dropDuplicates(["rep"]))


def _confirmed(pairs: DataFrame, sides: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets are similar enough. ``texts``: rep and text.

    Only the sets of documents in a pair are made. A document in many pairs is copied once for every few
    hundred of them, so its pairs are compared by many tasks.
    """
    pairs = cut_lineage(pairs)
    sets = _sets_of(pairs.select(F.col("u").alias("rep")).union(pairs.select("v")).distinct(), sides, texts)
    copies = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("_copies"))
    part = F.pmod(F.xxhash64("v"), F.col("_copies")).cast("int")
    dealt = pairs.join(copies, "u").select("u", "v", part.alias("_part"))
    centres = copies.join(sets.withColumnRenamed("rep", "u"), "u").select(
        "u", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_part"), F.col("items").alias("left"))
    compared = (
        dealt.join(sets.select(F.col("rep").alias("v"), F.col("items").alias("right")), "v")
        .join(centres, ["u", "_part"]).select("u", "v", "left", "right")
        .mapInArrow(_intersections, "u long, v long, both long, sizes long")
    )
    percent = round(threshold * 100)
    return cut_lineage(compared.where(
        F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("sizes") - F.col("both"))).select("u", "v"))


def _sides(key: tuple, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two blocks that this group compares; a block with itself is there once."""
    side = part["_side"].to_numpy()
    return np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])


def _able(r: int, other: np.ndarray, rep, comp, n, sketches, threshold: float) -> np.ndarray:
    """Which of ``other`` may be linked with member ``r`` and are in another component."""
    near = np.minimum(n[other], n[r]) >= (threshold - 1e-9) * np.maximum(n[other], n[r])
    at = other[(comp[other] != comp[r]) & near & (rep[other] != rep[r])]
    bits = np.bitwise_count(sketches[at] ^ sketches[r]).sum(axis=1)
    return at[bits <= _cut(threshold)]


def _involved(threshold: float):
    """Members of a pair of blocks that may be linked with some member of another component."""
    def find(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first, second = _sides(key, part)
        rep, comp, n = (part[c].to_numpy() for c in ("rep", "comp", "n_shingles"))
        sketches = np.stack(part["sketch"].to_numpy()).view(np.uint64)
        hit = np.zeros(len(part), bool)
        for r in first:
            at = _able(r, second, rep, comp, n, sketches, threshold)
            hit[at] = True
            hit[r] |= len(at) > 0
        return part.loc[hit, ["bucket", "_i", "_j", "_side", "rep", "comp", "n_shingles", "sketch"]]

    return find


def _joining(threshold: float):
    """Links between members of a pair of blocks, as many as join their components and no more."""
    percent = round(threshold * 100)

    def find(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", kind="stable").reset_index(drop=True)
        first, second = _sides(key, part)
        rep, n = part["rep"].to_numpy(), part["n_shingles"].to_numpy()
        comp = part["comp"].to_numpy().copy()
        sketches = np.stack(part["sketch"].to_numpy()).view(np.uint64)
        _, items = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in part["items"]]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(items.max() + 1, bool)
        links = []
        for r in first:
            at = _able(r, second, rep, comp, n, sketches, threshold)
            if not len(at):
                continue
            own = items[starts[r] : starts[r + 1]]
            mark[own] = True
            # The items of all partners in one row, and how many of each are the member's own.
            ends = np.cumsum(n[at])
            places = np.arange(ends[-1]) + np.repeat(starts[at] - (ends - n[at]), n[at])
            both = np.add.reduceat(mark[items[places]].astype(np.int64), ends - n[at])
            mark[own] = False
            for v in at[100 * both >= percent * (n[at] + n[r] - both)]:
                if comp[v] != comp[r]:
                    links.append((min(rep[r], rep[v]), max(rep[r], rep[v])))
                    comp[comp == comp[v]] = comp[r]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return find


def similar_components(docs: DataFrame, id: str = "doc_id", text: str = "text",
                       threshold: float = THRESHOLD) -> DataFrame:
    """Groups of documents that are linked by similar five-word shingle sets, directly or over others.

    Returns doc_id, n_shingles and component_id (the smallest id in the group), one row per input row. Two
    documents are linked if the intersection of their sets is at least ``threshold`` of the union. Words lie
    between ASCII white space, A to Z count as small letters, and shingles are 64-bit hashes.

    1. Rows with equal sets (by size and a 128-bit digest) are one class; the smallest id stands for it.
    2. Representatives with an equal MinHash band share a bucket. Each is paired with the smallest of the
       bucket, so a bucket of any size gives one pair for a member.
    3. Odd sketches, the parity bitmaps of the samples, tell by XOR and a bit count which pairs can be
       similar enough; their full sets decide. Links give components.
    4. A bucket may still hold members of different components, which were only compared with the smallest.
       They are compared with each other, in blocks of bounded size: by sketch first, and those that may be
       linked across components by full sets. Only links that join components are kept, so none is lost
       and a group gives no more links than it has members.

    Documents without words or with a null text have an empty set and are linked with nothing. Fewer than
    five words are one shingle. Of rows that share an id but not their sets, the largest set is linked; the
    others are only linked with equal sets. Null ids come back with a null component. Empty
    tables give no rows; other columns are ignored.
    """
    rows = narrow(docs, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where(F.col("doc_id").isNotNull())
    sketched = cut_lineage(known.mapInArrow(_sketched(threshold), _SKETCHED))
    digest = ["n_shingles", "a", "b"]
    classes = (
        sketched.where("n_shingles > 0").groupBy(*digest)
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    # An id with several sets takes part with one of them.
    whole = F.struct(*digest, "bands", "sketch")
    reps = cut_lineage(classes.groupBy("rep").agg(F.max_by(whole, F.struct(*digest)).alias("_c")).select("rep", "_c.*"))
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("u"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = cut_lineage(shared)
    members = cut_lineage(
        buckets.join(shared, "bucket").where("rep <> u").select("bucket", "u", F.col("rep").alias("v"), "_n"))
    sides = reps.select("rep", "n_shingles", "a", "sketch")
    texts = known.select(F.col("doc_id").alias("rep"), "text")
    first = _confirmed(_sifted(members.select("u", "v").distinct(), sides, threshold), sides, texts, threshold)
    comps = connect(first)
    # What is left of a bucket without its smallest member is open if it spans components.
    placed = members.where("_n > 2").select("bucket", F.col("v").alias("rep")).join(
        comps.withColumnRenamed("node", "rep"), "rep", "left"
    ).join(sides.select("rep", "n_shingles"), "rep").select(
        "bucket", "rep", F.coalesce("comp", "rep").alias("comp"), "n_shingles")
    placed = cut_lineage(placed)
    still = placed.groupBy("bucket").agg(
        F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.sum("n_shingles").alias("_items")).where("_a <> _b")
    still = cut_lineage(still.select("bucket", F.ceil(F.col("_items") / BLOCK_ITEMS).cast("int").alias("_blocks")))
    side = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    blocks = (
        placed.join(broadcast_if_small(still), "bucket").join(sides.select("rep", "sketch"), "rep")
        .withColumn("_side", side)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_i", F.least("_side", "_other")).withColumn("_j", F.greatest("_side", "_other"))
        .select("bucket", "_i", "_j", "_side", "rep", "comp", "n_shingles", "sketch")
    )
    cell = ["bucket", "_i", "_j"]
    involved = cut_lineage(blocks.groupBy(*cell).applyInPandas(_involved(threshold), blocks.schema))
    if not involved.isEmpty():
        sets = _sets_of(involved.select("rep").distinct(), sides, texts)
        links = involved.join(sets, "rep").groupBy(*cell).applyInPandas(_joining(threshold), "u long, v long")
        comps = connect(first.union(links.distinct()))
    final = comps.withColumnRenamed("node", "rep")
    smallest = sketched.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    named = smallest.join(final, "rep", "left").select(
        *[F.col(c).alias("_" + c) for c in digest], F.coalesce("comp", "rep").alias("comp"))
    same = functools.reduce(lambda x, y: x & y, [F.col(c) == F.col("_" + c) for c in digest])
    found = sketched.select("doc_id", *digest).join(named, same, "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    unnamed = rows.where(F.col("doc_id").isNull()).select(
        "doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.union(unnamed)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns stay as they are.

    Rows with a null id stay, as do all rows of a kept id.
    """
    found = similar_components(docs, id, text, threshold)
    kept = found.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("_kept"))
    drop = cut_lineage(kept.where(~F.col("_kept")).select(F.col("doc_id").alias("_drop")))
    rest = packed(docs).join(broadcast_if_small(drop), field(id).cast("long") == F.col("_drop"), "left_anti")
    return unpacked(rest, docs)
