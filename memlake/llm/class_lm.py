"""Class-based bigram model: exchange clustering gives words their classes, transitions and emissions score texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.base import narrow
from memlake.llm.tokens import mix, words_of
from memlake.session import cut_lineage

CLASSES = 64
SWEEPS = 8
#: A word with a larger share of all tokens, and some occurrences, is exchanged by itself: 16,384 words at most.
UNIT_SHARE = 1 / (1 << 14)
UNIT_COUNT = 16
#: All other words are exchanged in groups by the hash of their last three bytes.
TAILS = 1024
#: Counts of words with a larger share are sent to the tasks: 1,048,576 words at most. The others' are joined.
TABLE_SHARE = 1 / (1 << 20)
#: Pseudo-count of the class frequencies in a transition.
PRIOR = 32.0
#: Distinct items that a task gathers before it hands them on.
HELD = 1 << 20

END = 0


@dataclass
class Units:
    """Sorted hashes of the words whose counts are known everywhere, the counts, and their units.

    Unit 0 is the end of a text, then come the words that are units, then the groups by tail.
    """

    words: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    own: int

    @property
    def size(self) -> int:
        return 1 + self.own + TAILS

    def find(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each word, and its count or -1 if that isn't known here."""
        units = (1 + self.own + tail_group(tails)).astype(np.int32)
        counts = np.full(len(hashes), -1, np.int64)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            counts[known] = self.counts[at[known]]
            own = known & (self.units[at] >= 0)
            units[own] = self.units[at[own]]
        return units, counts


@dataclass
class Model:
    """Everything that scoring needs besides the counts of rare words. All tables have a bounded size."""

    units: Units
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    tail_total: np.ndarray
    tail_words: np.ndarray
    discount: float
    tokens: int
    vocabulary: int
    texts: int


def tail_group(tails: np.ndarray) -> np.ndarray:
    return (mix(tails.astype(np.uint64)) % np.uint64(TAILS)).astype(np.int32)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    some, place = np.unique(np.concatenate(keys), return_inverse=True)
    return some, np.bincount(place, weights=np.concatenate(counts), minlength=len(some)).astype(np.int64)


class _Counter:
    """Counts of 64-bit keys, handed on when a bounded number of them is held."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        some, n = np.unique(keys, return_counts=True)
        self.keys.append(some)
        self.counts.append(n)
        self.held += len(some)

    def take(self, all_of_it: bool = False):
        if not self.keys or not (all_of_it or self.held > 2 * HELD):
            return None
        some, n = _summed(self.keys, self.counts)
        if not all_of_it and len(some) < HELD:
            self.keys, self.counts, self.held = [some], [n], len(some)
            return None
        self.keys, self.counts, self.held = [], [], 0
        return some, n


def word_counts(texts: DataFrame) -> DataFrame:
    """How often each word occurs: word (64-bit hash), tail (its group), n. Counted in the tasks first."""
    def count(batches):
        counter, tails = _Counter(), {}

        def rows(done):
            some, n = done
            # The group of a word follows from the word, so any occurrence tells it.
            known = np.concatenate(tails["words"])
            groups = np.concatenate(tails["groups"])
            order = np.argsort(known, kind="stable")
            found = groups[order][np.searchsorted(known[order], some)]
            tails.clear()
            return pa.record_batch(
                [pa.array(some.view(np.int64)), pa.array(found), pa.array(n)], names=["word", "tail", "n"])

        for batch in batches:
            for words in words_of(batch.column("text")):
                some, first = np.unique(words.hashes, return_index=True)
                tails.setdefault("words", []).append(some)
                tails.setdefault("groups", []).append(tail_group(words.tails[first]))
                counter.add(words.hashes)
                if done := counter.take():
                    yield rows(done)
        if done := counter.take(all_of_it=True):
            yield rows(done)

    counted = texts.mapInArrow(count, "word long, tail int, n long")
    return counted.groupBy("word", "tail").agg(F.sum("n").alias("n"))


def _stream(words, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of some texts, each followed by an end; the places of the ends; counts of the words."""
    found, counts = units.find(words.hashes, words.tails)
    ends = words.bounds[1:]
    return np.insert(found, ends, END), ends + np.arange(len(ends)), counts


def unit_pairs(texts: DataFrame, units: Units) -> DataFrame:
    """How often one unit follows another: pair (first * size + second), n."""
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def count(batches):
        counter, size = _Counter(), shared.value.size
        for batch in batches:
            for words in words_of(batch.column("text")):
                stream = _stream(words, shared.value)[0].astype(np.int64)
                counter.add(np.concatenate([[END], stream[:-1]]) * size + stream)
                if done := counter.take():
                    yield pa.record_batch([pa.array(x) for x in done], names=["pair", "n"])
        if done := counter.take(all_of_it=True):
            yield pa.record_batch([pa.array(x) for x in done], names=["pair", "n"])

    return texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def _objective(matrix: np.ndarray) -> float:
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def best_class(own: int, before: np.ndarray, after: np.ndarray, selfs: float, matrix: np.ndarray) -> int:
    """The class that a unit of class ``own`` raises the likelihood most in.

    before, after: how often each class precedes and follows the unit, without itself; selfs: how often it
    follows itself. Class 0 is kept for the ends of texts. Ties stay, or go to the smaller class.
    """
    rest = matrix.copy()
    rest[:, own] -= before
    rest[own, :] -= after
    rest[own, own] -= selfs
    # The other classes' totals hold their pairs with the unit, wherever it goes.
    into, out = rest.sum(0) + after, rest.sum(1) + before
    p, f = np.flatnonzero(before), np.flatnonzero(after)
    gain = (_xlogx(rest[p] + before[p, None]) - _xlogx(rest[p])).sum(0)
    gain += (_xlogx(rest[:, f] + after[f]) - _xlogx(rest[:, f])).sum(1)
    # The cell of a class with itself gets both sides at once.
    d = np.diagonal(rest)
    gain += _xlogx(d + before + after + selfs) + _xlogx(d) - _xlogx(d + before) - _xlogx(d + after)
    gain -= _xlogx(into + before.sum() + selfs) - _xlogx(into)
    gain -= _xlogx(out + after.sum() + selfs) - _xlogx(out)
    gain[0] = -np.inf
    best = int(gain.argmax())
    return best if gain[best] > gain[own] + 1e-9 else own


def exchange(pairs: DataFrame, size: int, first: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Exchange clustering of units by the likelihood of class bigrams: classes, and the matrix of their counts.

    Each unit's neighbours are gathered in one row, as many as there are units at most. A sweep sums the
    class matrix, then moves every second unit, by turns, to its best class; all tasks see the same classes
    and matrix, so the result doesn't depend on the partitioning. The best sweep's classes are returned.
    """
    spark = pairs.sparkSession
    n_classes = CLASSES + 1
    split = pairs.select((F.col("pair") / size).cast("long").cast("int").alias("u"),
                         (F.col("pair") % size).cast("int").alias("v"), "n")
    sides = split.select(F.col("u").alias("unit"), F.struct(F.lit(True).alias("next"), F.col("v").alias("other"), "n").alias("x"))
    sides = sides.union(split.select(
        F.col("v").alias("unit"), F.struct(F.lit(False).alias("next"), F.col("u").alias("other"), "n").alias("x")))
    rows = cut_lineage(sides.groupBy("unit").agg(F.collect_list("x").alias("near")))

    def neighbours(batch):
        near = batch.column("near")
        flat = near.flatten()
        bounds = np.concatenate([[0], np.cumsum(near.value_lengths().to_numpy())])
        columns = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("next", "other", "n")]
        for k, unit in enumerate(batch.column("unit").to_pylist()):
            yield unit, *[c[bounds[k] : bounds[k + 1]] for c in columns]

    def matrix_of(classes: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(classes)

        def cells(batches):
            total = np.zeros(n_classes * n_classes)
            for batch in batches:
                for unit, after, other, n in neighbours(batch):
                    cell = int(shared.value[unit]) * n_classes + shared.value[other[after]].astype(np.int64)
                    total += np.bincount(cell, weights=n[after], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(some), pa.array(total[some].astype(np.int64))], names=["cell", "n"])

        found = rows.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        matrix = np.zeros(n_classes * n_classes)
        matrix[found["cell"].to_numpy()] = found["n"].to_numpy()
        shared.unpersist()
        return matrix.reshape(n_classes, n_classes)

    def moved(classes: np.ndarray, matrix: np.ndarray, turn: int) -> np.ndarray:
        shared = spark.sparkContext.broadcast((classes, matrix))

        def move(batches):
            classes, matrix = shared.value
            for batch in batches:
                to = []
                for unit, after, other, n in neighbours(batch):
                    if unit == END or (unit * 0x9E3779B1 >> 7) % 2 != turn % 2:
                        continue
                    alone = other != unit
                    near = [np.bincount(classes[other[s & alone]], weights=n[s & alone], minlength=n_classes)
                            for s in (~after, after)]
                    selfs = float(n[after & ~alone].sum())
                    to.append((unit, best_class(int(classes[unit]), *near, selfs, matrix)))
                yield pa.record_batch(
                    [pa.array([u for u, _ in to], pa.int32()), pa.array([c for _, c in to], pa.int32())],
                    names=["unit", "to"])

        found = rows.mapInArrow(move, "unit int, to int").toArrow()
        shared.unpersist()
        after = classes.copy()
        after[found["unit"].to_numpy()] = found["to"].to_numpy()
        return after

    classes, matrix = first, matrix_of(first)
    best = (_objective(matrix), classes, matrix)
    for turn in range(sweeps):
        classes = moved(classes, matrix, turn)
        matrix = matrix_of(classes)
        score = _objective(matrix)
        if score > best[0]:
            best = (score, classes, matrix)
    return best[1], best[2]


def train(texts: DataFrame, sweeps: int = SWEEPS) -> tuple[Model, DataFrame]:
    """The model of a corpus (column ``text``), and its word counts for the words that the model leaves out."""
    counts = cut_lineage(word_counts(texts))
    n_texts = texts.count()
    sums = counts.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once"),
        F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
    tokens = (sums["n"] or 0) + n_texts
    common = (F.col("n") > tokens * UNIT_SHARE) & (F.col("n") >= UNIT_COUNT)
    table = counts.where(F.col("n") > tokens * TABLE_SHARE).select("word", "n").toArrow()
    words, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    own = (n > tokens * UNIT_SHARE) & (n >= UNIT_COUNT)
    # Units in order of frequency.
    by_count = np.flatnonzero(own)[np.lexsort((words[own], -n[own]))]
    numbers = np.full(len(words), -1, np.int32)
    numbers[by_count] = 1 + np.arange(len(by_count))
    units = Units(words, n, numbers, len(by_count))
    rare = counts.where(~common).groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    tail_total, tail_words = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    tail_total[rare["tail"].to_numpy()] = rare["n"].to_numpy()
    tail_words[rare["tail"].to_numpy()] = rare["v"].to_numpy()
    first = (1 + np.arange(units.size) % CLASSES).astype(np.int64)
    first[END] = 0
    classes, matrix = exchange(unit_pairs(texts, units), units.size, first, sweeps)

    weight = np.concatenate([[n_texts], n[by_count], tail_total]).astype(float) + 0.5
    of_class = np.bincount(classes, weights=weight, minlength=CLASSES + 1)
    emission = np.log10(weight / of_class[classes])
    share = (matrix.sum(0) + 1) / (matrix.sum() + CLASSES + 1)
    transition = np.log10((matrix + PRIOR * share) / (matrix.sum(1, keepdims=True) + PRIOR))
    discount = float(np.clip(sums["once"] / max(sums["once"] + 2 * sums["twice"], 1), 0.1, 0.9))
    model = Model(units, classes, transition, emission, tail_total, tail_words, discount, tokens,
                  sums["v"] + (n_texts > 0), n_texts)
    return model, counts


_SCORED = ("doc_id {kind}, key long, word long, times int, tail int, n_tokens long, n_known long, "
           "base double, score double")


def _scorer(shared):
    def score(batches):
        model = shared.value
        units = model.units
        first_tail = 1 + units.own
        with np.errstate(divide="ignore"):
            seen_total = np.log10(np.maximum(model.tail_total, 1))
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for words in words_of(batch.column("text")):
                stream, ends, counts = _stream(words, units)
                classes = model.classes[stream]
                value = model.transition[np.concatenate([[0], classes[:-1]]), classes] + model.emission[stream]
                base = np.zeros(len(stream))
                base[ends] = np.log10(model.texts + 1)
                known = np.zeros(len(stream), np.int64)
                known[ends] = model.texts > 0
                spoken = np.ones(len(stream), bool)
                spoken[ends] = False
                unit = stream[spoken]
                here = counts >= 0
                base[spoken] = np.where(here, np.log10(np.maximum(counts, 0) + 1), 0.0)
                known[spoken] = here & (counts > 0)
                # A word of a group: its part of the group is known here, or its count is joined later.
                group = unit - first_tail
                shared_tail = group >= 0
                part = np.zeros(len(unit))
                both = shared_tail & here
                part[both] = np.log10(counts[both] - model.discount)
                part[shared_tail] -= seen_total[group[shared_tail]]
                value[spoken] += part
                starts = np.concatenate([[0], ends[:-1] + 1])
                rows = slice(words.first, words.first + len(ends))
                n = len(ends)
                yield pa.record_batch([
                    batch.column("doc_id")[rows], pa.array(keys[rows]), pa.array(keys[rows]),
                    pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)),
                    pa.array(ends - starts + 1), pa.array(np.add.reduceat(known, starts)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(value, starts)),
                ], names=["doc_id", "key", "word", "times", "tail", "n_tokens", "n_known", "base", "score"])
                # Each rare word of a text once, with its number.
                away = np.flatnonzero(~here)
                if not len(away):
                    continue
                owner = np.searchsorted(words.bounds[1:], away, side="right")
                order = np.lexsort((words.hashes[away], owner))
                owner, word, tail = owner[order], words.hashes[away][order], group[away][order]
                fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])]))
                times = np.diff(np.append(fresh, len(word))).astype(np.int32)
                m = len(fresh)
                blank = pa.nulls(m, pa.float64())
                yield pa.record_batch([
                    batch.column("doc_id")[rows].take(pa.array(owner[fresh])), pa.array(keys[rows][owner[fresh]]),
                    pa.array(word[fresh].view(np.int64)), pa.array(times), pa.array(tail[fresh].astype(np.int32)),
                    pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), blank, blank,
                ], names=["doc_id", "key", "word", "times", "tail", "n_tokens", "n_known", "base", "score"])

    return score


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of every text under the class model and under single words with one added to counts.

    Returns doc_id, n_tokens, n_known, base_score and score, one row per input row. A text is its words and an
    end. A token's probability is that of its class after the class before, times that of the word in its
    class. A word that shares its unit with others has a discounted part of the unit's count, and all words
    never seen share what the discounts leave, so the probabilities of all words and one unknown word add up
    to one.

    The tasks know the classes and the counts of all but rare words. Rare words go to their counts by a join,
    each once for a text; no word of that join has more than one of a million tokens.

    Null text: like an empty one, only an end. Null ids are values; rows that are wholly equal come back as
    often. Empty tables give no rows; other columns are ignored.
    """
    rows = narrow(docs, doc_id=id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                        F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = keyed.mapInArrow(_scorer(shared), _SCORED.format(kind=kind))
    rare = counts.where(F.col("n") <= model.tokens * TABLE_SHARE).select(F.col("word").alias("_word"), "n")
    tails = docs.sparkSession.createDataFrame(
        [(k, float(np.log10(max(model.discount * v, 1e-300))) if v else 0.0)
         for k, v in enumerate(model.tail_words.tolist())], "_tail int, unseen double")
    times = F.col("times")
    # The rows of the texts themselves carry no times; they are spread by their key.
    joined = scored.join(rare, F.col("word") == F.col("_word"), "left").join(
        F.broadcast(tails), F.col("tail") == F.col("_tail"))
    seen = F.col("n").isNotNull() & (times > 0)
    parts = joined.select(
        "doc_id", "key", "n_tokens",
        F.coalesce("n_known", F.when(seen, times).otherwise(0)).alias("known"),
        F.coalesce("base", F.when(seen, times * F.log10(F.col("n") + 1)).otherwise(0.0)).alias("base"),
        F.coalesce("score", times * F.when(seen, F.log10(F.col("n") - F.lit(model.discount)))
                   .otherwise(F.col("unseen"))).alias("score"),
    )
    total = parts.groupBy("doc_id", "key").agg(
        F.count("n_tokens").cast("int").alias("copies"), F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    each = lambda c: F.col(c) / F.col("copies")
    ground = float(np.log10(model.tokens + model.vocabulary + 1))
    return total.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "n_tokens", F.round(each("known")).cast("long").alias("n_known"),
        (each("base") - F.col("n_tokens") * F.lit(ground)).alias("base_score"), each("score").alias("score"))


def held_out(id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Null ids are learned from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == fold, F.lit(False))
