"""Language ID by a Bloom filter whose every slot is a mask of languages."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.base import field, narrow, packed, unpacked
from memlake.llm.tokens import mix
from memlake.session import cut_lineage

UNKNOWN = "und"
#: Labelled documents of each language that the filter learns from, at most.
SAMPLE_DOCS = 300
#: An n-gram belongs to a language if this share of the language's sampled documents holds it.
LEAST_SHARE = 0.03
SLOT_BITS = 18
HASHES = 3
#: Characters that are worked on at once.
CHUNK = 1 << 18
#: A text with a smaller share of known n-grams is in no learned language.
LEAST_COVERAGE = 0.2


@dataclass
class Model:
    """languages: names, most frequent first. slots: a mask for each slot, languages by 64 in the second axis.
    false: chance that an n-gram of no language seems to be of this one."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each letter the hash of it and its neighbours, and the text it is in.

    Capitals count as small letters, and whatever stands between letters as one blank.
    """
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in codes])
    gap = np.array([0], np.uint32)
    flat = np.concatenate([gap, *[x for c in codes for x in (c, gap)]])
    letter = _letters()[flat]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]
    letter = letter[kept]
    symbol = np.where(letter, flat[kept], 0).astype(np.uint64)
    owner = np.concatenate([[0], owner])[kept]
    middle = np.flatnonzero(letter)
    h = symbol[middle - 1] * np.uint64(0x1F3D5B79) ^ symbol[middle] << np.uint64(21) ^ symbol[middle + 1] << np.uint64(42)
    return mix(h), owner[middle]


def _slots_of(grams: np.ndarray) -> list[np.ndarray]:
    wide = np.uint64((1 << SLOT_BITS) - 1)
    return [((grams >> np.uint64(SLOT_BITS * k)) & wide).astype(np.int64) for k in range(HASHES)]


def _pieces(texts: list[str | None]):
    """(text, row) in groups of bounded length; a long text comes in parts that end at a blank if it has any."""
    group, size = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        while text:
            cut = len(text)
            if cut > CHUNK:
                cut = text.rfind(" ", 0, CHUNK) + 1 or CHUNK
            if group and size + cut > CHUNK:
                yield group
                group, size = [], 0
            group.append((text[:cut], row))
            size += cut
            text = text[cut:]
    if group:
        yield group


def count_languages(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text its n-grams, and how many of them the filter holds for each language."""
    total = np.zeros(len(texts), np.int64)
    found = np.zeros((len(texts), len(model.languages)), np.int64)
    for group in _pieces(texts):
        grams, owner = _grams([t for t, _ in group])
        rows = np.array([r for _, r in group])[owner]
        total += np.bincount(rows, minlength=len(texts))
        slots = _slots_of(grams)
        for word in range(model.slots.shape[1]):
            table = model.slots[:, word]
            masks = functools.reduce(np.bitwise_and, [table[s] for s in slots])
            for k in range(word * 64, min(word * 64 + 64, len(model.languages))):
                hit = (masks >> np.uint64(k % 64)) & np.uint64(1)
                found[:, k] += np.bincount(rows[hit.astype(bool)], minlength=len(texts))
    return total, found


def decide(total: np.ndarray, found: np.ndarray, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and coverage of each text.

    Counts are corrected for the n-grams that only seem to be there. The largest wins, ties go to the more
    frequent language. The score is its part of all corrected counts, the coverage its part of the n-grams.
    """
    if not model.languages:
        return [UNKNOWN] * len(total), np.zeros(len(total)), np.zeros(len(total))
    likely = np.clip((found - total[:, None] * model.false) / (1 - model.false), 0, None)
    best = likely.argmax(axis=1)
    top = likely[np.arange(len(total)), best]
    score = np.where(top > 0, top / np.maximum(likely.sum(axis=1), 1e-300), 0.0)
    coverage = np.clip(top / np.maximum(total, 1), 0, 1)
    names = [model.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)]
    return names, np.clip(score, 0, 1), coverage


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS, least_share: float = LEAST_SHARE) -> Model:
    """Fit the filter on a bounded sample: the documents of each language with the smallest hashed ids.

    Rows without text, language or id are left out; of rows that share an id one is used. What reaches the
    driver is the table of slots, 2^18 at most, and the languages.
    """
    rows = narrow(docs, doc_id=id, text=text, lang=lang)
    labelled = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts, key=lambda name: (-counts[name], name))
    code = {name: k for k, name in enumerate(languages)}
    # A little more than the sample passes the first test, so that little is ranked.
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    near = F.lit(False)
    for name, n in counts.items():
        near |= (F.col("lang") == name) & (chance < 1.3 * sample_docs / n)
    order = Window.partitionBy("lang").orderBy("_chance", "doc_id")
    chosen = cut_lineage(
        labelled.where(near).select("doc_id", "lang", chance.alias("_chance"))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= sample_docs).select("doc_id", "lang").dropDuplicates(["doc_id"])
    )
    sampled = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    least = F.array(*[F.lit(math.ceil(sampled.get(name, 0) * least_share)) for name in languages] or [F.lit(0)])
    picked = rows.drop("lang").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    picked = picked.dropDuplicates(["doc_id"]).select("lang", "text")

    def grams(batches):
        for batch in batches:
            for name, value in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                parts = [np.unique(_grams([t for t, _ in g])[0]) for g in _pieces([value])]
                some = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
                yield pa.record_batch(
                    [pa.array(np.full(len(some), code[name], np.int32)), pa.array(some.view(np.int64))],
                    names=["lang", "gram"])

    seen = picked.mapInArrow(grams, "lang int, gram long").groupBy("lang", "gram").count()
    held = seen.where(F.col("count") >= F.get(least, F.col("lang")))
    shift = SLOT_BITS
    slots = F.array(*[
        F.shiftrightunsigned("gram", shift * k).bitwiseAND(F.lit((1 << shift) - 1)) for k in range(HASHES)
    ])
    filled = (
        held.select(F.floor(F.col("lang") / 64).alias("word"), F.explode(slots).alias("slot"),
                    F.expr("shiftleft(1L, lang % 64)").alias("mask"))
        .groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    )
    table = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    table[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    share = [np.mean((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))]
    return Model(languages, table, np.array(share) ** HASHES)


def predictor(spark, model: Model):
    """A function from a text column to struct(lang, score, coverage). The model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,coverage:double>")
    def predict(text: pa.Array) -> pa.Array:
        names, score, coverage = decide(*count_languages(text.to_pylist(), shared.value), shared.value)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(score), pa.array(coverage)], ["lang", "score", "coverage"])

    return predict


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and coverage of every row, from its whole text alone.

    Null text, or one without letters: ``und`` and 0. A text of which nothing is known gets the most frequent
    language and 0. With nothing learned, all are ``und``. Ids, ties and repeated rows don't matter; empty
    tables give no rows; other columns are ignored.
    """
    predict = predictor(docs.sparkSession, model)
    rows = narrow(docs, doc_id=id, text=text).select("doc_id", predict("text").alias("_p"))
    return rows.select(
        "doc_id", F.col("_p")["lang"].alias("lang_pred"), F.col("_p")["score"].alias("score"),
        F.col("_p")["coverage"].alias("coverage"),
    )


def keep_known(docs: DataFrame, model: Model, text: str = "text", least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """``docs`` without the rows in no learned language; all columns stay as they are."""
    predict = predictor(docs.sparkSession, model)
    judged = packed(docs).withColumn("_verdict", predict(field(text)))
    known = (F.col("_verdict")["lang"] != UNKNOWN) & (F.col("_verdict")["coverage"] >= least_coverage)
    return unpacked(judged.where(known), docs)


def fold(id: Column, folds: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % folds
