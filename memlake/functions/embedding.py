"""Text preparation and encoders for vectors.

The built-in encoder hashes words into buckets and needs no model. Any other encoder is a
function DataFrame-side: a Column in, an array<float> Column out, for instance one made with
``pyspark.ml.functions.predict_batch_udf``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.exprs import col, collapse_spaces, is_blank

Encoder = Callable[[Column], Column]


def prepare(text: Column | str, cap: int | None = None) -> Column:
    """One line, lower case; blank text gives null. ``cap`` cuts the text before that."""
    text = col(text)
    cut = text if cap is None else F.substring(text, 1, cap)
    return F.when(~is_blank(cut), F.lower(collapse_spaces(cut)))


#: Rows whose words are counted at once.
_ROWS = 512


def _count_words(dim: int):
    """Unit-length counts of the buckets of the words of whole Arrow batches; a null text stays null."""
    @F.arrow_udf("array<float>")
    def count(texts: pa.Array) -> pa.Array:
        parts = [_counted(texts.slice(at, _ROWS), dim) for at in range(0, len(texts), _ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return count


def _bucket(word: bytes, dim: int) -> int:
    """Bucket of a word: the first seven hex digits of its MD5, modulo the width."""
    return int(hashlib.md5(word, usedforsecurity=False).hexdigest()[:7], 16) % dim


def _counted(texts: pa.Array, dim: int) -> pa.Array:
    """Every different word of the rows is hashed once."""
    buckets = pc.split_pattern(texts, " ")
    sizes = buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(buckets)), sizes)
    words = buckets.flatten().dictionary_encode()
    known = np.fromiter((_bucket(w, dim) for w in words.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(words.dictionary))
    cells = owner * dim + known[words.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(cells, minlength=len(buckets) * dim).reshape(len(buckets), dim).astype(np.float64)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    unit = np.divide(counts, length, out=np.zeros_like(counts), where=length > 0).astype(np.float32)
    offsets = pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()), mask=buckets.is_null())


def hashed_words(dim: int = 64) -> Encoder:
    """Unit-length bag-of-words vectors over hashed words."""
    return _count_words(dim)


_ENCODERS: dict[str, Callable[[], Encoder]] = {"hashed64": lambda: hashed_words(64)}


def register_encoder(name: str, factory: Callable[[], Encoder]) -> None:
    """Make an encoder available under a model name."""
    _ENCODERS[name] = factory


def model_encoder(
    load: Callable[[], Callable[[np.ndarray], np.ndarray]], base: Encoder | str = "hashed64", width: int = 64, batch_size: int = 256,
) -> Encoder:
    """An encoder that runs a model over batches of feature vectors.

    ``load`` is called once in every worker and returns a function from a batch of features (rows by ``width``) to a
    batch of vectors; what it needs, such as broadcast weights, it brings along. ``base`` gives the features of a text.
    A blank text has no vector.
    """
    features = encoder(base) if isinstance(base, str) else base
    run = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[width]])
    nothing = F.array_repeat(F.lit(0.0).cast("float"), width)

    def encode(text: Column) -> Column:
        given = features(text)
        return F.when(given.isNotNull(), run(F.coalesce(given, nothing)))

    return encode


def linear_model(spark: SparkSession, weights: np.ndarray) -> Encoder:
    """Features times a matrix of weights that is broadcast; the smallest model there is."""
    shared = spark.sparkContext.broadcast(np.asarray(weights, np.float64))

    def load() -> Callable[[np.ndarray], np.ndarray]:
        matrix = shared.value
        return lambda features: (features.astype(np.float64) @ matrix).astype(np.float32)

    return model_encoder(load, width=len(weights))


def encoder(name: str = "hashed64") -> Encoder:
    try:
        return _ENCODERS[name]()
    except KeyError:
        raise ValueError(f"unknown encoder {name!r}; known: {sorted(_ENCODERS)}") from None


def embed(
    df: DataFrame, text: str, out: str = "vector", encode: Encoder | str = "hashed64",
    cap: int | None = None,
) -> DataFrame:
    """Add a vector column of the whole text; blank text gives a null vector. An encoder of bounded input may set ``cap``."""
    make = encoder(encode) if isinstance(encode, str) else encode
    return df.withColumn(out, make(prepare(text, cap)))
