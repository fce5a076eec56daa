import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from memlake.llm.mixing import mix, mixed_rows, source_targets, word_count


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by cutting and sharing again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if weight[s] * level > most * sizes[s] + 1e-9}
        if not above:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1000}, {"a": 5, None: 50, "b": 0, "z": 7}, {"x": 3},
    {f"s{i:02}": (i * 37) % 91 + 1 for i in range(30)},
])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(table).collect()}
    assert got == pytest.approx(fill(sizes), abs=1e-5)


def walk(rows):
    """Words taken by stepping through every source's line."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    targets, taken = fill(sizes), []
    for source in sizes:
        line = sorted(
            (hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), words(t), i)
            for i, t, s in rows if s == source)
        left, got = int(targets[source] + 1e-6), [0] * len(line)
        while left > 0 and sizes[source]:
            for k, (_, n, _) in enumerate(line):
                step = min(n, left)
                got[k] += step
                left -= step
        taken += [(i, source, n, g) for (_, n, i), g in zip(line, got, strict=True)]
    return taken


def test_mix_walks_every_line(spark, rng):
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(str, walk(rows))) == sorted(str((r["doc_id"], r["source"], r["size"], r["taken"])) for r in got)


def test_rows_follow_the_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixed_rows(docs)
    assert rows.columns == docs.columns
    words = {r["doc_id"]: r["n"] for r in docs.select("doc_id", word_count("text").alias("n")).collect()}
    times = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    for r in mix(docs).collect():
        n = words[r["doc_id"]]
        assert times.get(r["doc_id"], 0) == (-(-r["taken"] // n) if n else 0)


def test_odd_rows(odd_docs, no_docs):
    got = mix(odd_docs)
    assert got.count() == odd_docs.count()
    assert got.where(F.col("taken") > 2 * F.col("size")).isEmpty()
    assert mixed_rows(odd_docs).columns == odd_docs.columns
    assert mix(no_docs).collect() == [] and mixed_rows(no_docs).collect() == []
