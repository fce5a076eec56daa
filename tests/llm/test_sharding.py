import collections
import zlib

import numpy as np
import pytest

from memlake.llm.sharding import balanced, best_fit_decreasing, shard


def plain_best_fit(sizes, capacity):
    rooms, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if not fits:
            rooms.append(max(capacity, sizes[i]))
            fits = [(rooms[-1], len(rooms) - 1)]
        bins[i] = min(fits)[1]
        rooms[bins[i]] -= sizes[i]
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_tree_packs_like_a_search_over_all_bins(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 120))
    sizes, capacity = rng.integers(1, 50, n), int(rng.integers(20, 150))
    assert best_fit_decreasing(sizes, np.arange(n), capacity).tolist() == plain_best_fit(sizes.tolist(), capacity)


@pytest.mark.parametrize("sizes, shards", [([10, 9, 8, 7, 6, 5], 3), ([100, 1, 1, 1], 2), ([5], 4), ([3] * 24, 24)])
def test_balanced_is_even(sizes, shards):
    bins = balanced(np.array(sizes), np.arange(len(sizes)), shards)
    load = np.bincount(bins, weights=sizes, minlength=shards)
    assert bins.max() < shards
    assert load.max() <= max(max(sizes), -(-sum(sizes) // shards) + min(sizes))


def test_no_groups():
    assert balanced(np.empty(0, np.int64), np.empty(0, np.int64), 3).tolist() == []


def check(rows, texts, shards):
    slots = collections.defaultdict(list)
    homes = collections.defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"], r["size"]].add(r["shard"])
        assert 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode()))
                  for i, t in texts)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows)
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


@pytest.mark.parametrize("units_per_task", [8_192, 20])
def test_all_documents(spark, sf_dir, units_per_task):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = shard(docs, 5, units_per_task=units_per_task).collect()
    check(rows, texts, 5)
    load = collections.Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.1 * sum(load.values()) / 5


def test_odd_rows(odd_docs):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    check(shard(odd_docs, 3).collect(), texts, 3)


def test_a_copied_text_with_most_rows(spark):
    texts = [(i, "same" if i % 3 else f"other {i}") for i in range(900)]
    check(shard(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect(), texts, 4)


def test_empty(no_docs):
    assert shard(no_docs, 24).collect() == []
