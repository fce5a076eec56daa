import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import near_dedup
from memlake.llm.near_dedup import band_keys, connect, estimate, keep_one, minhash, odd_sketch, similar_components


def plain(texts, threshold=85):
    """Smallest reachable id by comparing all pairs of sets."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(spark, texts):
    rows = similar_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def drifting(rng, copies, words=120, edits=4):
    """Copies of one text with a few words replaced: some are linked with each other, some only over others."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        some = list(base)
        for _ in range(rng.randint(0, edits)):
            some[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(some))
    return out


def test_like_all_pairs(spark, rng):
    texts = drifting(rng, 60) + drifting(rng, 30, 60, 2) + drifting(rng, 25, 12, 1) + ["a b c", "A  b\tc", "a b", "", " "]
    texts = list(enumerate(rng.sample(texts, len(texts)))) + [(999, None)]
    assert found(spark, texts) == plain(texts)


def test_blocks_of_an_open_bucket(spark, rng, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ITEMS", 2_000)
    texts = list(enumerate(drifting(rng, 150, 100, 6)))
    assert found(spark, texts) == plain(texts)


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.85, 0.95])
def test_bands_follow_the_threshold(threshold):
    missed = (1 - threshold**near_dedup.ROWS) ** near_dedup.bands_for(threshold)
    assert 1e-8 < missed <= near_dedup.MISSED or threshold > 0.9 and missed <= near_dedup.MISSED


def test_lower_threshold_like_all_pairs(spark, rng):
    texts = list(enumerate(drifting(rng, 60, 100, 3) + drifting(rng, 60, 60, 2)))
    rows = similar_components(spark.createDataFrame(texts, "doc_id long, text string"), threshold=0.8).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain(texts, 80)


def test_a_passage_that_many_share_links_nothing(spark, rng):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [(i, passage + " " + " ".join(f"u{i}x{k}" for k in range(60))) for i in range(200)]
    assert all(c == i for i, (_, c) in found(spark, texts).items())


def test_one_text_with_most_rows(spark):
    texts = [(i, "one two three four five six" if i % 3 else f"alone {i} a b c d e") for i in range(600)]
    got = found(spark, texts)
    assert {got[i][1] for i in range(600) if i % 3} == {1}


def test_estimates_follow_the_similarity(spark):
    rng = np.random.default_rng(5)
    for share in (0.7, 0.85, 0.95):
        both = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        rest = int(2000 * (1 - share) / (2 * share))
        one, two = (np.concatenate([both, rng.integers(0, 1 << 63, rest, dtype=np.uint64)]) for _ in range(2))
        bits = int(np.bitwise_count(odd_sketch(minhash(one)) ^ odd_sketch(minhash(two))).sum())
        got = spark.range(1).select(estimate(F.lit(bits)).alias("e")).first()["e"]
        assert got == pytest.approx(share, abs=0.16)
        assert (bits <= near_dedup._cut(0.85)) or share < 0.85
    assert (band_keys(minhash(both)) == band_keys(minhash(both[::-1]))).all()


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(80)], [(0, i) for i in range(1, 50)], [(50 - i, 51 - i) for i in range(40)] + [(100, 7)],
    [(1, 2), (3, 4), (4, 1), (9, 8)], [(5, 5)], [],
])
def test_components(spark, links):
    got = {r["node"]: r["comp"] for r in connect(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {}
    for u, v in links:
        if u != v:
            group = {u, v} | {n for n, c in want.items() if c in (want.get(u), want.get(v)) and c is not None}
            want |= dict.fromkeys(group, min(group))
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = similar_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    named = {r["doc_id"]: r["component_id"] for r in rows}
    assert named[4] == 1 and named[6] == 6 and named[2] == 2 and named[None] is None
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 3, 5, 6, 6, 7, 8]
    assert similar_components(no_docs).collect() == [] and keep_one(no_docs).collect() == []


def test_an_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    got = similar_components(spark.createDataFrame([(3, a), (3, b + " more"), (5, a), (6, b)], "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {3}
