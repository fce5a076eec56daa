import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import hard_negatives as hn
from memlake.llm.model_queries import op12_hard_negatives


def brute(rows):
    """Rows (id, label, vector of whole numbers) by plain Python."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], math.inf if r[1] is None else r[1])
    for aid, alabel, av in rows:
        if aid is None or aid % 100:
            continue
        scored = [(dot(av, v), i, label) for i, label, v in rows if i != aid]
        best = sorted((r for r in scored if r[2] == alabel), key=order)[:5]
        for p, pid, _ in best:
            fits = [r for r in scored if r[2] != alabel and 80 * p <= 100 * r[0] <= 100 * p]
            for rank, (n, nid, _) in enumerate(sorted(fits, key=order)[:5], 1):
                out.append((aid, pid, rank, nid, p, n))
    return sorted(out, key=str)


def moved(rows):
    return [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, v) for i, label, v in rows]


def mined(spark, rows):
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>")
    df = df.withColumn("id", F.coalesce("id", F.lit(hn.NO_ID))).repartition(5)
    found = hn.mine(df, F.col("id") % 100 == 0)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("top", [1, 300, 70_000, 90_000_000])
@pytest.mark.parametrize("width", [1, 64, 200])
def test_scores_are_exact(top, width):
    rng = np.random.default_rng(top + width)
    a, b = rng.integers(-top, top + 1, (20, width)), rng.integers(-top, top + 1, (30, width))
    a[0], b[0], b[1] = top, top, -top
    primes = hn.moduli(width * top * top)
    assert math.prod(primes) > 2 * width * top * top and max(primes) <= 1023
    found = hn.scores(hn.residues(a, primes), hn.residues(b, primes), primes)
    assert found.tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


def test_largest_residues_stay_exact_in_float32():
    prime = hn.moduli(1)[0]
    a = np.full((2, hn.WIDTH), prime // 2)
    found = hn._product(*[hn.residues(x, [prime])[0] for x in (a, a)], prime)
    half = hn.WIDTH * (prime // 2) ** 2
    assert half < hn.EXACT and found[0, 0] % prime == half % prime


def test_against_brute_force(spark, rng, monkeypatch):
    monkeypatch.setattr(hn, "CELLS", 40)
    monkeypatch.setattr(hn, "ANCHORS", 2)
    monkeypatch.setattr(hn, "HELD", 30)
    monkeypatch.setattr(hn, "BLOCK_BYTES", 600)
    rows = [(i * 20, rng.randint(-1, 2), [rng.randint(-3, 9) for _ in range(4)]) for i in range(90)]
    assert mined(spark, rows) == brute(rows) != []


def test_ties_repeats_zeros_and_negative_scores(spark):
    same = [5, 5]
    rows = [(100, 1, same), (100, 1, same), (200, 1, [0, 0]), (300, 2, [-5, -5]), (400, 2, [1, 0]), (None, 1, same)]
    rows += [(i, i % 3, same) for i in range(1, 40)] + [(500, 7, same), (7, 1, [5]), (None, 2, same), (9, 2, [])]
    assert mined(spark, rows) == brute([(i, l, v + [0] * (2 - len(v))) for i, l, v in rows]) != []


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (100, 1, [0.5, -0.501]), (101, 1, [0.5, 0.0]), (102, 2, [0.25, -0.25]), (103, None, [1.0, 1.0]), (104, 2, None),
        (105, 2, [None, 1.0]), (106, 2, [nan, 1.0]), (107, 1, [inf, 0.0]), (108, 1, [-inf, 0.0]), (None, 2, [0.5, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df = df.withColumns({"id": F.lit("x"), "vector": F.lit(1), "key": F.lit(None), "score": F.lit(0.5)})
    used = hn.usable(df, "vec_id", "label", "embedding").orderBy("id")
    assert [tuple(r) for r in used.collect()] == [
        (100, 1, [128, -129]), (101, 1, [128, 0]), (102, 2, [64, -64]), (hn.NO_ID, 2, [128, 0])]
    # Row 102 scores 16,448 and is beyond the window.
    assert [tuple(r) for r in hn.mine(used, F.col("id") == 100).collect()] == [(100, 101, 1, None, 16384, 16384)]
    assert hn.mine(used.where("false"), F.col("id") == 100).count() == 0
    assert hn.mine(used, F.col("id") == 5).count() == 0
    with pytest.raises(ValueError):
        hn.mine(used.withColumn("vector", F.array(F.lit(1 << 40))), F.col("id") == 100)


def test_query(spark, sf_dir):
    read = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["label"], [math.floor(256 * x) for x in r["embedding"]]) for r in read]
    found = op12_hard_negatives(spark, sf_dir)
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(moved(rows)) != []
