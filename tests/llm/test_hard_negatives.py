import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn
from tessera.llm.storage import keep


def brute(rows, is_anchor=lambda i: i % 10 == 0, positives=5, negatives=5):
    rows = [(i, v, l) for i, v, l in rows if i is not None and v is not None and l is not None and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, l in (r for r in rows if is_anchor(r[0])):
        all_ = sorted((-dot(v, w), j, m) for j, w, m in rows)
        for p, j, _ in [x for x in all_ if x[2] == l and x[1] != i][:positives]:
            fit = [x for x in all_ if x[2] != l and 80 * -p <= 100 * -x[0] <= 100 * -p][:negatives]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(fit)]
    return sorted(out)


def vectors(n, seed=1, dims=6, spread=4):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-spread, spread) * (1 + i % 5) for _ in range(dims)], rng.randrange(3)) for i in range(n)]
    return rows + [(n + i, rows[3][1], 0) for i in range(40)]  # a vector that many share


SCHEMA = "vec_id long, vector array<bigint>, label int, score int, rank string"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)


def mined(spark, rows, parts=4):
    found = hn.mine(table(spark, rows, parts), lambda i: i % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BUCKET", 16)
    monkeypatch.setattr(hn, "BLOCK", 7)
    rows = vectors(300)
    odd = [(None, [1] * 6, 1), (1000, None, 1), (1010, [1, None, 1, 1, 1, 1], 1), (1020, [1] * 6, None), (1030, [3, 2], 2), (1040, [], 0), (1050, [0] * 6, 1), (10, [5, 5, 5, 5, 5, 5], 1), rows[20]]
    want = brute(rows + odd)
    assert len(want) > 300 and mined(spark, rows + odd) == want
    monkeypatch.setattr(hn, "PASS_BYTES", 1000)  # many passes over the buckets
    stored = keep(hn.buckets(table(spark, rows).select(F.col("vec_id").alias("id"), "label", "vector")), "test")
    assert sum(len(r.ids) for r in stored.collect()) == len(rows)
    every = F.array(F.struct(F.lit(int(hn._LEAST)).alias("low"), F.lit(int(hn._LARGEST)).alias("high")))
    anchors = keep(table(spark, rows).where("vec_id % 10 = 0").select(F.col("vec_id").alias("k"), F.col("vec_id").alias("id"), "label", "vector", every.alias("spans")), "test")
    one, many = hn.search(stored, anchors, 3, True, pass_bytes=1 << 20), hn.search(stored, anchors, 3, True, pass_bytes=1000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-(2**26), 2**26) for _ in range(4)], i % 2) for i in range(60)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="do not fit"):
        mined(spark, [(0, [2**40], 1), (1, [2**40], 1)])


def test_no_rows_and_no_windows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1, 2], 1), (1, [1, 2], 2)]) == []  # no positive
    assert mined(spark, [(0, [1, 2], 1), (1, [-1, -2], 1), (2, [-1, -2], 2)]) == []  # a negative score has an empty window
    assert mined(spark, [(0, [0, 0], 1), (1, [0, 0], 1), (2, [0, 1], 2)]) == [(0, 1, 1, 2, 0, 0)]


def test_buckets_are_passed_over_by_length():
    rng = np.random.default_rng(2)
    m = rng.integers(-9, 10, (4000, 8)) * rng.integers(1, 60, (4000, 1))
    m = m[np.argsort(-(m**2).sum(1), kind="stable")]
    ids, labels = np.arange(4000), np.zeros(4000, int)
    w = hn.Windows(ids[:20] + 10_000, labels[:20], m[rng.integers(0, 4000, 20)], [np.array([hn._LEAST])] * 20, [np.array([hn._LARGEST])] * 20, 5, True)
    scored = [w.meet(float(np.sqrt((m[a : a + 100] ** 2).sum(1).max())), ids[a : a + 100], labels[a : a + 100], m[a : a + 100]) for a in range(0, 4000, 100)]
    assert scored[0] == 20 and sum(scored) < 20 * 40 / 2 and scored[-1] == 0
    exact = w.vectors @ m.T
    for q in range(20):
        best = np.lexsort((ids, -exact[q]))[:5]
        assert w.found[q].tolist() == best.tolist() and w.scores[q].tolist() == exact[q][best].tolist()
