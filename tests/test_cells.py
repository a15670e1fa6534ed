"""Vectors in cells: all cells are exact, few find nearly all; filters share a pass."""

import numpy as np
import pytest

from tessera.operators import cells, vector


def clustered(spark, n=3000, dims=32, groups=60, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    v = middle[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)] + [(n, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(q, rows[q * 50][1]) for q in range(50)] + [(99, None)], "qid long, vector array<float>")
    return df, asked


@pytest.fixture(scope="module")
def built(spark):
    df, asked = clustered(spark)
    return df, asked, cells.build(df, 32, parts=8, rounds=5)


def pairs(df):
    return sorted((r.qid, r.id, round(r.vector, 6)) for r in df.collect())


def test_all_cells_are_exact(spark, built):
    df, asked, index = built
    assert pairs(cells.nearest(index, asked, 10, probes=32, rescore=None)) == pairs(vector.nearest(df, asked, 10))
    assert index.codes.count() == 3000 and len(index.codes.first().code) == 8


def test_few_cells_find_nearly_all(spark, built):
    df, asked, index = built
    truth = vector.nearest(df, asked, 10)
    found = {p: cells.recall(cells.nearest(index, asked, 10, probes=p), truth) for p in (1, 6)}
    print("recall of 10 at 1 and 6 of 32 cells:", found)
    assert found[6] >= 0.95 and found[1] <= found[6]
    plan = cells.nearest(index, asked, 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "cell#" in plan
    got = cells.nearest(index, asked, 10, probes=6)
    assert sorted(got.columns) == ["id", "qid", "vector"] and got.groupBy("qid").count().where("count > 10").count() == 0


def test_a_stored_index_and_passes(spark, built, monkeypatch, tmp_path):
    df, asked, _ = built
    index = cells.build(df.where("vec_id < 40"), 4, parts=8, rounds=2, path=str(tmp_path / "cells"))
    again = cells.read(spark, str(tmp_path / "cells"))
    assert np.array_equal(again.centroids, index.centroids) and np.array_equal(again.books, index.books)
    one = pairs(cells.nearest(again, asked, 3, probes=4))
    monkeypatch.setattr(vector, "PASS_BYTES", 2000)
    assert pairs(cells.nearest(again, asked, 3, probes=4)) == one
    assert cells.nearest(again, asked.limit(0), 3, probes=2).count() == 0


def test_a_thousand_filter_sets_share_a_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 6))
    tags, kinds = [f"s{i}" for i in range(12)], [f"k{i}" for i in range(30)]
    row = lambda i: (i, [float(x) for x in v[i]], None if i % 17 == 0 else tags[rng.integers(12)], kinds[rng.integers(30)])
    rows = [row(i) for i in range(400)]
    some = lambda of: [None, [], *([str(x) for x in rng.choice(of, rng.integers(1, 4), replace=False)] for _ in range(6))][rng.integers(8)]
    asked = [(q, [float(x) for x in rng.normal(size=6)], some(tags), some([*kinds, "nowhere"])) for q in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, source string, category string").repartition(3)
    queries = spark.createDataFrame(asked, "qid long, vector array<double>, sources array<string>, categories array<string>")
    monkeypatch.setattr(vector, "ROWS", 50)
    found = vector.nearest(df, queries, 5, attributes={"sources": "source", "categories": "category"})
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.qid, []).append((-round(r.vector, 9), r.id))
    assert len({(str(a), str(b)) for _, _, a, b in asked}) > 300
    for q, x, sources, categories in asked:
        fits = [i for i, _, s, c in rows if (not sources or s in sources) and (not categories or c in categories)]
        want = sorted((-round(float(v[i] @ np.array(x)), 9), i) for i in fits)[:5]
        assert sorted(got.get(q, [])) == want
