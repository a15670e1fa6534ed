import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.llm import near_dedup
from tessera.llm import storage as near_dedup_storage


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    """(n_shingles, component) by row; ids as nodes."""
    sets = [shingles(t, width) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    for k, s in enumerate(sets):
        if rows[k][0] is None:
            continue
        common = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j > k and rows[j][0] is not None:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(rows[k][0]), find(rows[j][0])))
                parent[b] = a
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


def run(spark, rows, width, percent, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("h", F.lit(1))
    got = near_dedup.near_duplicates(df, width=width, percent=percent, **more).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    return got


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def made_up(seed, groups=6, size=12, noise=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(50)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([2, 4, 20, 60, 150, 400]))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            rows.append(rng.choice([" ", "\n", "  "]).join(t))
    for _ in range(noise):
        rows.append(" ".join(passage + [word() for _ in range(rng.randint(0, 40))]))
    rows += ["", None, " \n", "One", "one", "ONE two", "one two", "one  two"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width,percent,k", [(3, 85, 64), (5, 80, 64), (3, 85, 8), (2, 50, 64)])
def test_same_as_brute_force(spark, width, percent, k):
    rows = made_up(width * percent)
    got = run(spark, rows, width, percent, k=k)
    if k == 8:  # so small a sketch is a chance, but never finds what is not there
        truth = {r[0]: r[2] for r in brute(rows, width, percent)}
        assert all(truth[r.doc_id] == truth[r.component_id] for r in got)
    else:
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, width, percent))


def test_long_lists_take_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LONG_LIST", 3)
    monkeypatch.setattr(near_dedup_storage, "FEW_BYTES", -1)
    rows = made_up(99, groups=4, size=30, noise=80)
    got = run(spark, rows, 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_nulls_repeats_and_very_long_texts(spark):
    long = " ".join(f"w{i % 7001}" for i in range(150_000))
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "x y z"), (5, "X Y z"), (None, "a b c d"), (9, long), (8, long + " tail"), (7, None), (7, "q r s")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in run(spark, rows, 3, 85)}
    # Rows of id 5 are one document, so its texts tie 2 and 5 together.
    assert {(i, c) for i, _, c in got} >= {(5, 2), (2, 2), (9, 8), (8, 8), (7, 7)}
    nameless = [r for r in run(spark, rows, 3, 85) if r.doc_id is None]
    assert [(r.n_shingles, r.component_id, r.kept) for r in nameless] == [(2, None, True)]


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (4, "p q r s t u", 3), (4, "p q r s t u", 4), (6, None, 5), (None, "a b c d e f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = near_dedup.without_near_duplicates(df)
    assert got.columns == df.columns
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert ids == [3, 4, 6]
    assert got.where("doc_id is null").count() == 1


def test_empty_table(spark):
    assert run(spark, [], 3, 85) == []


def test_real_documents(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    got = run(spark, rows, 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def pages(share, n=150, size=400, seed=3):
    """Pages of one template that makes up a share of each."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(int(size * share))]
    return [(i, " ".join(template + [f"u{i}x{j}" for j in range(size - len(template))])) for i in range(n)] + [(n + i, " ".join(template[:-40] + [f"v{rng.random()}" for _ in range(size - len(template) + 40)])) for i in range(n)]


@pytest.mark.parametrize("share", [0.86, 0.96])
def test_pages_of_one_template_make_few_pairs(spark, monkeypatch, share):
    """Alike in less than a link calls for: no pairs, though all share most values; and more: links."""
    seen = []
    across = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda *a: seen.append(across(*a)) or seen[-1])
    counted = []
    check = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *a: counted.append(pairs.count()) or check(pairs, *a))
    rows = pages(share)
    got = run(spark, rows, 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))
    assert max(counted) <= 8 * len(rows)


def test_recall_of_texts_larger_than_the_sketch(spark):
    """Pairs just at the threshold and a little above it, of sets eight times the sketch's size."""
    rng = random.Random(12)
    rows, linked = [], []
    for i in range(300):
        base = [f"g{i}w{j}" for j in range(500)]
        other = list(base)
        for j in rng.sample(range(0, 500, 3), rng.randint(10, 16)):
            other[j] = f"g{i}c{j}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        a, b = shingles(rows[-2][1], 3), shingles(rows[-1][1], 3)
        linked.append(100 * len(a & b) >= 85 * len(a | b))
    found = {r.doc_id: r.component_id for r in run(spark, rows, 3, 85)}
    got = [found[2 * i + 1] == 2 * i for i in range(300)]
    recall = sum(g for g, t in zip(got, linked) if t) / sum(linked)
    print(f"recall {recall:.4f} of {sum(linked)} links at and above the threshold")
    assert 50 < sum(linked) < 300 and recall >= 0.99 and not any(g for g, t in zip(got, linked) if not t)


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"file://{tmp_path}")
    got = run(spark, made_up(5), 3, 85)
    assert got and sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["found", "sketches"]


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "a b c d e f g", 1, 2), (1, "a b c d e f g", 1, 2), (2, "a b c d e f g", 3, 4), (None, None, 5, 6), (None, None, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __at int, id int")
    got = near_dedup.without_near_duplicates(df)
    assert got.schema == df.schema and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


@pytest.mark.parametrize("sides,percent,at_once", [(False, 60, 1 << 20), (True, 60, 1 << 20), (False, 80, 40), (True, 50, 40)])
def test_spanning_links_tie_what_all_links_tie(monkeypatch, sides, percent, at_once):
    monkeypatch.setattr(near_dedup, "ENTRIES_AT_ONCE", at_once)
    rng = np.random.default_rng(percent + sides)
    for rows in (2, 3, 40, 90):
        core = rng.choice(1000, 20, replace=False)
        sets = [np.unique(np.concatenate([core[rng.random(20) > 0.15], rng.choice(60, rng.integers(1, 7))])) for _ in range(rows)]
        label, side = rng.integers(0, max(2, rows // 2), rows), rng.integers(0, 2, rows)
        got = near_dedup.spanning_links(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), label, side if sides else None, percent)
        linked = [(i, j) for i in range(rows) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])) and not (sides and side[i] == side[j])]
        assert {(max(x), min(x)) for x in got} <= set(linked)

        def parts(links):
            part = label.copy()
            for i, j in links:
                part[part == part[i]] = part[j]
            return [[x == y for y in part] for x in part]

        assert parts(got) == parts(linked) and len(got) < len(set(label.tolist()))


@pytest.mark.parametrize("block", [1 << 20, 4000])
def test_a_crowd_of_near_misses_makes_no_pairs(spark, monkeypatch, block):
    """Copies of one text of which many have few edits in common: links are found, but pairs are no rows."""
    monkeypatch.setattr(near_dedup, "BLOCK_VALUES", block, raising=False)
    counted, check = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *a: counted.append(pairs.count()) or check(pairs, *a))
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        gone = set(rng.sample(range(0, 200, 4), rng.choice([0, 3, 6, 9, 10, 12])))
        rows.append((i, " ".join(w for j, w in enumerate(base) if j not in gone)))
    got = run(spark, rows, 5, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 5, 80))
    assert len({r.component_id for r in got}) > 20 and counted[-1] <= len(rows)
