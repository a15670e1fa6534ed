import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixture


def dealt(votes, seats, caps):
    """Seats one by one to the highest quotient."""
    out = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def test_seats_as_dealt_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        votes, caps = [rng.choice([0, 1, 1, 5, rng.randint(1, 1000)]) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
        seats = rng.randint(0, 120)
        assert mixture.sainte_lague(np.array(votes), seats, np.array(caps)).tolist() == dealt(votes, seats, caps)


def test_many_seats_are_no_work():
    got = mixture.sainte_lague(np.array([3.0, 1.0]), 4_000_000_000, np.array([1 << 40, 1 << 40]))
    assert got.tolist() == [3_000_000_000, 1_000_000_000]


def test_targets_share_the_excess_by_weight():
    assert mixture.target_sizes([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    got = mixture.target_sizes([10, 1000, 10], [1, 2, 3])
    assert got[2] == 30 and got[0] == 30 and got[1] == pytest.approx(960)
    assert mixture.target_sizes([], []) == [] and mixture.target_sizes([0, 0], [1, 2]) == [0.0, 0.0]


def table(spark, seed=3, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "B", "é", "z", None, ""])
        size = rng.choice([0, 1, 5, 30, 80, 200, 2000 if i % 90 == 0 else 7])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(f"w{rng.randrange(99)}" for _ in range(size)) if size or i % 2 else None, source, 7, "x"))
    rows += rows[:5]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")


def test_words_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SHARD_DOCS", 100)
    docs = table(spark)
    rows = mixture.mixture(docs).collect()
    assert len(rows) == docs.count()
    sizes = {(r.doc_id): len((r.text or "").split()) for r in docs.collect()}
    by = {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 3 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    totals = [sum(r.size for r in by[s]) for s in names]
    for s, t, n in zip(names, mixture.target_sizes(totals, [i % 3 + 1 for i in range(len(names))]), totals, strict=True):
        assert all(r.target == pytest.approx(t) and r.source_size == n for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= max(100, 0.02 * t)


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = table(spark)
    key = lambda df: sorted((r.doc_id, r.size, r.taken) for r in mixture.mixture(df).collect())
    assert key(docs) == key(docs.repartition(7, "text")) != sorted((r.doc_id, r.size, r.taken) for r in mixture.mixture(docs, seed=12).collect())


def test_the_mix_holds_the_words_it_takes(spark):
    docs = table(spark).dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixture.mixture(docs).collect()}
    mixed = mixture.mixed_documents(docs)
    assert mixed.schema == docs.schema
    words = {r.doc_id: r.w for r in mixed.groupBy("doc_id").agg(F.sum(mixture.word_count(F.col("text"))).alias("w")).collect()}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text in texts[r.doc_id] for r in mixed.collect() if r.text)


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture.mixture(empty).count() == 0 and mixture.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixture.mixture(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def plain_mix(rows, seed=11):
    """taken by (id, size), with documents dealt, seats given and blocks chosen one by one, in plain Python but
    for the hashes, which ``rows`` (id, source, size, shard hash, order hash) bring along."""
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(r[2] for r in rows if r[1] == s) for s in names]
    targets = mixture.target_sizes(totals, [i % 3 + 1 for i in range(len(names))])
    shards, n_blocks = {}, []
    for i, s in enumerate(names):
        own = [r for r in rows if r[1] == s]
        many = max(1, -(-len(own) // mixture.SHARD_DOCS))
        for r in own:
            shards.setdefault((i, r[3] % many), []).append(r)
        n_blocks.append(0)
    size = {k: sum(r[2] for r in v) for k, v in shards.items()}
    blocks = {k: max(1, round(v / mixture.BLOCK)) if v else 0 for k, v in size.items()}
    for (i, _), n in blocks.items():
        n_blocks[i] += n
    votes = [t * n / s if s else 0.0 for t, n, s in zip(targets, n_blocks, totals)]
    seats = dealt(votes, round(sum(votes)), [3 * n for n in n_blocks])
    taken = {}
    for i, n in enumerate(seats):
        keys = sorted(k for k in shards if k[0] == i)
        for k, q in zip(keys, dealt([size[k] for k in keys], n, [3 * blocks[k] for k in keys])):
            first = zlib.crc32(f"{seed}/{k[0]}/{k[1]}".encode()) % blocks[k] if blocks[k] else 0
            times = [q // blocks[k] + (((b - first) % blocks[k]) < q % blocks[k]) for b in range(blocks[k])] if blocks[k] else []
            edge = [b * size[k] // blocks[k] for b in range(blocks[k] + 1)] if blocks[k] else [0]
            of_word = [times[b] for b in range(blocks[k]) for _ in range(edge[b + 1] - edge[b])]
            at = 0
            for r in sorted(shards[k], key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[2])):
                taken.setdefault((r[0], r[2]), []).append(sum(of_word[at : at + r[2]]))
                at += r[2]
    return {k: sorted(v) for k, v in taken.items()}


def test_what_is_taken_as_by_dealing_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SHARD_DOCS", 60)
    docs = table(spark, seed=8, n=400)
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))))
    keyed = docs.select("doc_id", "source", count.cast("bigint").alias("n"))
    rows = [tuple(r) for r in keyed.select("doc_id", "source", "n", F.xxhash64(F.lit(11), "doc_id", "n"), F.xxhash64(F.lit(12), "doc_id")).collect()]
    got = {}
    for r in mixture.mixture(docs).collect():
        got.setdefault((r.doc_id, r.size), []).append(r.taken)
    assert {k: sorted(v) for k, v in got.items()} == plain_mix(rows)


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, long, "a", 1, 2, "x"), (2, "b c d", None, 3, 4, "y"), (None, "e f", "b", 5, 6, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, c0 int, __id string")
    mixed = mixture.mixed_documents(df)
    assert mixed.schema == df.schema
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixture.word_count(F.col("text"))).alias("n")).collect()}
    taken = {r.doc_id: r.taken for r in mixture.mixture(df).collect()}
    assert {k: v for k, v in taken.items() if v} == words and {(r["__size"], r.c0, r["__id"]) for r in mixed.collect()} <= {r[3:] for r in rows}


@pytest.mark.parametrize("seed", [3, 4])
def test_many_sources_are_mixed_alike(spark, monkeypatch, seed):
    """Without the driver's tables of sources, by sums alone: the same targets and the same mix."""
    monkeypatch.setattr(mixture, "SHARD_DOCS", 100)
    docs = table(spark, seed=seed, n=700).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("host"), (F.col("doc_id") % 40).cast("string"))).otherwise(F.col("source")))
    key = lambda: sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixture.mixture(docs).collect()), key=str)
    few = key()
    monkeypatch.setattr(mixture, "MOST_SOURCES", 0)
    assert key() == few
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixture.mixture(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixture.mixture(docs.limit(0)).count() == 0


def test_equal_sources_share_what_is_left_in_order(spark, monkeypatch):
    rows = [(i, "w " * 96, f"s{i:03d}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda: sorted((r.doc_id, r.taken) for r in mixture.mixture(docs).collect())
    few = key()
    monkeypatch.setattr(mixture, "MOST_SOURCES", 0)
    assert key() == few
