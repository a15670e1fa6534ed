"""Inverted lists with block bounds against the scores of all documents."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import keyword, postings


def corpus(spark, seed, n, parts=3):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    rows = [(f"d{i:04d}", " ".join(word() for _ in range(rng.choice([0, 3, 30, 200])))) for i in range(n)] + [("none", None), ("twin1", "w1 w2 w7"), ("twin2", "w1 w2 w7")]
    asked = [(q, " ".join(word() for _ in range(rng.choice([1, 2, 5, 25])))) for q in range(30)] + [(98, "nowhere"), (99, "w1 w1 w7"), (100, None)]
    return spark.createDataFrame(rows, "doc_id string, text string").repartition(parts), spark.createDataFrame(asked, "qid long, text string")


def best(found, k):
    order = Window.partitionBy("qid").orderBy(F.round("keyword", 9).desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return sorted((r.qid, r["rank"], r.doc_id, round(r.keyword, 7)) for r in ranked.collect())


@pytest.mark.parametrize("shard, width", [(1 << 16, 64), (50, 4)])
def test_equal_to_the_scores_of_all(spark, monkeypatch, tmp_path, shard, width):
    monkeypatch.setattr(postings, "SHARD_DOCS", shard)
    monkeypatch.setattr(postings, "ROWS", min(shard, postings.ROWS))
    monkeypatch.setattr(postings, "RANGE", width)
    docs, asked = corpus(spark, shard, 400)
    index = keyword.build(docs)
    lists = postings.build(index, str(tmp_path / "lists"))
    all_ = keyword.scores(index, asked)
    assert lists.lists.select("shard").distinct().count() >= (9 if shard == 50 else 3)
    for k in (1, 7):
        found = postings.topk(postings.read(spark, str(tmp_path / "lists")), asked, k)
        assert sorted((r.qid, r["rank"], r.doc_id, round(r.keyword, 7)) for r in found.collect()) == best(all_, k)
    pairs = lambda df: sorted((r.qid, r.doc_id, round(r.keyword, 7)) for r in df.collect())
    assert pairs(postings.scores(lists, asked)) == pairs(all_)


def test_reads_few_postings_and_only_the_buckets_asked_for(spark):
    rng = random.Random(1)
    common, rare = [f"c{i}" for i in range(5)], [f"r{i}" for i in range(300)]
    rows = [(i, " ".join(common + [rng.choice(rare) for _ in range(3)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(q, " ".join([*common, rare[q], rare[q + 1]])) for q in range(40)], "qid long, text string")
    index = keyword.build(docs.repartition(1))
    lists = postings.build(index)
    every = index.frequencies.agg(F.sum("df")).first()[0]
    counts = postings.read_counts(lists, asked, 10).collect()
    assert len(counts) == 40 and all(r.postings_read < r.postings_asked / 20 for r in counts)
    assert max(r.postings_asked for r in counts) < every
    assert best(postings.topk(lists, asked, 10), 10) == best(keyword.scores(index, asked), 10)
    one = postings._searched(lists, asked.where("qid = 3").withColumn("text", F.lit("r3")), 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_many_questions_take_passes(spark, monkeypatch):
    docs, asked = corpus(spark, 5, 100)
    index = keyword.build(docs)
    lists = postings.build(index)
    whole = best(postings.topk(lists, asked, 4), 4)
    monkeypatch.setattr(keyword, "MOST_TERMS", 20)
    assert best(postings.topk(lists, asked, 4), 4) == whole


def test_no_documents_and_no_questions(spark):
    docs, asked = corpus(spark, 7, 20)
    none = postings.build(keyword.build(docs.limit(0)))
    assert postings.topk(none, asked, 5).count() == 0
    assert postings.topk(postings.build(keyword.build(docs)), asked.limit(0), 5).count() == 0


def test_matrices_of_weights_are_bounded(monkeypatch):
    import pyarrow as pa

    rows = [(q, f"t{q}-{i}", 1.0) for q in range(64) for i in range(50)]
    known = pa.table({"qid": [r[0] for r in rows], "term": [r[1] for r in rows], "w": [r[2] for r in rows]})
    whole = keyword._blocks(known)
    assert len(whole) == 1 and whole[0][2].nbytes == 64 * 50 * 64 * 8
    monkeypatch.setattr(keyword, "MATRIX_BYTES", 200_000)
    parts = keyword._blocks(known)
    assert sum(b[2].nbytes for b in parts) <= 200_000 and sum((b[2] != 0).sum() for b in parts) == len(rows)


def test_shards_end_within_a_batch(spark, monkeypatch):
    monkeypatch.setattr(postings, "SHARD_POSTINGS", 640)
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j}" for j in range(10))) for i in range(1000)], "doc_id long, text string").coalesce(1)
    index = keyword.build(docs)
    lists = postings.build(index._replace(forward=index.forward.coalesce(1)))
    assert lists.lists.where("term is not null").groupBy("shard").agg(F.sum(F.size("docs")).alias("n")).agg(F.max("n")).first()[0] == 640
