import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=13):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for d, text in docs:
        w, found = words(text), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                if k in windows:
                    found |= windows[k]
                    hit[p : p + n] = [True] * n
        out.append((d, len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then sleeps for a whole day under trees"), (2, "one two three"), (10, "One, two THREE!"), (3, ""), (4, None), (5, "été"), (6, "quick brown fox jumps over the lazy dog and then sleeps for a whole")]
DOCS = [
    (1, "the QUICK brown fox; jumps over the lazy dog and then sleeps for a nap"), (2, "x " * 60 + "one two three"), (3, "x " * 10 + "one-two-three one two"), (4, ""), (5, None), (6, "été ETÉ"),
    (7, "sleeps for a whole day under trees"), (7, "sleeps for a whole day under trees"), (8, "a b c " * 9000 + " ".join(ITEMS[0][1].split()[2:])),
]


def report(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("extra", F.lit(1))
    got = decontaminate.contamination(df, b, ["doc_id", "n_hit"])
    return sorted((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in got.collect())


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    assert report(spark, DOCS, ITEMS) == sorted(brute(DOCS, ITEMS))


def test_real_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()]
    assert report(spark, docs, items) == sorted(brute(docs, items))


def test_empty_tables(spark):
    assert report(spark, [], ITEMS) == []
    assert report(spark, DOCS[:1], []) == [(1, 15, 0, [], False)]


def test_clean_rows_keep_all_their_columns(spark):
    df = spark.createDataFrame([(*d, "a") for d in DOCS], "doc_id long, text string, contaminated string")
    got = decontaminate.decontaminate(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert got.schema == df.schema
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _, _, _, bad in brute(DOCS, ITEMS) if not bad)


def plain_matches(docs, items, width=13):
    """Every maximal match, by comparing word by word from all pairs of places."""
    out = []
    for d, text in docs:
        for i, other in items:
            a, b = words(text), words(other)
            n = min(width, len(b))
            for p in range(len(a)):
                for q in range(len(b)):
                    if n and a[p] == b[q] and (not p or not q or a[p - 1] != b[q - 1]):
                        k = 0
                        while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k]:
                            k += 1
                        if k >= n:
                            out.append((d, None if i is None else str(i), p, q, k))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,gathered,at_once", [(1 << 22, 16, 1 << 18), (40, 2, 1), (90, 1, 7)])
def test_matches_as_by_comparing_words(spark, monkeypatch, block, gathered, at_once):
    for name, value in (("BLOCK_BYTES", block), ("GATHERED", gathered), ("AT_ONCE", at_once), ("SHARD_BYTES", 200)):
        monkeypatch.setattr(decontaminate, name, value)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(25)] + [(None, text(20)), (3, text(15)), (4, None)]
    parts = [t for _, t in items if t]
    docs = [(i, " z ".join(rng.choice(parts) if rng.random() < 0.5 else text(rng.randint(0, 40)) for _ in range(3))) for i in range(40)] + [(50, None), (51, "")]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, b).collect()
    want = plain_matches(docs, items)
    assert sorted(((r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in got), key=str) == want
    top = {d: max(((n, -p) for x, _, p, _, n in want if x == d), default=(0, None)) for d, _ in docs}
    rows = decontaminate.contamination(df, b, ["doc_id"]).collect()
    assert {r.doc_id: (r.longest, r.longest_at) for r in rows} == {d: (n, None if p is None else -p) for d, (n, p) in top.items()}
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in rows) == sorted((d, n, h, [x for x in found if x != "None"], bad) for d, n, h, found, bad in brute(docs, items))


def test_long_text_and_repeated_items(spark):
    words_ = [f"w{i}" for i in range(200_000)]
    items = [(7, " ".join(words_[150_000:150_040]))] * 2 + [(8, " ".join(words_[:20])), (9, " ".join(words_[:20]))]
    docs = spark.createDataFrame([(1, " ".join(words_))] * 2, "doc_id long, text string")
    rows = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated, r.longest, r.longest_at) for r in rows] == [(200_000, 60, ["7", "8", "9"], False, 40, 150_000)] * 2


def test_longest_matches_and_their_places(spark):
    got = decontaminate.matches(spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in got}
    assert (1, "1", 0, 0, 14) in found and (8, "1", 27000, 2, 16) in found and (2, "2", 60, 0, 3) in found and (2, "10", 60, 0, 3) in found
    assert (1, "6", 0, 0, 13) not in found and (1, "6", 1, 0, 13) in found


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_items_without_an_id_are_searched(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [*ITEMS, (None, "seven words that no other item has")]
    docs = [*DOCS, (9, "seven words that no other item has"), (10, "x seven words that no other item has one two three")]
    got = {r[0]: r for r in report(spark, docs, items)}
    assert got[9] == (9, 7, 7, [], True) and got[10] == (10, 11, 10, ["10", "2"], True)
    left = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert not {9, 10} & {r.doc_id for r in left.collect()}
