import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import keyword, ranking, vector
from tessera.plans import search

DOCS = [(0, "휴학 신청 휴학"), (1, "등록금 반환 기준"), (2, "복학 휴학 신청 절차 안내"), (3, ""), (4, None), (5, "등록금 등록금의 반환")]


def bm25(docs, query, k1=1.5, b=0.75):
    import re

    tok = lambda t: [w for w in re.findall("[0-9a-z가-힣]+", (t or "").lower()) if len(w) > 1 or w.isdigit()]
    toks = [tok(t) for _, t in docs]
    mean = sum(map(len, toks)) / len(toks)
    df = Counter(w for t in toks for w in set(t))
    out = {}
    for (i, _), t in zip(docs, toks):
        tf, s = Counter(t), 0.0
        for w in tok(query):
            if tf[w]:
                s += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean))
        if s:
            out[i] = s
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_keyword_scores(spark, monkeypatch, most):
    monkeypatch.setattr(keyword, "MOST_TERMS", most)
    docs = spark.createDataFrame([(i, t or "") for i, t in DOCS], "doc_id long, text string")
    asked = [(1, "휴학 휴학 신청"), (2, "등록금 환불 등록금 반환 등록금의 반환"), (3, "없는말"), (4, "")]
    got = keyword.scores(docs, spark.createDataFrame(asked, "qid long, text string")).collect()
    for q, text in asked:
        assert {r.doc_id: pytest.approx(r.keyword) for r in got if r.qid == q} == bm25(DOCS, text)


@pytest.mark.parametrize("most", [0, 1000])
def test_the_best_by_keyword_are_cut_where_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(keyword, "MOST_TERMS", most)
    monkeypatch.setattr(keyword, "AT_ONCE", 3)
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["ab", "cd", "ef", "gh"], k=rng.choice([0, 2, 3])))) for i in range(200)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "ab"), (2, "ab cd cd"), (3, "none"), (4, "gh ef")], "qid long, text string")
    index = keyword.build(docs)
    every = sorted((r.qid, -round(r.keyword, 9), r.doc_id) for r in keyword.scores(index, asked).collect())
    want = [(q, d) for q in (1, 2, 4) for _, _, d in [x for x in every if x[0] == q][:5]]
    assert sorted((r.qid, r["rank"], r.doc_id) for r in keyword.topk(index, asked, 5).collect()) == [(q, i % 5 + 1, d) for i, (q, d) in enumerate(want)]
    if most:
        known, _ = keyword.weights(index.frequencies, index.stats, asked)
        assert keyword._met(index.forward, known.toArrow(), 1.5, 0.75, 5).count() <= 3 * 5 * index.forward.rdd.getNumPartitions()


def test_a_stored_index_scores_alike(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "휴학 휴학 신청"), (2, "등록금")], "qid long, text string")
    keyword.write_index(keyword.build(docs), str(tmp_path))
    key = lambda df: sorted((r.qid, r.doc_id, round(r.keyword, 9)) for r in df.collect())
    stored = keyword.read_index(spark, str(tmp_path))
    assert key(keyword.scores(stored, asked)) == key(keyword.scores(docs, asked)) != []
    assert {r.term: r.df for r in stored.frequencies.collect()} == {r.term: r.df for r in keyword.document_frequencies(docs).collect()}
    assert tuple(stored.stats.first()) == (6, sum(r.dl for r in stored.forward.collect()))


def test_terms_are_counted_in_the_row(spark):
    texts = ["", "a b", "bb aa bb 7 7 7 aa bb", None, "하나 둘 하나"]
    got = keyword.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).forward.collect()
    assert {r.doc_id: (r.dl, {t.term: t.tf for t in r.terms}) for r in got} == {0: (0, {}), 1: (0, {}), 2: (8, {"aa": 2, "bb": 3, "7": 3}), 3: (0, {}), 4: (2, {"하나": 2})}


def test_synonyms(spark):
    want = {"자퇴 절차": "자퇴 절차 퇴학 자퇴원", "등록금 환불": "등록금 환불 등록금 반환 등록금의 반환", "퇴학과 자퇴": "퇴학과 자퇴 자퇴원", "휴학": "휴학"}
    got = spark.createDataFrame([(t,) for t in want], "q string").select("q", keyword.expanded_column("q").alias("x")).collect()
    assert {r.q: r.x for r in got} == want


@pytest.mark.parametrize("block", [2048, 3])
def test_nearest_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK", block)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, [float(x) for x in v[i % 50]]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [(q, [float(x) for x in v[q]]) for q in range(7)] + [(50, None)]
    got = vector.nearest(df, spark.createDataFrame(asked, "qid long, vector array<double>"), 5).collect()
    for q in range(7):
        want = sorted((-round(float(v[i % 50] @ v[q]), 9), i) for i in range(60))[:5]
        assert sorted((-round(r.vector, 9), r.id) for r in got if r.qid == q) == want
    assert {r.qid for r in got} == set(range(7))


def test_minmax(spark):
    df = spark.createDataFrame([(1, 0.4), (1, 0.4), (2, 0.0), (2, 0.0), (3, 1.0), (3, 2.0), (3, 5.0)], "qid int, v double")
    got = sorted((r.qid, r.v_scaled) for r in ranking.minmax(df, "v").collect())
    assert got == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.0), (3, 0.0), (3, 0.25), (3, 1.0)]


def test_questions(spark):
    texts = {"휴학": False, "휴학하려면 어떻게 해": True, "휴학?": True, "어떻게 해": False, "가 나 다": False, "전과 신청 되나요": True, " ": False}
    got = spark.createDataFrame([(t,) for t in texts], "q string").select("q", ranking.is_question("q").alias("x")).collect()
    assert {r.q: r.x for r in got} == texts


def test_floor_repeal_and_date(spark):
    v = spark.createDataFrame([(1, "a", 0.43), (1, "b", 0.1), (1, "c", 0.5)], "qid int, chunk_id string, vector double")
    k = spark.createDataFrame([(1, "b", 2.0), (1, "d", 1.0)], "qid int, chunk_id string, keyword double")
    assert {(r.chunk_id, r.vector, r.keyword) for r in ranking.candidates(v, k).collect()} == {("b", 0.1, 2.0), ("c", 0.5, 0.0), ("d", 0.0, 1.0)}
    rows = [("휴학", False, "폐지", ""), ("폐지 규정", False, "폐지", ""), ("휴학", True, "폐지", ""), ("휴학", False, None, "2025-01-01"), ("휴학", False, "현행", "2020-01-01")]
    df = spark.createDataFrame(rows, "text string, include_repealed boolean, status string, enforce_date string")
    df = ranking.query_facts(df)
    assert ranking.in_force(df).count() == 4
    assert ranking.since(df.withColumn("since", F.lit("2024-01-01"))).count() == 1 and ranking.since(df.withColumn("since", F.lit(""))).count() == 5


def test_penalties_stack(spark):
    rows = [("휴학", "대학원 규정", "부칙", 0.68), ("대학원 휴학", "대학원 규정", "부칙", 0.8), ("시행일은?", "대학원 규정", "부칙", 0.85), ("휴학", "사대부설 고등학교 학칙", "제1조", 0.85), ("고교", "부설중학교", "제1조", 1.0), ("휴학", "학칙", "제1조 부칙", 1.0)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "text string, name string, article string, want double, score double")
    assert all(r.score == pytest.approx(r.want) for r in ranking.penalised(ranking.chunk_facts(ranking.query_facts(df))).collect())


def test_duplicates_merge(spark):
    rows = [(1, "a", "가·나 규정", "제1조", None, "대학", 0.9), (1, "b", "가나규정", "제1조", "", "산학", 0.8), (1, "c", "가나 규정", "제1조", "", "산학", 0.7), (1, "d", "가나규정", "제2조", "", "대학", 0.6), (1, "e", "가나규정", "제2조", "", "대학", 0.5)]
    df = spark.createDataFrame(rows, "qid int, chunk_id string, name string, article string, clause string, source string, score double")
    assert {(r.chunk_id, tuple(r.also_sources)) for r in ranking.merged(ranking.chunk_facts(df)).collect()} == {("a", ("산학",)), ("d", ())}


def test_second_model_orders_only_what_is_close(spark):
    rows = [(1, "a", 0.90, 1.0), (1, "b", 0.86, 9.0), (1, "c", 0.84, 99.0), (1, "d", 0.30, None)]
    df = spark.createDataFrame(rows, "qid int, chunk_id string, score double, second_score double").withColumn("top_k", F.lit(3))
    got = sorted((r.rank, r.chunk_id, r.score) for r in ranking.reordered(df).collect())
    assert got == [(1, "b", 0.86), (2, "a", 0.9), (3, "c", 0.84), (4, "d", 0.3)]


def sources(spark, rows, k, free=True):
    df = spark.createDataFrame([(1, f"c{i:03d}", s, i) for i, s in enumerate(rows, 1)], "qid int, chunk_id string, source string, rank int")
    got = ranking.with_sources(df.withColumns({"top_k": F.lit(k), "free": F.lit(free)})).collect()
    return [(r.source, int(r.chunk_id[1:])) for r in sorted(got, key=lambda r: r.rank)]


def test_every_source_gets_its_due(spark):
    two = sources(spark, ["a"] * 12 + ["b"] * 5, 10)
    assert two == [("a", i) for i in range(1, 8)] + [("b", 13), ("b", 14), ("b", 15)]
    assert sources(spark, ["a"] * 12 + ["b"], 10) == [("a", i) for i in range(1, 10)] + [("b", 13)]
    assert len(sources(spark, ["a"] * 12 + ["b"] * 5, 7)) == 7 and {s for s, _ in sources(spark, ["a"] * 12 + ["b"] * 5, 10, False)} == {"a"}
    # No source has more than three to give: the result grows beyond k.
    assert len(sources(spark, ["a"] * 3 + ["b"] * 3 + ["c"] * 3, 8)) == 9
    assert len(sources(spark, [chr(97 + i % 20) for i in range(100)], 10)) == 60


def test_room_for_sources_as_by_taking_turns(spark):
    """Against the rule said step by step: one row in, the last one of a crowded source out."""
    rng = random.Random(6)
    rows, want = [], {}
    for q in range(60):
        order = [rng.choice("aaaabbcde"[: rng.randint(1, 9)]) for _ in range(rng.randint(1, 40))]
        k = rng.randint(6, 14)
        rows += [(q, i, s, i, k) for i, s in enumerate(order, 1)]
        taken = [(s, i) for i, s in enumerate(order, 1) if i <= k]
        have = lambda s: sum(x == s for x, _ in taken)  # noqa: E731, B023
        for s in sorted(set(order)) if k >= 8 else []:
            for i in [i for i, x in enumerate(order, 1) if x == s and i > k]:
                if have(s) < 3:
                    crowded = [x for x in taken if have(x[0]) > 3]
                    taken = [x for x in taken if not crowded or x != crowded[-1]] + [(s, i)]
        want[q] = [i for _, i in taken]
    df = spark.createDataFrame(rows, "qid int, chunk_id int, source string, rank int, top_k int").withColumn("free", F.lit(True))
    got = ranking.with_sources(df).collect()
    assert {q: [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] for q in want} == want


def test_date_order_groups_and_names(spark):
    rows = [(1, "a", "x", "2020-01-01", 0.9, 1), (1, "b", "y", "", 0.8, 2), (1, "c", "x", "2024-01-01", 0.7, 3)]
    df = spark.createDataFrame(rows, "qid int, chunk_id string, name string, enforce_date string, score double, rank int")
    order = lambda s: [r.chunk_id for r in sorted(ranking.by_date(df.withColumn("sort", F.lit(s))).collect(), key=lambda r: r.rank)]
    assert order("date") == ["c", "a", "b"] and order("relevance") == ["a", "b", "c"]
    assert {(r.chunk_id, r.group_rank, r.group_size) for r in ranking.grouped(df).collect()} == {("a", 1, 2), ("c", 1, 2), ("b", 2, 1)}
    assert ranking.related(df).first().related_regulations == ["x", "y"]


CHUNKS = [
    ("r1#0", "r1", "대학", "규정", "학사관리 규정", "제31조", "휴학", "제5장", "", "휴학하려는 학생은 신청서를 낸다."),
    ("r1#1", "r1", "대학", "규정", "학사관리 규정", "제32조", "복학시기", "제5장", "", "복학은 학기 초에 한다."),
    ("r1#2", "r1", "대학", "규정", "학사관리 규정", "부칙", "", "", "", "이 규정은 휴학 규정 공포일부터 시행한다."),
    ("r2#0", "r2", "산학협력단", "제1편 가", "학사 관리 규정", "제31조", "휴학", "제5장", "", "휴학하려는 학생은 신청서를 낸다. 같은 규정"),
    ("r3#0", "r3", "대학", "학칙", "옛 휴학 규정", "제1조", "휴학", "", "", "휴학 휴학 휴학"),
]
FIELDS = "chunk_id string, reg_id string, source string, category string, name string, article string, article_title string, chapter string, clause string, text string"


@pytest.fixture
def corpus(spark):
    chunks = spark.createDataFrame(CHUNKS, FIELDS)
    regs = spark.createDataFrame([("r1", "2025-03-01", "현행"), ("r3", "2001-01-01", "폐지")], "id string, enforce_date string, status string")
    vectors = spark.createDataFrame([("r1#0", [1.0, 0.0]), ("r1#1", [0.6, 0.8]), ("gone#1", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    return chunks, vectors, regs


def test_search_end_to_end(spark, corpus):
    queries = spark.createDataFrame([(1, "휴학", [1.0, 0.0])], "qid int, text string, vector array<double>")
    got = sorted(search.search(queries, *corpus).collect(), key=lambda r: r.rank)
    assert [r.chunk_id for r in got] == ["r1#0", "r1#1", "r1#2"] or {r.chunk_id for r in got} == {"r1#0", "r1#1", "r1#2"}
    first = got[0]
    assert first.chunk_id == "r1#0" and first.also_sources == ["산학협력단"] and first.location == "제31조" and first.status == "현행" and first.score == 1.0 and first.snippet.startswith("휴학")


def test_filters_options_and_reranking(spark, corpus):
    make = lambda rows, more: spark.createDataFrame(rows, "qid int, text string, vector array<double>, " + more)
    only = search.search(make([(1, "휴학", [1.0, 0.0], ["산학협력단"])], "sources array<string>"), *corpus).collect()
    assert [r.chunk_id for r in only] == ["r2#0"]
    repealed = search.search(make([(1, "휴학", None, True)], "include_repealed boolean"), *corpus).collect()
    assert "r3#0" in {r.chunk_id for r in repealed}
    recent = search.search(make([(1, "휴학", [1.0, 0.0], "2024-01-01", "date")], "since string, sort string"), *corpus).collect()
    assert {r.reg_id for r in recent} == {"r1"}
    with pytest.raises(Exception, match="top_k must be"):
        search.search(make([(1, "휴학", [1.0, 0.0], 51)], "top_k int"), *corpus).collect()
    with pytest.raises(Exception, match="since must be"):
        search.search(make([(1, "휴학", [1.0, 0.0], "2024")], "since string"), *corpus).collect()
    second = search.search(make([(1, "휴학", [1.0, 0.0], 5)], "top_k int"), *corpus, reranker=lambda q, t: [float(len(x)) for x in t]).collect()
    assert {r.chunk_id for r in second} == {"r1#0", "r1#1", "r1#2"}


def test_a_second_model_that_fails_leaves_the_order(spark, corpus):
    queries = spark.createDataFrame([(1, "휴학", [1.0, 0.0], 5)], "qid int, text string, vector array<double>, top_k int")
    plain = [r.chunk_id for r in sorted(search.search(queries, *corpus).collect(), key=lambda r: r.rank)]

    def broken(q, t):
        raise RuntimeError("no model here")

    got = [r.chunk_id for r in sorted(search.search(queries, *corpus, reranker=broken).collect(), key=lambda r: r.rank)]
    assert got == plain


def test_search_by_a_stored_index(spark, corpus, tmp_path):
    chunks, vectors, regs = corpus
    keyword.write_index(keyword.build(chunks.select("chunk_id", search.searched_text().alias("text")), "chunk_id"), str(tmp_path))
    queries = spark.createDataFrame([(1, "휴학", [1.0, 0.0])], "qid int, text string, vector array<double>")
    key = lambda df: sorted((r["rank"], r.chunk_id, r.score) for r in df.collect())
    assert key(search.search(queries, chunks, vectors, regs, index=keyword.read_index(spark, str(tmp_path)))) == key(search.search(queries, chunks, vectors, regs))


def test_many_queries_are_one_plan(spark, corpus):
    texts = ["휴학", "복학", "학사관리", "없는말"]
    queries = spark.createDataFrame([(i, t, [1.0, 0.0]) for i, t in enumerate(texts)], "qid int, text string, vector array<double>")
    together = {(r.qid, r.chunk_id): (r.rank, r.score) for r in search.search(queries, *corpus).collect()}
    for i in range(len(texts)):
        alone = {(r.qid, r.chunk_id): (r.rank, r.score) for r in search.search(queries.where(F.col("qid") == i), *corpus).collect()}
        assert alone == {k: v for k, v in together.items() if k[0] == i}


def test_only_rows_that_some_filter_allows_are_scored(spark, corpus, monkeypatch):
    """Same results and statistics; rows of other sources are not scored, unless a query allows all."""
    chunks, vectors, regs = corpus
    scored, scores = [], search.keyword.scores
    monkeypatch.setattr(search.keyword, "scores", lambda index, *a: scored.append(index) or scores(index, *a))
    total = chunks.count()
    names = [r.source for r in chunks.select("source").distinct().orderBy("source").collect()]
    key = lambda df, q: sorted((r["rank"], r.chunk_id, r.score) for r in df.collect() if r.qid == q)
    rows = [(1, "휴학 신청", [1.0, 0.0], [names[0]]), (2, "등록금", [0.0, 1.0], None)]
    asked = spark.createDataFrame(rows, "qid long, text string, vector array<double>, sources array<string>")
    both = search.search(asked, chunks, vectors, regs)
    one = search.search(asked.where("qid = 1"), chunks, vectors, regs)
    assert key(one, 1) == key(both, 1) != []
    assert [i.forward.count() for i in scored] == [total, chunks.where(F.col("source") == names[0]).count()]
    assert scored[1].forward.count() < total and [i.stats.first().n for i in scored] == [total, total]


def test_cache():
    cache, made = search.ResultCache(2), []
    make = lambda k: cache.get(k, lambda: made.append(k) or [k])
    assert make("a") == (["a"], False) and make("a") == (["a"], True)
    make("b"), make("c")
    assert make("a") == (["a"], False) and made == ["a", "b", "c", "a"]
