import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import chunking

BODY = """제1장 총칙
제1조(목적) 이 규정은 시험용 예시 본문을 정함을 목적으로 한다.
제2조(정의) 짧다.
제2장 휴학과 복학
제3조의2(휴학) ① 휴학하려는 학생은 신청서를 제출하여야 한다. ② 휴학 기간은 1년을 넘을 수 없다. ③ 그 밖의 사항은 따로 정한다.
부 칙
이 규정은 공포한 날부터 시행한다."""


def chunks(spark, body, **more):
    df = spark.createDataFrame([("r", body)], "id string, body string")
    rows = chunking.chunk(df, **more).collect()
    return [(r.chunk_id, r.article, r.article_title, r.chapter, r.clause, r.text) for r in sorted(rows, key=lambda r: int(r.chunk_id.split("#")[1]))]


def test_articles_chapters_and_appendix(spark):
    got = chunks(spark, BODY)
    assert [x[:5] for x in got] == [("r#0", "제1조", "목적", "제1장 총칙", ""), ("r#1", "제2조", "정의", "제1장 총칙", ""), ("r#2", "제3조의2", "휴학", "제2장 휴학과 복학", ""), ("r#3", "부칙", "", "", "")]
    assert got[1][5] == "제2조(정의) 짧다.\n제2장 휴학과 복학"
    assert got[3][5] == "부 칙\n이 규정은 공포한 날부터 시행한다."


def test_long_articles_are_cut_at_clauses(spark):
    got = chunks(spark, BODY, most=60)
    assert [(x[0], x[1], x[4]) for x in got][2:] == [("r#2", "제3조의2", "제1항"), ("r#3", "제3조의2", "제2항"), ("r#4", "제3조의2", "제3항"), ("r#5", "부칙", "")]
    assert got[2][5].startswith("제3조의2(휴학) ① 휴학") and got[3][5].startswith("② 휴학")


@pytest.mark.parametrize(
    "body,want",
    [
        ("제1조(목적) 짧음\n제 12 조의 2 ( 가나 ) 이 조문은 충분히 긴 글이다.", [("r#1", "제12조의2", "가나")]),
        ("이 머리말은 서른 글자를 넘어야 하므로 이렇게 조금 길게 적어 둔다.\n제1조 본문이 열다섯 글자를 넘는다.", [("r#0", "머리말", ""), ("r#1", "제1조", "")]),
        ("조문이 없는 규정의 본문은 전문으로 묶는다.", [("r#0", "전문", "")]),
        ("제1조(목적) 열다섯 글자를 넘는 본문이다.\n[별표 1]\n표의 내용이 여기에 이어진다.\n별 지 서식의 내용이 여기에 이어진다.", [("r#0", "제1조", "목적"), ("r#1", "별표", ""), ("r#2", "별지", "")]),
        ("제1조(목적) 열다섯 글자를 넘는 본문이다.\n부칙\n제1조(시행일) 공포한 날부터 시행한다.", [("r#0", "제1조", "목적"), ("r#1", "부칙", "")]),
        ("", []), (None, []),
    ],
)
def test_other_forms(spark, body, want):
    assert [x[:3] for x in chunks(spark, body)] == want


def packed(text, most):
    out, buf = [], ""
    for p in text.split("\n"):
        if buf and len(buf) + len(p) > most:
            out.append(buf.strip())
            buf = p
        else:
            buf = f"{buf}\n{p}" if buf else p
    return out + [buf.strip()] * bool(buf.strip())


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab가 ", max_size=30), max_size=12), st.integers(5, 40))
def test_packing_of_paragraphs(spark, paras, most):
    from pyspark.sql import functions as F

    text = "\n".join(paras)
    got = spark.createDataFrame([(text,)], "t string").select(chunking.packed_paragraphs(F.col("t"), most).alias("x")).first().x
    assert got == packed(text, most)


def test_the_newline_between_is_not_counted(spark):
    assert [x[5] for x in chunks(spark, "a" * 450 + "\n" + "b" * 450)] == ["a" * 450 + "\n" + "b" * 450]
    assert [len(x[5]) for x in chunks(spark, "a" * 450 + "\n" + "b" * 451)] == [450, 451]


def test_chunks_of_an_article_make_it_up(spark):
    body = "제1조(가) " + " ".join(f"{c} " + "본문 " * 60 for c in "①②③④") + "\n제2조(나) " + "문장이다. " * 20
    text = "".join(x[5] for x in chunks(spark, body))
    assert re.sub(r"\s", "", text) == re.sub(r"\s", "", body)


def test_partial_refresh_is_a_full_one(spark):
    old = spark.createDataFrame([("a", BODY), ("b", BODY)], "id string, body string")
    new = spark.createDataFrame([("b", BODY + "\n제9조 고쳐진 조문이 여기에 있다.")], "id string, body string")
    full = chunking.chunk(old.where("id = 'a'").union(new))
    part = chunking.refreshed(chunking.chunk(old), chunking.chunk(new))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, part.select(full.columns).collect()))


def test_report_has_failures(spark):
    regs = spark.createDataFrame([("a", BODY), ("c", "")], "id string, body string")
    assert {r.reg_id: r.n_chunks for r in chunking.report(chunking.chunk(regs), regs).collect()} == {"a": 4, "c": 0}


def test_body_after_the_header(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("규정명: x\n" + "=" * 40 + "\n본문 \n",), (" 머리 없음 ",)], "t string")
    assert [r.b for r in df.select(chunking.body_of(F.col("t")).alias("b")).collect()] == ["본문", "머리 없음"]


def test_labels_of_any_length(spark):
    """Labels, titles and appendix marks with more blanks than any prefix would hold."""
    body = "제" + " " * 300 + "7" + " " * 300 + "조(목적) 이 규정은 예시 본문이다. 충분히 길다.\n부" + " " * 200 + "칙 이 규정은 공포한 날부터 시행한다."
    rows = chunking.chunk(spark.createDataFrame([("r", body)], "id string, body string"), carry=[]).collect()
    assert [(r.article, r.article_title) for r in rows] == [("제7조", "목적"), ("부칙", "")]
