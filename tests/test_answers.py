import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.operators import analytics, answers
from tessera.plans import answer as plan

RESULTS = [(1, 1, "c1", "학사관리 규정", "제31조", "휴학", "발췌", 0.91), (1, 2, "c9", "장학 규정", "제2조 제1항", "", "발췌만", 0.5), (2, 1, "c1", "학사관리 규정", "제31조", "휴학", "발췌", 0.4)]
FIELDS = "qid int, rank int, chunk_id string, name string, location string, article_title string, snippet string, score double"


@pytest.fixture
def found(spark):
    return spark.createDataFrame(RESULTS, FIELDS), spark.createDataFrame([("c1", "휴학은 20일 전에 신청한다.")], "chunk_id string, text string"), spark.createDataFrame([(1, "휴학?"), (2, "날씨"), (3, "없음")], "qid int, text string")


def test_context_gate_and_sources(found):
    results, chunks, queries = found
    assert {r.qid: r.context for r in answers.context(results, chunks).collect()}[1] == "[학사관리 규정] 제31조(휴학): 휴학은 20일 전에 신청한다.\n[장학 규정] 제2조 제1항: 발췌만"
    assert {r.qid: r.found for r in answers.gated(queries, results).collect()} == {1: True, 2: False, 3: False}
    assert {r.qid: r.sources for r in answers.sources_block(results).collect()}[1] == "- 학사관리 규정 제31조\n- 장학 규정 제2조 제1항"


@pytest.mark.parametrize(
    "answer,context,want",
    [
        ("약 2주 전", "2분의 1", []), ("30일", "20일", ["30"]), ("문장 [근거 조항] 99", "", []), ("10 9 007 7", "7", ["007", "9", "10"]),
        ("3.5점", "3", ["5"]), ("1 ⚠️ 2", "", ["1"]), ("", "", []), ("5 5", "", ["5"]),
    ],
)
def test_foreign_numbers(spark, answer, context, want):
    got = spark.createDataFrame([(answer, context)], "a string, c string").select(answers.foreign_numbers("a", "c").alias("x")).first().x
    assert sorted(got, key=int) == sorted(want, key=int) and got == want


def test_mentions(spark):
    names = ["장학금 규정", "대학원 장학금 규정", "학사관리 규정"]
    get = lambda t: spark.createDataFrame([(t,)], "a string").select(answers.mentioned("a", names).alias("x")).first().x
    assert get("대학원 장학금 규정에 따른다") == ["대학원 장학금 규정"]
    assert get("대학원 장학금 규정과 장학금 규정") == ["대학원 장학금 규정", "장학금 규정"]
    assert get("없음") == []


def test_final_answers_carry_sources_and_warnings(spark):
    rows = [(1, "장학금 규정 제3조에 따라 30일 ", "20일", "- 학사관리 규정 제1조", ["학사관리 규정"]), (2, "답\n- 가 규정 제1조", "1", "- 가 규정 제1조", ["가 규정"])]
    df = spark.createDataFrame(rows, "qid int, generated string, context string, sources string, related_regulations array<string>")
    got = {r.qid: r.answer for r in answers.finalised(df, ["장학금 규정", "학사관리 규정"]).collect()}
    assert got[2] == rows[1][1]
    assert got[1].startswith("장학금 규정 제3조에 따라 30일\n\n[근거 조항]\n- 학사관리 규정 제1조")
    assert C.CITATION_WARNING.format(names="장학금 규정") in got[1] and got[1].endswith(C.NUMBER_WARNING.format(numbers="3, 30"))


@pytest.mark.parametrize(
    "query,before,want",
    [
        ("그럼 복학은?", "휴학은 어떻게 해?", "복학"), ("기간은?", "휴학은 언제까지 가능해?", "휴학 기간"), ("그건 언제까지?", "휴학은?", "휴학은? 그건 언제까지?"),
        ("복학은?", "", "복학은?"), ("복학은?", None, "복학은?"), ("이것은 열여섯 글자보다 훨씬 긴 질문입니다", "휴학", "이것은 열여섯 글자보다 훨씬 긴 질문입니다"),
    ],
)
def test_follow_up_rewriting(spark, query, before, want):
    assert spark.createDataFrame([(query, before)], "q string, p string").select(answers.rewritten_follow_up("q", "p").alias("x")).first().x == want


def test_rewritings_of_models(spark):
    rows = [("휴학하려면 어떻게 해?", '"휴학 신청 절차"', "", "휴학 신청 절차"), ("휴학하려면", "N/A", "", None), ("휴학하려면", "n/a 없음", "", None), ("휴학하려면", "", "", None), ("휴학하려면", None, "", None), ("휴학하려면", "휴학" * 41, "", None), ("휴학하려면", "전과 절차", "", None), ("그럼?", "휴학 기간", "휴학은?", "휴학 기간"), ("?", "아무 말", "", "아무 말")]
    df = spark.createDataFrame(rows, "q string, r string, p string, want string")
    got = df.select("q", "want", answers.accepted_rewrite("q", "r", F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == [r.want or r.q for r in got]


def test_history(spark):
    turns = [{"question": "가", "answer": "x"}, {"question": " 나 ", "answer": "답 [근거 조항]\n- z"}, {"question": "", "answer": "y"}, {"question": "다" * 400, "answer": None}]
    df = spark.createDataFrame([(turns,), ([],), (None,)], "h array<struct<question:string,answer:string>>")
    got = [[tuple(t) for t in r.x] for r in df.select(answers.recent_history(F.col("h"), 3).alias("x")).collect()]
    assert got == [[("나", "답"), ("다" * 300, "")], [], []]


def test_follow_up_questions(spark):
    chunks = spark.createDataFrame(
        [("a", "r", "제1장", 1, "휴학", "제1조"), ("b", "r", "제1장", 2, "복학시기", "제2조"), ("c", "r", "제1장", 3, "정의", "제3조"), ("d", "r", "제1장", 4, "재입학", "제4조"), ("e", "r", "제2장", 5, "전과", "제5조"), ("f", "r", "제1장", 6, "서식", "별표"), ("g", "r", "제1장", 7, "제적", "제7조"), ("h", "r", "제1장", 8, "복학시기", "제8조"), ("i", "r", "제1장", 9, "등록", "제9조")],
        "chunk_id string, reg_id string, chapter string, pos int, article_title string, article string",
    )
    results = spark.createDataFrame([(1, 1, "a", "휴학"), (1, 2, "e", "전과"), (1, 3, "g", "")], "qid int, rank int, chunk_id string, article_title string")
    got = answers.follow_ups(results, chunks, spark.createDataFrame([(1, "재입학 안내")], "qid int, text string")).orderBy("at").collect()
    assert [r.question for r in got] == ["복학시기는 어떻게 되나요?", "제적은 어떻게 되나요?", "등록은 어떻게 되나요?"]


def test_answers_end_to_end(found):
    results, chunks, queries = found
    prompted = plan.prompts(queries.withColumn("history", F.array(F.struct(F.lit("앞 질문").alias("question"), F.lit("앞 답").alias("answer")))), results, chunks)
    one = {r.qid: r.prompt for r in prompted.collect()}[1]
    assert one.startswith("[이전 대화]\nQ: 앞 질문\nA: 앞 답\n\n[참고자료]\n[학사관리 규정]") and one.endswith("[질문]\n휴학?")
    got = {r.qid: r for r in plan.answer(prompted, lambda p: pd.Series(["20일 전에 낸다."] * len(p)), ["학사관리 규정"]).collect()}
    assert got[1].status == "answered" and "- 학사관리 규정 제31조" in got[1].answer and got[1].foreign_numbers == []
    assert got[2].answer == C.NOT_FOUND and got[2].status == got[3].status == "refused" and not got[3].used_llm
    failed = plan.answer(prompted, lambda p: pd.Series([None] * len(p), dtype=object), []).where("qid = 1").first()
    assert (failed.status, failed.reason) == ("fallback_no_llm", "failed") and not failed.used_llm and failed.answer.startswith("[생성 불가: no answer]\n\n- ")


class Stub:
    """A backend without a model."""

    def __init__(self, there=True):
        self.there = there

    def is_available(self):
        return self.there

    def generate(self, system, prompt):
        if "장학" in prompt:
            raise RuntimeError("out of memory")
        return "20일 전에 낸다."

    def generate_stream(self, system, prompt):
        yield "20일 "
        yield self.generate(system, prompt)


def test_backends(spark):
    rows = [(1, "휴학?", True, "20일", "- 가 제1조"), (2, "장학?", True, "", "- 나 제2조"), (3, "날씨", False, "", "")]
    prompted = spark.createDataFrame([(*r, ["가"], r[1]) for r in rows], "qid int, text string, found boolean, context string, sources string, related_regulations array<string>, prompt string")
    got = {r.qid: r for r in plan.answer(prompted, Stub(), []).collect()}
    assert {q: (r.status, r.reason, r.used_llm, r.error) for q, r in got.items()} == {1: ("answered", "", True, ""), 2: ("fallback_no_llm", "failed", False, "out of memory"), 3: ("refused", "", False, "")}
    assert got[2].answer == "[생성 불가: out of memory]\n\n- 나 제2조"
    none = {r.qid: r for r in plan.answer(prompted, Stub(False), []).collect()}
    assert {q: r.reason for q, r in none.items()} == {1: "unavailable", 2: "unavailable", 3: ""} and plan.UNAVAILABLE in none[1].answer
    stream = lambda q, b: "".join(plan.answer_stream(prompted.where(F.col("qid") == q).first().asDict(), b))
    assert stream(1, Stub()) == "20일 20일 전에 낸다." and stream(3, Stub()) == C.NOT_FOUND
    assert stream(2, Stub()).endswith("[생성 불가: out of memory]\n\n- 나 제2조") and stream(1, Stub(False)).startswith("[생성 불가: " + plan.UNAVAILABLE)


def test_popular(spark):
    rows = [("휴학?", "answered", 2), (" 휴학 ", "answered", 1), ("복학 시기", "answered", 3), ("복학  시기.", "answered", 4), ("테스트", "answered", 5), ("테스트", "answered", 6), ("전과", "refused", 7), ("전과", "answered", 8), ("a", "answered", 9), ("a", "answered", 9), ("x" * 41, "answered", 1), ("x" * 41, "answered", 1), (None, "answered", 1)]
    df = spark.createDataFrame(rows, "question string, status string, timestamp long")
    got = [(r["query"], r.n) for r in analytics.popular(df, 5).collect()]
    assert got == [("휴학", 2), ("복학 시기", 2), ("복학", 0), ("장학금", 0), ("등록금", 0)]


def test_logs_contacts_and_catalogue(spark):
    log = spark.createDataFrame([("local", "answered", 10.0), ("external_api", "refused", 20.0), (None, None, None), ("external_api", "answered", 30.0)], "backend string, status string, took_ms double")
    got = {(r.kind, r.key): r.n for r in analytics.log_summary(log).collect()}
    assert got == {("total", ""): 4, ("backend", "local"): 1, ("backend", "external_api"): 2, ("backend", "unknown"): 1, ("status", "answered"): 2, ("status", "refused"): 1, ("status", "unknown"): 1}
    cost = analytics.estimated_cost(log).first()
    assert (cost.calls, cost.cost) == (2, pytest.approx(0.002))
    regs = spark.createDataFrame([("대학", "과", "1", "가", 1), ("대학", "과", "1", "나", 2), ("대학", "과", "1", "다", 3), ("대학", "과", "1", "라", 4), ("대학", None, "1", "마", 5)], "source string, department string, contact string, name string, i int")
    got = {r.department: (r.n, r.names) for r in analytics.contact_groups(regs, ["source", "department", "contact"], "name", "i").collect()}
    assert got == {"과": (4, "가, 나, 다 외"), None: (1, "마")}
    chunks = spark.createDataFrame([("대학", "지침", "a"), ("대학", "학칙", "b"), ("산학협력단", "제10편 가", "c"), ("산학협력단", "제2편 나", "c")], "source string, category string, reg_id string")
    assert {r.source: r.categories for r in analytics.categories_by_source(chunks).collect()} == {"대학": ["학칙", "지침"], "산학협력단": ["제2편 나", "제10편 가"]}
    assert [r.category for r in analytics.ordered_categories(chunks).orderBy("at").collect()] == ["학칙", "지침", "제2편 나", "제10편 가"]
    assert tuple(analytics.catalogue(chunks).first()) == (4, 3, 2, 4)


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "휴학 규정", "ABC"), (1, 6, "복학", ""), (2, 1, "x", None)], "qid int, rank int, name string, snippet string")
    cases = spark.createDataFrame([(1, ["abc"]), (2, ["복학"]), (3, ["y"]), (4, [])], "qid int, expects array<string>")
    hits = analytics.hits(results, cases, ["name", "snippet"])
    assert {r.qid: r.hit for r in hits.collect()} == {1: True, 2: False, 3: False, 4: True}
    assert tuple(analytics.hit_rate(hits).first()) == (4, 2, 0.5)
    rows = [("cite", True, "답 [자동 검증 경고]", True, True, ["3"]), ("cite", True, C.NOT_FOUND, True, True, []), ("refuse_soft", True, f"{C.NOT_FOUND} 참고", True, True, []), ("refuse_hard", True, C.NOT_FOUND, False, False, []), ("refuse_hard", True, "답", True, True, [])]
    df = spark.createDataFrame(rows, "expect_type string, hit boolean, answer string, used_llm boolean, found boolean, foreign_numbers array<string>")
    assert tuple(analytics.answer_report(analytics.answer_verdicts(df)).first()) == (5, 3, 1, 1)
