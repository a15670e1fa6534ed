import difflib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.plans import refresh
from tessera.sources import boards, files, rulebook, tables
from tessera.streaming import logs


def test_board_rows(spark):
    row = lambda i, *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells).replace("ID", f'<a data-id="{i}">') + "</tr>"
    html = "<table><tr><td>밖</td></tr><tbody>" + row(7, "1", "총무과", "제1호", "ID학칙 &amp; 규정</a>", "2024.01.02", "9") + row(8, "2", "교무과", "ID지침</a>", "2024.02.03", "3") + "<tr><td>id 없음</td></tr>" + row(9, "3", "ID짧음</a>", "x") + "</tbody></table>"
    df = spark.createDataFrame([("b", html), ("c", "표 없음"), ("d", None)], "board string, html string")
    got = [tuple(r) for r in boards.board_rows(df).drop("at").orderBy("ntt_sn").collect()]
    assert got == [("b", "7", "총무과", "제1호", "학칙 & 규정", "2024.01.02"), ("b", "8", "교무과", "", "지침", "2024.02.03")]


def test_counts_pages_and_numbers(spark):
    df = spark.createDataFrame([("<b>전체</b> 글 <i>1,234</i>",), ("없음",), ("전체 10건",)], "html string")
    counted = df.select(boards.total_count("html").alias("total"))
    assert [r.total for r in counted.collect()] == [1234, 0, 10]
    assert [r.n for r in boards.page_numbers(counted).groupBy("total").agg(F.max("page").alias("n")).orderBy("total").collect()] == [1, 1, 124]
    seq = spark.createDataFrame([("schlPubRulInfoP.do?schlPubRulSeq= 2200000150709'",), ("x",)], "html string").select(boards.law_seq("html").alias("s"))
    assert [r.s for r in seq.collect()] == ["2200000150709", None]


def test_law_pages(spark):
    pages = [
        "<div>메뉴</div><div>가나대학교 총무처(총무과), 055-000-0000</div><div>가나대학교 교무처(교무과), 055-772-0102</div><p>제1장 총칙</p><p>제1조(목적) 본문</p>",
        "<p>메뉴</p><p>윤리강령</p><p>[시행 2024. 1. 2.] [가나대학교규정 제1호, 2024. 1. 2., 제정]</p><p>" + "우리는 규정을 지킨다. " * 5 + "</p>",
        "<p>아무것도 없다</p>", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: (r.body, r.contact) for r in boards.law_bodies(df, institutions=("가나대학교",)).collect()}
    assert got[0] == ("제1장 총칙\n\n제1조(목적) 본문".replace("\n\n", "\n"), "교무처(교무과) 055-772-0102") or got[0][0].startswith("제1장 총칙")
    assert got[0][1] == "교무처(교무과) 055-772-0102"
    assert got[1][0].startswith("[시행 2024. 1. 2.]") or got[1][0].startswith("윤리강령")
    assert got[2] == (None, None) and got[3] == (None, None)
    assert boards.rejects(boards.law_bodies(df)).count() == 2


def test_posts_attachments_and_progress(spark):
    post = '<a href="#" data-id="55" class="nttInfoBtn">2025 <b>규정집</b>\n 개정</a><a data-id="54" class="nttInfoBtn">옛</a>'
    files = '<a href="/common/nttFileDownload.do?fileKey=ab1" x>안내.pdf</a><a href="/common/nttFileDownload.do?fileKey=cd2">규정집 전문.hwpx</a>'
    df = spark.createDataFrame([(post, files), (post, files.replace("규정집", "책")), (post, "")], "p string, f string")
    got = df.select(boards.latest_post("p").alias("p"), boards.attachment("f").alias("f")).collect()
    assert tuple(got[0].p) == ("55", "2025 규정집 개정")
    assert [None if r.f is None else r.f.key for r in got] == ["cd2", "ab1", None]
    done = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, line_no int, name string")
    assert {(r.id, r.name) for r in boards.last_records(done).collect()} == {("a", "y"), ("b", "z")}
    assert [r.id for r in boards.not_done(spark.createDataFrame([("a",), ("c",)], "id string"), done).collect()] == ["c"]


def test_stored_texts_read_back(spark, tmp_path):
    df = spark.createDataFrame([("학칙/안", "총무과", "본문이다.")], "name string, department string, body string")
    r = boards.stored_text(df, {"규정명": "name", "소관부서": "department"}).first()
    assert r.file_name == "학칙_안.txt" and r.content == "규정명: 학칙/안\n소관부서: 총무과\n" + "=" * 40 + "\n본문이다.\n"
    (tmp_path / r.file_name).write_text(r.content, encoding="utf-8")
    assert tables.read_bodies(spark, str(tmp_path)).first().body == "본문이다."


PARAS = [
    "제1편 총칙", "1. 연구비 관리 규정", "12", "~", "30", "산학연구과", "2. 산학협력단 인사 규정 [교육부고시 제1호]", "31", "~", "40", "제2편 운영", "3 시설 운영 지침", "아무 말", "4. 장비의 사용 요령", "본문 시작",
    "연구비 관리 규정", "제1조 연구비", "인사 규정", "제1조 인사", "", "시설 운영 지침", "제1조 시설", "장비 사용 요령", "제1조 장비",
]


@pytest.fixture
def book(spark):
    def run(text):
        return f"<hp:p id='1'><hp:run><hp:t>{text[:2]}</hp:t><hp:t a='b'>{text[2:]}</hp:t></hp:run></hp:p>"

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("Contents/section10.xml", run("끝 &lt;글&gt; HWPHYPERLINKabc 이다"))
        z.writestr("Contents/section2.xml", "".join(map(run, PARAS)))
        z.writestr("mimetype", "x")
    return spark.createDataFrame([("a.hwpx", bytearray(data.getvalue())), ("bad", bytearray(b"no zip"))], "path string, content binary")


def test_rulebook(spark, book):
    paras = rulebook.paragraphs(book).cache()
    rows = [r.text for r in paras.orderBy("pos").collect()]
    assert rows == [*PARAS, "끝 <글> 이다"]
    toc = rulebook.contents(paras)
    got = [(r.no, r["name"], r.part, r.department, r.page_start, r.page_end) for r in toc.orderBy("pos").collect()]
    assert got == [
        (1, "연구비 관리 규정", "제1편 총칙", "산학연구과", 12, 30), (2, "산학협력단 인사 규정 [교육부고시 제1호]", "제1편 총칙", "", 31, 40),
        (3, "시설 운영 지침", "제2편 운영", "", None, None), (4, "장비의 사용 요령", "제2편 운영", "", None, None),
    ]
    bodies = {r.no: r.body for r in rulebook.split(paras, toc).collect()}
    assert bodies == {1: "연구비 관리 규정\n제1조 연구비", 2: "인사 규정\n제1조 인사", 3: "시설 운영 지침\n제1조 시설", 4: "장비 사용 요령\n제1조 장비\n끝 <글> 이다"}
    assert rulebook.missing(paras, toc).count() == 0
    pages = rulebook.start_pages(toc, spark.createDataFrame([("연구비 관리 규정",), ("없는 규정",)], "name string"))
    assert [tuple(r) for r in pages.collect()] == [("연구비 관리 규정", 12)]


def test_logs_and_feedback(spark, tmp_path):
    lines = [json.dumps({"question": "휴학", "status": "answered", "took_ms": 3.5}, ensure_ascii=False), "{bad", ""]
    (tmp_path / "2020-01-01.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "feedback-2020-01-01.jsonl").write_text(lines[0], encoding="utf-8")
    assert [r.question for r in tables.read_log(spark, str(tmp_path)).collect()] == ["휴학"]
    assert tables.read_log(spark, str(tmp_path), days=30).count() == 0
    rows = spark.createDataFrame([("t", "q" * 600, "up", "p" * 400, [str(i) for i in range(20)], "c"), ("t", "q", "maybe", "", [], "")], tables.FEEDBACK)
    one = tables.feedback_entries(rows).collect()
    assert len(one) == 1 and len(one[0].question) == 500 and len(one[0].answer_preview) == 300 and len(one[0].chunk_ids) == 10
    tables.append_log(tables.read_log(spark, str(tmp_path)), str(tmp_path / "out"))
    tables.append_log(tables.read_log(spark, str(tmp_path / "2020-01-01.jsonl")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_sinks(spark, tmp_path):
    groups = spark.createDataFrame([("산학", "나", "2", 1, "a"), ("대학", "과", "1", 3, "b, c")], "source string, department string, contact string, n int, names string")
    sheet = tables.contact_sheet(groups, "source", "department", "contact", "n", "names")
    tables.write_contacts(sheet, str(tmp_path / "csv" / "sheet.csv"))
    (text,) = [p.read_text(encoding="utf-8") for p in (tmp_path / "csv").iterdir()]
    assert text.startswith("\ufeff출처,담당부서,") and text.splitlines()[1].startswith("대학,과,1,3,") and text.splitlines()[2].startswith("산학,나")
    tables.write_markdown(sheet, "목록", "확인 바랍니다.", str(tmp_path / "md"))
    (text,) = [p.read_text(encoding="utf-8") for p in (tmp_path / "md").glob("*.txt")]
    assert text.splitlines()[:3] == ["# 목록", "", "확인 바랍니다."] and text.splitlines()[5] == "|---|---|---|---|---|---|---|"
    assert [line[:6] for line in text.splitlines()[6:]] == ["| 대학 |", "| 산학 |"]
    known = tables.with_default_contact(spark.createDataFrame([("가",), ("다",), (None,), ("",)], "department string"), {"가": "1", "나": "2"}, "나")
    assert [tuple(r) for r in known.select("department", "contact").collect()] == [("가", "1"), ("다", "2"), ("나", "2"), ("나", "2")]
    tables.write_report(spark.range(2), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    merged = tables.merge_sources(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("b", 1)], "id string, rulebook_page int"))
    assert {tuple(r) for r in merged.collect()} == {("a", None), ("b", 1)}
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"id": "a", "name": "학칙", "other": 1}], ensure_ascii=False), encoding="utf-8")
    assert tables.read_json_array(spark, str(path), tables.REGULATION).first()["name"] == "학칙"


def test_refresh(spark, tmp_path):
    regs = [("r1", "대학", "규정", "가 규정", "과", "1", "u", "http://law", "제1조(목적) 이 규정은 예시 본문이다.", "x\n[시행 2024.1.2.] [가 제1호, 2024.1.2., 제정]", "2023.1.1", None), ("r2", "산학협력단", "제1편", "나 규정", "과", "1", "u", "", "개정 2025. 7. 1.\n제1조(목적) 이 규정은 다른 본문이다.", None, "", None)]
    df = spark.createDataFrame(regs, "id string, source string, category string, name string, department string, contact string, source_url string, law_url string, body string, law_text string, date string, rule_no string")
    dated = {r.id: (r.enforce_date, r.revision_type, r.rule_no, r.status) for r in refresh.dated(df).collect()}
    assert dated == {"r1": ("2024-01-02", "제정", "가 제1호", "현행"), "r2": ("2025-07-01", "개정", "", "현행")}
    chunks = lambda: {r.reg_id: r["count"] for r in spark.read.parquet(str(tmp_path / "chunks")).groupBy("reg_id").count().collect()}
    stub = lambda: lambda texts: [[len(t), 1.0] for t in texts]
    steps = refresh.refresh(spark, df, str(tmp_path), load=stub, evaluate=lambda paths: spark.range(3), enrich=True)
    assert [(s.name, s.ok) for s in steps] == [(n, True) for n in ("enrich", "chunks", "index", "vectors", "evaluation")]
    assert chunks() == {"r1": 1, "r2": 1} and spark.read.parquet(str(tmp_path / "vectors")).count() == 2
    new = df.withColumn("body", F.concat("body", F.lit("\n제2조(추가) 새로 생긴 조문의 본문이다.")))
    steps = refresh.refresh(spark, new, str(tmp_path), name="나", load=stub, skip=("index",))
    assert [s.ok for s in steps] == [None, True, None, True, None] and chunks() == {"r1": 1, "r2": 2}
    assert spark.read.parquet(str(tmp_path / "vectors")).groupBy("reg_id").count().collect()
    assert {r.reg_id: r["count"] for r in spark.read.parquet(str(tmp_path / "vectors")).groupBy("reg_id").count().collect()} == {"r1": 1, "r2": 2}

    def broken(paths):
        raise OSError("no report")

    steps = refresh.refresh(spark, df, str(tmp_path), evaluate=broken)
    told = refresh.summary(spark, steps).collect()
    assert [(r["name"], r.ok) for r in told] == [("enrich", None), ("chunks", True), ("index", True), ("vectors", None), ("evaluation", False), ("total", False)] and told[4].error == "no report"


def test_streaming_counts(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    schema = "ts timestamp, kind string"
    for i, minutes in enumerate(([1, 2, 59], [61, 200], [5, 400])):  # 5 is too late by then
        spark.createDataFrame([(at(m), "a") for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        logs.run_once(logs.windowed_counts(logs.read_stream(spark, str(tmp_path / "in"), schema), "ts", "kind"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.window_start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 3), (1, 1), (3, 1)]
    batch = logs.windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "kind", "2 hours", slide="1 hour")
    assert batch.agg(F.sum("n")).first()[0] == 14


def test_one_file_is_committed_whole_or_not_at_all(spark, tmp_path):
    path = tmp_path / "out.json"
    rows = spark.range(0, 50, 1, 5).selectExpr("id", "if(id % 7 = 0, null, concat('가\n', id)) t").orderBy("id")
    files.write_file(rows, str(path), "json")
    want = [{"id": i, "t": None if i % 7 == 0 else f"가\n{i}"} for i in range(50)]
    assert json.loads(path.read_text(encoding="utf-8")) == want
    broken = rows.withColumn("t", F.when(F.col("id") == 44, F.raise_error(F.lit("stop"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="stop"):
        files.write_file(broken, str(path), "json")
    assert json.loads(path.read_text(encoding="utf-8")) == want and [p.name for p in tmp_path.iterdir()] == ["out.json"]
    files.write_file(rows.limit(0), f"file://{path}", "json")
    assert json.loads(path.read_text(encoding="utf-8")) == []
    files.write_file(rows.limit(0), str(path), "csv")
    assert path.read_bytes() == b"\xef\xbb\xbfid,t\r\n"


def test_titles_by_candidates_equal_comparing_all(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("가나다라마바사아자차카타파하거너더러") for _ in range(n))
    names = [word(rng.randint(1, 24)) + "규정" for _ in range(120)]

    def changed(name):
        at = rng.randrange(len(name) - 2) if len(name) > 3 else 0
        return rng.choice([name[:at] + word(1) + name[at:], name[:at] + name[at + 1 :], name[:at] + word(1) + name[at + 1 :], word(2) + name, name[::-1][2:] + "규정"])

    others = [changed(n) for n in names for _ in range(2)]
    a = spark.createDataFrame([("f", i, len(n), n) for i, n in enumerate(names)], "path string, pos int, m int, loose string")
    b = spark.createDataFrame([("f", i, len(n), n) for i, n in enumerate(others)], "path string, p int, n int, other string")
    got = {(r.pos, r.p) for r in rulebook.title_candidates(a, b).collect()}
    alike = {(i, j) for i, x in enumerate(names) for j, y in enumerate(others) if abs(len(x) - len(y)) <= 15 and difflib.SequenceMatcher(None, y, x).ratio() >= 0.9}
    assert alike and alike <= got and len(got) < len(names) * len(others) / 20


def test_titles_of_a_small_alphabet_make_few_pairs(spark):
    rng = random.Random(3)
    letters = [chr(44032 + i) for i in range(60)]
    names = ["".join(rng.sample(letters, 11)) for _ in range(1500)]
    entries = spark.createDataFrame([("f", i, len(n), n) for i, n in enumerate(names[:700])] + [("f", 2000, 1, "가")], "path string, pos long, m long, loose string")
    shaped = spark.createDataFrame([("f", i, len(n), n) for i, n in enumerate(names[690:])] + [("f", 3000, 1, "가")], "path string, p long, n long, other string")
    pairs = rulebook.title_candidates(entries, shaped)
    assert {(r.pos, r.p) for r in pairs.collect()} >= {(690 + i, i) for i in range(10)} | {(2000, 3000)}
    met = pairs.select("path", "pos", "p").distinct().count()
    before = rulebook._met_pairs(entries, shaped).count()
    assert met <= before < 701 * 811 / 10


def test_entries_of_one_title_and_long_bodies(spark, monkeypatch):
    monkeypatch.setattr(rulebook, "STRETCH", 3)
    toc = spark.createDataFrame([("f", 0, "가 규정"), ("f", 1, "가 규정"), ("f", 2, "나 규정"), ("f", 3, "없는 지침")], "path string, pos int, name string")
    lines = ["가 규정", *(f"줄{i}" for i in range(10)), "나 규정", "", "끝"]
    paras = spark.createDataFrame([("f", 10 + i, t) for i, t in enumerate(lines)], "path string, pos int, text string")
    got = {r.pos: r.body for r in rulebook.split(paras, toc).collect()}
    assert got == {0: "", 1: "\n".join(lines[:11]), 2: "나 규정\n끝"}
