"""More queries over the driver's tables: cases that are made of their columns, on both sides alike.

Each feeds an operator that the tables have no input for, such as pages of a board, a zipped
rulebook or a model's answers.
"""

import functools
import io
import uuid
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import analytics, answers, chunking, embedding, keyword, ranking
from .plans import answer as answering
from .plans import collect, refresh
from .plans import search as hybrid
from .queries import _PLAIN, _bm25, _clean_sql, _packed, _questions, _strip, _top, query, table
from .shipping import attach
from .sources import boards, files, grids, rulebook, tables
from .storage import shared_folder

lit = F.lit


def _scratch(spark, what: str) -> str:
    return f"{shared_folder(spark)}/tessera-{what}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- ingestion
@query("SELECT s_suppkey, (s_suppkey * 1237 % 5000)::BIGINT AS total, greatest(1, ceil((s_suppkey * 1237 % 5000) / 10.0))::BIGINT AS n_pages FROM supplier")
def board_pages(spark, sf_dir):
    """Numbers of posts and of pages, read from pages that say the number with commas."""
    total = F.col("s_suppkey") * 1237 % 5000
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(lit("<p><b>전체</b> 글 <i>"), F.format_number(total, 0), lit("</i>건</p>")).alias("html"))
    found = boards.page_numbers(pages.select("s_suppkey", boards.total_count("html").alias("total")))
    return found.groupBy("s_suppkey", "total").agg(F.max("page").alias("n_pages"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END AS law_seq, p_partkey::VARCHAR AS ntt_sn, p_name || ' x' AS title,
CASE WHEN p_size < 10 THEN 'a' ELSE 'b' END || p_partkey AS file_key, CASE WHEN p_size < 10 THEN '규정집 ' || p_brand || '.pdf' ELSE '규정집 나.hwpx' END AS file_name FROM part""")
def page_links(spark, sf_dir):
    """Law numbers, newest posts and attachments of pages."""
    key = F.col("p_partkey").cast("string")
    post = F.concat(lit('<a href="#" data-id="'), key, lit('" class="nttInfoBtn"> <b>'), "p_name", lit("</b>\n  x </a><a data-id=\"1\" class=\"nttInfoBtn\">old</a>"))
    law = F.when(F.col("p_partkey") % 2 == 0, F.concat(lit("<a href='/schlPubRulInfoP.do?schlPubRulSeq= "), key, lit("'>"))).otherwise("<a href='/other.do?seq=1'>")
    link = lambda k, name: F.concat(lit('<a href="/common/nttFileDownload.do?fileKey='), lit(k), key, lit('">'), name, lit("</a>"))
    files = F.concat(link("a", F.concat(lit(" <b>규정집</b> "), "p_brand", lit(".pdf"))), F.when(F.col("p_size") >= 10, link("b", lit("규정집  나.hwpx"))).otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", law.alias("law"), post.alias("post"), files.alias("files"))
    got = rows.select("p_partkey", boards.law_seq("law").alias("law_seq"), boards.latest_post("post").alias("p"), boards.attachment("files").alias("f"))
    return got.select("p_partkey", "law_seq", "p.ntt_sn", "p.title", F.col("f.key").alias("file_key"), F.col("f.name").alias("file_name"))


def _law_html(n) -> F.Column:
    phone = F.concat(lit("055-772-"), F.lpad((n % 10000).cast("string"), 4, "0"))
    chapters = F.concat(lit("<div>메뉴</div><div>가나대 총무과, "), phone, lit("</div><p>제1장 총칙</p><p>제1조(목적) "), "lang", lit(" "), "source", lit("</p>"))
    marked = F.concat(lit("<p>안내</p><p>"), "source", lit(" [시행 2024. 1. 2.] [가 제1호, 2024. 1. 2., 제정]</p><p>"), F.repeat(lit("우리는 "), 20), "lang", lit("</p>"))
    return F.when(n % 3 == 0, chapters).when(n % 3 == 1, marked).otherwise("<p>none</p>")


_LAW_SQL = """CASE doc_id % 3 WHEN 0 THEN '제1장 총칙' || chr(10) || '제1조(목적) ' || lang || ' ' || source
 WHEN 1 THEN source || ' [시행 2024. 1. 2.] [가 제1호, 2024. 1. 2., 제정]' || chr(10) || repeat('우리는 ', 20) || lang END"""


@query(f"SELECT doc_id, {_LAW_SQL} AS body, CASE WHEN doc_id % 3 = 0 THEN '총무과 055-772-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') END AS contact FROM documents")
def law_pages(spark, sf_dir):
    """Bodies and contacts of law pages in all three forms."""
    pages = table(spark, sf_dir, "documents").select("doc_id", _law_html(F.col("doc_id")).alias("html"))
    return boards.law_bodies(pages, institutions=("가나대",)).select("doc_id", "body", "contact")


@query(f"""SELECT 'x:' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'no page' WHEN doc_id % 7 = 0 THEN 'no law number' WHEN doc_id % 11 = 0 THEN 'no law page' WHEN doc_id % 3 = 2 THEN 'no text' ELSE '' END AS error,
CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 THEN NULL ELSE {_LAW_SQL} END AS body FROM documents WHERE doc_id % 4 <> 0""")
def collected_board(spark, sf_dir):
    """A board whose collection was broken off, resumed; errors of every kind."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    key = n.cast("string")
    posts = d.select(key.alias("ntt_sn"), F.col("source").alias("name"), lit("").alias("department"), lit("").alias("rule_no"), lit("2024.01.02").alias("date"))
    details = d.where(n % 5 != 0).select(key.alias("ntt_sn"), F.when(n % 7 != 0, F.concat(lit("schlPubRulInfoP.do?schlPubRulSeq="), key)).otherwise("-").alias("html"))
    laws = d.where(n % 11 != 0).select(key.alias("law_seq"), _law_html(n).alias("html"))
    progress = d.where(n % 4 == 0).select(F.concat(lit("x:"), key).alias("id"))
    made, errors = collect.collected(posts, details, laws, progress, "x", "규정")
    return made.select("id", lit("").alias("error"), "body").union(errors.select("id", "error", lit(None).cast("string")))


@query(f"SELECT doc_id, trim(source || ' a_b', ' ._') || '.txt' AS file_name, sha256('이름: ' || source || chr(10) || '번호: ' || doc_id || chr(10) || repeat('=', 40) || chr(10) || lang || chr(10)) AS content_sha256, {_strip('lang')} AS body FROM documents")
def stored_texts(spark, sf_dir):
    """Texts as files with a header, and the body that is read from them again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat("source", lit(" a:b.")).alias("name"))
    files = boards.stored_text(d, {"이름": "source", "번호": "doc_id"}, "lang")
    return files.select("doc_id", "file_name", F.sha2("content", 256).alias("content_sha256"), chunking.body_of(F.col("content")).alias("body"))


@query("SELECT r_name AS path, i::INT AS pos, CASE i WHEN 0 THEN r_name WHEN 1 THEN 'a & b<c' ELSE '끝' END AS text FROM region, range(3) t(i)")
def zipped_paragraphs(spark, sf_dir):
    """Paragraphs of zipped XML, whose sections come in the order of their numbers."""
    attach(spark)

    def zipped(batches):
        for batch in batches:
            names, packed = batch.column(0).to_pylist(), []
            for name in names:
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w") as z:
                    z.writestr("Contents/section10.xml", "<hp:p><hp:t>끝</hp:t></hp:p>")
                    z.writestr("Contents/section2.xml", f'<hp:p id="1"><hp:t>{name}</hp:t></hp:p><hp:p ><hp:run><hp:t>a &amp; </hp:t><hp:t>b&lt;c</hp:t></hp:run></hp:p>')
                packed.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], ["path", "content"])

    return rulebook.paragraphs(table(spark, sf_dir, "region").select("r_name").mapInArrow(zipped, "path string, content binary"))


def _rulebook_tables(spark, sf_dir) -> DataFrame:
    """A zipped file for each customer's nation and segment, with a table of its customers and the pages of each."""
    attach(spark)
    c = table(spark, sf_dir, "customer").where("c_name is not null").groupBy("c_nationkey", "c_mktsegment").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))

    def zipped(batches):
        cell = lambda t, more="": f"<hp:tc><hp:p><hp:t>{t}</hp:t></hp:p>{more}</hp:tc>"
        for batch in batches:
            for at, rows in enumerate(batch.column(1)):
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w") as z, z.open("Contents/section0.xml", "w", force_zip64=True) as out:
                    out.write(f"<hp:p><hp:tbl><hp:tr>{cell('head', '<hp:cellSpan colSpan=\"2\" rowSpan=\"1\"/>')}</hp:tr>".encode())
                    for i, r in enumerate(rows):
                        out.write(f"<hp:tr>{cell(f'{i + 1}. {r["c_name"]}')}{cell(r['c_custkey'])}</hp:tr>".encode())
                    out.write(b"</hp:tbl></hp:p>")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([f.getvalue()], pa.binary())], ["path", "content"])

    return c.select(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("path"), "rows").mapInArrow(zipped, "path string, content binary")


@query("""WITH c AS (SELECT c_nationkey || '-' || c_mktsegment AS path, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS i FROM customer)
SELECT path, 0 AS "row", 0 AS col, 2 AS col_span, 'head' AS text FROM c WHERE i = 1 UNION ALL SELECT path, i::INT, 0, 1, i || '. ' || c_name FROM c UNION ALL SELECT path, i::INT, 1, 1, c_custkey::VARCHAR FROM c""")
def table_cells(spark, sf_dir):
    """Cells of the tables of zipped files, by a table function."""
    return grids.table_cells(_rulebook_tables(spark, sf_dir)).select("path", "row", "col", "col_span", "text")


@query("SELECT c_name AS name, c_custkey::INT AS page_start FROM customer WHERE c_custkey % 3 = 0")
def grid_start_pages(spark, sf_dir):
    """Start pages of named entries, from the tables of zipped files."""
    names = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"))
    return grids.start_pages(grids.table_cells(_rulebook_tables(spark, sf_dir)), names)


def _paragraphs(spark, sf_dir) -> DataFrame:
    """A rulebook for each region: a table of contents with pages and offices, and each nation's rule."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.withColumn("i", F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey")))
    i, name = F.col("i"), F.concat("n_name", lit(" 규정"))
    listed = F.array(F.concat(i.cast("string"), lit(". "), name), (i * 10).cast("string"), lit("~"), (i * 10 + 5).cast("string"), lit("총무과"), lit(""))
    entries = n.select(F.col("r_name").alias("path"), F.posexplode(listed).alias("k", "text"), (1 + (i - 1) * 6).alias("base")).select("path", (F.col("base") + F.col("k")).alias("pos"), "text")
    bodies = n.select(F.col("r_name").alias("path"), F.posexplode(F.array(name, F.concat(lit("제1조  "), F.lower("n_name"), lit(" x")))).alias("k", "text"), (100 + i * 2).alias("base")).select("path", (F.col("base") + F.col("k")).alias("pos"), "text")
    parts = table(spark, sf_dir, "region").select(F.col("r_name").alias("path"), lit(0).alias("pos"), F.concat(lit("제 1 편  "), "r_name").alias("text"))
    return parts.union(entries).union(bodies)


_NATIONS = "SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey)::INT AS i FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT r_name AS path, i AS no, n_name || ' 규정' AS name, '제1편 ' || r_name AS part, '총무과' AS department, i * 10 AS page_start, i * 10 + 5 AS page_end FROM ({_NATIONS})")
def rulebook_contents(spark, sf_dir):
    return rulebook.contents(_paragraphs(spark, sf_dir)).drop("pos")


@query(f"SELECT r_name AS path, n_name || ' 규정' AS name, {_clean_sql('''n_name || ' 규정' || chr(10) || '제1조  ' || lower(n_name) || ' x' ''')} AS body FROM ({_NATIONS})")
def rulebook_split(spark, sf_dir):
    """Each rule's text, from its title to the next one's."""
    paras = _paragraphs(spark, sf_dir)
    return rulebook.split(paras, rulebook.contents(paras)).select("path", "name", "body")


#: Steps and moduli by which a part's key becomes syllables, so that no two parts share a name.
_SYLLABLES = [(7 + 10 * i, 10_007 + 90 * i) for i in range(11)]
_NAME_SQL = "chr(44032) || " + " || ".join(f"chr((44032 + p_partkey * {a} % {m})::INT)" for a, m in _SYLLABLES)


@query(f"""SELECT p_brand AS path, CASE p_partkey % 4 WHEN 0 THEN n || ' 규정' WHEN 1 THEN '산학협력단 ' || n || ' 규정 [고시]' WHEN 2 THEN n || '의 운영 규정' ELSE n || ' 지침' END AS name, CASE WHEN p_partkey % 4 < 3 THEN 100000 + 2 * i ELSE -1 END AS start
FROM (SELECT *, {_NAME_SQL} AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)""")
def rulebook_titles(spark, sf_dir):
    """Where entries start, by the same title, the same but for words that come and go, or the most like one."""
    key, i = F.col("p_partkey"), F.col("i")
    rows = table(spark, sf_dir, "part").withColumn("i", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    syllables = [F.decode(F.unhex(F.hex(44032 + key * a % m)), "UTF-16BE") for a, m in _SYLLABLES]
    rows = rows.select(F.col("p_brand").alias("path"), "i", (key % 4).alias("kind"), F.concat(lit("가"), *syllables).alias("n"))
    named = lambda *ways: functools.reduce(lambda c, w: c.when(F.col("kind") == w[0], F.concat(*w[1])), ways, F).alias
    name = named((0, ["n", lit(" 규정")]), (1, [lit("산학협력단 "), "n", lit(" 규정 [고시]")]), (2, ["n", lit("의 운영 규정")]), (3, ["n", lit(" 지침")]))("name")
    title = named((0, ["n", lit(" 규정")]), (1, ["n", lit(" 규정")]), (2, ["n", lit(" 운영 규정")]))("text")
    text = rows.where("kind < 3").select("path", (100_000 + i * 2).alias("pos"), title).union(rows.select("path", (100_001 + i * 2).alias("pos"), lit("제1조 목적")))
    return rulebook.titles(text, rows.select("path", i.alias("pos"), name)).select("path", "name", F.coalesce("start", lit(-1)).cast("bigint").alias("start"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE p_size % 2 = 0) AS n_changed, count(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_type || ' ' ELSE p_brand || p_type END) AS n_texts FROM part")
def residue(spark, sf_dir):
    """Texts with and without residue of markup."""
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", lit(' 조문목록 없음"  src="/i.gif" />'), "p_type", lit(' 체크박스" value="1" />'))).otherwise(F.concat("p_brand", "p_type"))
    rows = table(spark, sf_dir, "part").select(text.alias("text"))
    return T.residue_count(rows).join(rows.agg(F.count_distinct(T.without_residue("text")).alias("n_texts")), F.lit(True))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""SELECT o_orderkey AS id, {_DAY} AS enforce_date, {_DAY} AS revision_date, CASE WHEN o_orderkey % 2 = 0 THEN '일부개정' ELSE CASE o_orderstatus WHEN 'F' THEN '제정' WHEN 'O' THEN '개정' ELSE '폐지' END END AS revision_type,
CASE WHEN o_orderkey % 2 = 0 THEN '제 ' || o_orderkey || '호' ELSE 'r1' END AS rule_no, CASE WHEN o_orderkey % 2 = 1 AND o_orderstatus NOT IN ('F', 'O') THEN '폐지' ELSE '현행' END AS status FROM orders""")
def dated_rules(spark, sf_dir):
    """Dates, kinds and states from law headers and from histories."""
    o, day = table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy. M. d")
    history = F.when(F.col("o_orderstatus") == "F", F.concat(lit("본문\n제정: "), day, lit("."))).when(F.col("o_orderstatus") == "O", F.concat(lit("제정 1990. 1. 2.\n개정 "), day)).otherwise(F.concat(lit("개정 1991. 3. 4.\n폐지 "), day))
    head = F.concat(lit("[시행 "), day, lit(".] [제  "), F.col("o_orderkey").cast("string"), lit("호, "), day, lit("., 일부 개정]"))
    law = F.col("o_orderkey") % 2 == 0
    rows = o.select(F.col("o_orderkey").alias("id"), lit("규정").alias("name"), lit("대학").alias("source"), F.when(law, "u").otherwise("").alias("law_url"), F.when(law, head).alias("law_text"), history.alias("body"), lit("2020.1.1").alias("date"), lit("r1").alias("rule_no"))
    return refresh.dated(rows).select("id", "enforce_date", "revision_date", "revision_type", "rule_no", "status")


# ---------------------------------------------------------------- chunks and places in texts
@query("""WITH p AS (SELECT doc_id, doc_id % 2 AS long, '제1조(정의) ①' || repeat('가', 500) || lang AS one, '②' || repeat('나', 500) || source AS two FROM documents),
c AS (SELECT doc_id, 0 AS i, '머리말' AS article, '' AS clause, repeat('머', 31) AS t FROM p WHERE long = 1 UNION ALL SELECT doc_id, long, '제1조', '제1항', one FROM p UNION ALL SELECT doc_id, long + 1, '제1조', '제2항', two FROM p)
SELECT doc_id || '#' || i AS chunk_id, article, clause, sha256(t) AS text_sha256 FROM c""")
def preambles_and_clauses(spark, sf_dir):
    """Preambles long enough to keep, and articles cut at their second clause mark."""
    head = F.when(F.col("doc_id") % 2 == 1, F.repeat(lit("머"), 31)).otherwise("짧은 머리")
    body = F.concat(head, lit("\n제1조(정의) ①"), F.repeat(lit("가"), 500), "lang", lit("\n②"), F.repeat(lit("나"), 500), "source")
    d = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return chunking.chunk(d, "doc_id", "body", carry=[]).select("chunk_id", "article", "clause", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT doc_id, length('제1조 ' || lang || chr(10))::INT AS start, length('제1조 ' || lang || chr(10) || '제 2 조 ' || source)::INT AS "end", CASE WHEN doc_id % 2 = 0 THEN -1 ELSE 4 END AS probe_start FROM documents""")
def article_places(spark, sf_dir):
    """Where an article stands in its rule's text, and where the beginning of a chunk does."""
    text = F.concat(lit("제1조 "), "lang", lit("\n제 2 조 "), "source", lit("\n부 칙 끝"))
    spaced = F.regexp_replace(text, "제 2 조", "제2조")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", spaced.alias("t"))
    span = T.article_span("t", lit("제 2 조"), lit("x"))
    probe = T.article_span("t", lit("부칙"), F.when(F.col("doc_id") % 2 == 0, lit("없는 글")).otherwise(F.concat("lang", lit("\n제2조"))))
    got = d.select("doc_id", span.alias("s"), probe.alias("p"))
    return got.select("doc_id", "s.start", (F.col("s.end") + 2).alias("end"), F.col("p.start").alias("probe_start"))


# ---------------------------------------------------------------- questions and results
@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '자퇴 ' || p_brand || ' 퇴학 자퇴원' WHEN 1 THEN '등록금 환불 ' || p_brand || ' 등록금 반환 등록금의 반환' WHEN 2 THEN '복전 복수전공 ' || p_brand ELSE '휴학 ' || p_brand END AS expanded FROM part""")
def synonyms(spark, sf_dir):
    asked = F.element_at(F.array(lit("자퇴 "), lit("등록금 환불 "), lit("복전 복수전공 "), lit("휴학 ")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", keyword.expanded_column(F.concat(asked, "p_brand")).alias("expanded"))


@query("SELECT p_partkey, p_partkey % 6 IN (1, 2, 5) AS asks FROM part")
def question_forms(spark, sf_dir):
    b = F.col("p_brand")
    forms = F.array(b, F.concat(b, lit("?")), F.concat(lit("전과 "), b, lit(" 되나요")), lit("어떻게"), F.concat(b, lit(" 신청 방법")), F.concat(lit("휴학　기간 "), b, lit(" 얼마")))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 6 + 1).cast("int")).alias("q")).select("p_partkey", ranking.is_question("q").alias("asks"))


@query("""WITH s AS (SELECT c_nationkey AS qid, c_custkey AS chunk_id, (c_custkey * 7919 % 1000) / 1000e0 AS score, c_custkey % 7 AS second FROM customer),
a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS place, max(score) OVER (PARTITION BY qid) AS top FROM s), c AS (SELECT *, place <= 10 AND score >= top - 0.05e0 AS close FROM a)
SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY close DESC, CASE WHEN close THEN second END DESC NULLS LAST, place)::INT AS rank FROM c""")
def second_model_order(spark, sf_dir):
    """Results re-ordered by a second model's scores, those close to the best only."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("qid"), key.alias("chunk_id"), (key * 7919 % 1000 / 1000).alias("score"), (key % 7).cast("double").alias("second_score"), lit(5).alias("top_k"))
    return ranking.reordered(rows).select("qid", "chunk_id", "rank")


_PARTS = "SELECT p_partkey, substr(p_brand, 1, 7) AS reg_id, p_brand AS chapter, p_size AS qid, p_type || CASE WHEN p_partkey % 2 = 0 THEN ' 규정' ELSE ' 시기' END AS title, CASE WHEN p_partkey % 9 = 0 THEN '부칙' ELSE '제1조' END AS article FROM part"


@query(f"""WITH c AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p_partkey) AS rank FROM c), used AS (SELECT DISTINCT qid, title FROM r WHERE rank <= 3),
near AS (SELECT b.qid, b.rank, n.p_partkey AS pos, n.title FROM r b JOIN c n USING (reg_id, chapter) WHERE b.rank <= 2 AND n.article = '제1조' AND NOT contains('SM BOX 규정', n.title) AND NOT EXISTS (SELECT 1 FROM used u WHERE u.qid = b.qid AND u.title = n.title)),
once AS (SELECT qid, title, min(rank * 1000000 + pos) AS o FROM near GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS place FROM once)
SELECT qid, place::INT AS at, title || CASE WHEN ends_with(title, '시기') THEN '는' ELSE '은' END || ' 어떻게 되나요?' AS question FROM numbered WHERE place <= 3""")
def neighbour_questions(spark, sf_dir):
    """Questions about the neighbours, in their chapter, of each question's first results."""
    title = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, " 규정").otherwise(" 시기"))
    chunks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("pos"), F.substring("p_brand", 1, 7).alias("reg_id"), F.col("p_brand").alias("chapter"), F.col("p_size").alias("qid"), title.alias("article_title"), F.when(F.col("p_partkey") % 9 == 0, "부칙").otherwise("제1조").alias("article"))
    results = chunks.select("qid", "chunk_id", "article_title", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id")).alias("rank")).where("rank <= 3")
    asked = chunks.select("qid").distinct().withColumn("text", lit("SM BOX 규정"))
    return answers.follow_ups(results, chunks.drop("qid"), asked)


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 1 YEAR, '%Y-%m-%d') AS since FROM orders")
def year_before(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hybrid.last_year(F.col("o_orderdate")).alias("since"))


@query(f"WITH {_bm25(_PLAIN)} SELECT qid, doc_id, rank, round(keyword, 4) AS score FROM ({_top(10)})")
def bm25_stored_index(spark, sf_dir):
    """The ten best documents by an index that was stored before."""
    path = _scratch(spark, "index")
    keyword.write_index(keyword.build(table(spark, sf_dir, "documents")), path)
    return keyword.topk(keyword.read_index(spark, path), _questions(spark, sf_dir), 10).select("qid", "doc_id", "rank", F.round("keyword", 4).alias("score"))


@query("SELECT 'chunk' AS what, doc_id::VARCHAR AS id, sha256(text) AS text_sha256 FROM documents WHERE doc_id = 7 UNION ALL SELECT 'regulation', doc_id::VARCHAR, sha256(text) FROM documents WHERE doc_id = 8")
def lookups(spark, sf_dir):
    """A chunk, and a regulation's whole text, by id; unknown ids and lost files give nothing."""
    d = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    chunks = d.select(F.col("id").alias("chunk_id"), "text")
    regs = d.select("id", F.concat(lit("texts\\"), "id", lit(".txt")).alias("text_file"))
    bodies = d.where("doc_id <> 9").select(F.concat(lit("file:/data/texts/"), "id", lit(".txt")).alias("text_file"), F.col("text").alias("body"))
    one = lambda i: hybrid.regulation_text(regs, bodies, i).select(lit("regulation").alias("what"), "id", F.sha2("full_text", 256).alias("text_sha256"))
    found = [hybrid.chunk_by_id(chunks, i).select(lit("chunk").alias("what"), F.col("chunk_id").alias("id"), F.sha2("text", 256).alias("text_sha256")) for i in ("7", "none")]
    return functools.reduce(DataFrame.union, [*found, one("8"), one("9"), one("none")])


# ---------------------------------------------------------------- vectors
def _stub():
    """An encoder that stands in for a model: a text's length, how many letters e it has, and one."""
    return lambda texts: np.array([[len(t), t.count("e"), 1.0] for t in texts])


def _as_chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("reg_id"), "source", F.col("lang").alias("category"), F.col("lang").alias("name"), lit("제1장").alias("chapter"), lit("제1조").alias("article"), lit(None).cast("string").alias("article_title"), "text")


_VECTOR = "list_transform([length(t), length(t) - length(replace(t, 'e', '')), 1], lambda x: round(x / sqrt(length(t) * length(t) + (length(t) - length(replace(t, 'e', ''))) * (length(t) - length(replace(t, 'e', ''))) + 1e0), 6))"


@query(f"SELECT chunk_id, array_to_string(list_transform({_VECTOR}, lambda v: printf('%.6f', v)), ' ') AS vector FROM (SELECT doc_id::VARCHAR AS chunk_id, lang || ' 제1장 제1조 ' || chr(10) || CASE WHEN source = 'src1' THEN replace(text, 'a', 'e') ELSE text END AS t FROM documents)")
def vector_refresh(spark, sf_dir):
    """Vectors of all chunks, and those of one regulation built again after its texts changed."""
    chunks = _as_chunks(spark, sf_dir)
    old = embedding.rebuilt(None, chunks, _stub)
    new = embedding.rebuilt(old, chunks.where("reg_id = 'src1'").withColumn("text", F.replace("text", lit("a"), lit("e"))), _stub)
    return new.select("chunk_id", F.array_join(F.transform("embedding", lambda v: F.format_string("%.6f", F.round(v, 6))), " ").alias("vector"))


@query(f"""WITH c AS (SELECT doc_id, unnest(ps) AS p FROM (SELECT doc_id, {_packed(_strip('text'))} AS ps FROM documents)), n AS (SELECT count(*) AS n FROM c WHERE length({_strip('p')}) >= 15)
SELECT unnest(['chunks', 'index', 'vectors', 'evaluation']) AS step, true AS ok, unnest([n, n, n, 1]) AS n FROM n UNION ALL SELECT 'enrich', false, 0""")
def refresh_steps(spark, sf_dir):
    """The batch refresh of all documents, step by step, with the rows that each left."""
    out = _scratch(spark, "refresh")
    regs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("name"), "source", F.col("lang").alias("category"), F.col("text").alias("body"))
    count = lambda paths: spark.read.parquet(paths["chunks"]).agg(F.count("*").alias("n"))
    steps = refresh.refresh(spark, regs, out, load=_stub, evaluate=count)
    left = {"chunks": f"{out}/chunks", "index": f"{out}/index/forward", "vectors": f"{out}/vectors"}
    n = {s: spark.read.parquet(p).count() for s, p in left.items()} | {"evaluation": spark.read.json(f"{out}/evaluation").count(), "enrich": 0}
    return spark.createDataFrame([(s.name, bool(s.ok), n[s.name]) for s in steps], "step string, ok boolean, n bigint")


# ---------------------------------------------------------------- answers
@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTOMOBILE,MOBILE' WHEN 'HOUSEHOLD' THEN 'HOUSEHOLD,MOBILE' WHEN 'BUILDING' THEN 'BUILDING,MOBILE' ELSE 'MOBILE' END AS names FROM customer")
def cited_names(spark, sf_dir):
    """Names that a text mentions, longest first; a name inside another does not count."""
    names = ["MOBILE", "HOUSE", "AUTOMOBILE", "HOUSEHOLD", "BUILDING", "BUILD"]
    text = F.concat(F.col("c_mktsegment"), lit(" MOBILE"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(answers.mentioned(text, names), ",").alias("names"))


_PART_TEXT = "p_name || ' of ' || p_brand || ', ' || split_part(p_name, ' ', 2) || split_part(p_name, ' ', 1) || ' (' || p_type || ')'"


@query(f"""WITH words AS (SELECT p_name AS n FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT split_part(p_name, ' ', 2) || split_part(p_name, ' ', 1) FROM part WHERE p_size % 2 = 0),
names AS (SELECT list({{'left': n, 'hit': []::VARCHAR[]}} ORDER BY length(n) DESC, n) AS ns FROM words WHERE n <> '')
SELECT p_partkey, array_to_string(r.hit, '|') AS names FROM (SELECT p_partkey, list_reduce(list_prepend({{'left': {_PART_TEXT}, 'hit': []::VARCHAR[]}}, ns),
  lambda s, x: CASE WHEN contains(s.left, x.left) THEN {{'left': replace(s.left, x.left, repeat(' ', length(x.left)::INT)), 'hit': list_append(s.hit, x.left)}} ELSE s END) AS r FROM part, names)""")
def cited_part_names(spark, sf_dir):
    """All names of a table that texts mention, by an automaton: longest first, and none inside another."""
    p = table(spark, sf_dir, "part")
    word = lambda i: F.split_part("p_name", lit(" "), lit(i))
    names = p.select(F.explode(F.array("p_name", "p_brand", "p_type", word(1), word(2), F.when(F.col("p_size") % 2 == 0, F.concat(word(2), word(1))))).alias("name"))
    found = answers.with_mentioned(p.select("p_partkey", F.expr(_PART_TEXT).alias("text")), names, "text")
    return found.select("p_partkey", F.array_join("mentioned", "|").alias("names"))


@query("""WITH r AS (SELECT p_partkey, p_name AS q, CASE p_size % 5 WHEN 0 THEN 'n/a ' || p_name WHEN 1 THEN split_part(p_name, ' ', 1) || ' x' WHEN 2 THEN p_name || repeat('z', 81) WHEN 3 THEN 'unrelated text' ELSE '' END AS new FROM part)
SELECT p_partkey, CASE WHEN length(new) BETWEEN 1 AND 80 AND NOT starts_with(upper(new), 'N/A') AND len(list_filter(string_split(q, ' '), lambda w: length(w) >= 2 AND contains(new, substr(w, 1, 2)))) > 0 THEN new ELSE q END AS search FROM r""")
def accepted_rewrites(spark, sf_dir):
    """A model's rewritings, where they pass the tests of one."""
    n = F.col("p_size") % 5
    new = F.when(n == 0, F.concat(lit("n/a "), "p_name")).when(n == 1, F.concat(lit(' "'), F.split_part("p_name", lit(" "), lit(1)), lit(' x"'))).when(n == 2, F.concat("p_name", F.repeat(lit("z"), 81))).when(n == 3, "unrelated text")
    return table(spark, sf_dir, "part").select("p_partkey", answers.accepted_rewrite("p_name", new).alias("search"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations),
k AS (SELECT conv_id, back, substr({_strip("coalesce(text, '')")}, 1, 300) AS question, role AS answer FROM n WHERE back <= 2)
SELECT conv_id, sha256(coalesce(string_agg(question || '|' || answer, chr(10) ORDER BY back DESC) FILTER (WHERE question <> ''), '')) AS history_sha256 FROM k GROUP BY conv_id""")
def recent_turns(spark, sf_dir):
    """The last two turns of each conversation, cut to size and without what follows an answer."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["text"].alias("question"), F.concat(lit(" "), x["role"], lit(" [근거 조항]\n- 가")).alias("answer")))
    kept = F.transform(answers.recent_history(turns, 2), lambda x: F.concat(x["question"], lit("|"), x["answer"]))
    return rows.select("conv_id", F.sha2(F.array_join(kept, "\n"), 256).alias("history_sha256"))


@query("""WITH q AS (SELECT item_id AS qid, b.text, d.text AS body, d.lang, d.source, item_id % 10 / 10e0 AS score FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
a AS (SELECT *, CASE WHEN score < 0.5 THEN 'refused' WHEN item_id_bad THEN 'fallback_no_llm' ELSE 'answered' END AS status, '- ' || source || ' ' || lang AS sources, '[' || source || '] ' || lang || ': ' || body AS context FROM (SELECT *, qid % 10 = 7 AS item_id_bad FROM q)),
w AS (SELECT *, list_contains(regexp_extract_all(context, '[0-9]+'), '777') AS known FROM a)
SELECT qid, status, sha256(CASE status WHEN 'refused' THEN '해당 내용은 규정에서 찾을 수 없습니다.' WHEN 'fallback_no_llm' THEN '[생성 불가: no answer]' || chr(10) || chr(10) || sources
 ELSE 'Answer 777' || chr(10) || chr(10) || '[근거 조항]' || chr(10) || sources || CASE WHEN known THEN '' ELSE chr(10) || chr(10) || '⚠️ [자동 검증 경고] 이 답변에 참고자료 원문에는 없는 숫자(777)가 포함되어 있습니다. AI가 스스로 계산했거나 지어냈을 수 있으니, 위 근거 조항의 원문을 직접 확인해주세요.' END END) AS answer_sha256 FROM w""")
def guarded_answers(spark, sf_dir):
    """Answers of a stand-in model behind the gate, with sources, fall-backs and warnings."""
    d = table(spark, sf_dir, "documents")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(lit("Q"), (F.col("item_id") % 10).cast("string")).alias("text"))
    results = asked.join(d, F.col("doc_id") == F.col("qid")).select("qid", lit(1).alias("rank"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("name"), F.col("lang").alias("location"), lit("").alias("article_title"), lit("").alias("snippet"), (F.col("qid") % 10 / 10).alias("score"))
    asked = asked.join(results.select("qid"), "qid", "left_semi")
    prompted = answering.prompts(asked, results, d.select(F.col("doc_id").alias("chunk_id"), "text"))
    model = lambda prompts: pd.Series([None if p.endswith("Q7") else " Answer 777\n" for p in prompts])
    return answering.answer(prompted, model, []).select("qid", "status", F.sha2("answer", 256).alias("answer_sha256"))


@query("""WITH r AS (SELECT *, c_custkey % 3 AS kind, c_nationkey % 2 = 0 AS hit, c_custkey % 4 = 0 AS refused, c_custkey % 5 <> 0 AS used FROM customer)
SELECT count(*) AS n, count(*) FILTER (WHERE CASE kind WHEN 0 THEN hit AND NOT refused AND used WHEN 1 THEN refused ELSE refused AND NOT used END) AS n_success, count(*) FILTER (WHERE c_custkey % 7 = 0 AND NOT refused) AS n_guarded, count(*) FILTER (WHERE c_custkey % 11 = 0) AS n_invented FROM r""")
def answer_verdicts(spark, sf_dir):
    """How many answers were as expected, guarded and invented."""
    key = F.col("c_custkey")
    refused = key % 4 == 0
    text = F.when(refused, "해당 내용은 규정에서 찾을 수 없습니다.").when(key % 7 == 0, "답 [자동 검증 경고]").otherwise("답")
    used = key % 5 != 0
    rows = table(spark, sf_dir, "customer").select(F.element_at(F.array(lit("cite"), lit("refuse_soft"), lit("refuse_hard")), (key % 3 + 1).cast("int")).alias("expect_type"), (F.col("c_nationkey") % 2 == 0).alias("hit"), text.alias("answer"), used.alias("used_llm"), used.alias("found"), F.when(key % 11 == 0, F.array(lit("3"))).otherwise(F.array().cast("array<string>")).alias("foreign_numbers"))
    return analytics.answer_report(analytics.answer_verdicts(rows))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier)
SELECT count(DISTINCT s_nationkey) AS n, count(DISTINCT s_nationkey) FILTER (WHERE rank <= 5 AND s_suppkey % 4 = 0) AS n_hit, round(count(DISTINCT s_nationkey) FILTER (WHERE rank <= 5 AND s_suppkey % 4 = 0) / count(DISTINCT s_nationkey), 6) AS rate, count(*) FILTER (WHERE rank = 1 AND s_suppkey % 3 = 0) AS n_attached_first FROM r""")
def academic_evaluation(spark, sf_dir):
    """Hits in names, titles and places, and attached schools in the first place."""
    key = F.col("s_suppkey")
    name = F.when(key % 3 == 0, F.concat("s_name", lit(" 부설고등학교"))).otherwise(F.concat("s_name", lit(" 부설 고등학교")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("qid"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rank"), name.alias("name"), F.when(key % 4 == 0, "휴학 Term").alias("article_title"), lit("제1조").alias("location"))
    cases_ = rows.select("qid").distinct().withColumn("expects", F.array(lit("TERM")))
    return analytics.academic_report(rows, cases_).withColumn("rate", F.round("rate", 6))


@query("""SELECT row_number() OVER (ORDER BY n_name, c_mktsegment, contact) AS at, n_name AS source, c_mktsegment AS department, contact, n, combos FROM (
SELECT *, count(*) OVER (PARTITION BY n_name) AS combos FROM (SELECT n_name, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN '055-1' ELSE '055-0' END AS contact, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL))""")
def contact_sheet(spark, sf_dir):
    """Contacts with their defaults, in the sheet's order, and how many each source has."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = tables.with_default_contact(rows.withColumn("department", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))), {"BUILDING": "055-1", "MACHINERY": "055-0"}, "MACHINERY")
    groups = analytics.contact_groups(rows, ["n_name", "department", "contact"], "c_name", "c_custkey")
    sheet = tables.contact_sheet(groups, "n_name", "department", "contact", "n", "names").toDF("source", "department", "contact", "n", "names", "ok", "new")
    numbered = sheet.withColumn("at", F.row_number().over(Window.orderBy("source", "department", "contact")))
    return numbered.join(analytics.contacts_by_source(groups, "n_name").withColumnRenamed("n", "combos"), "source").select("at", "source", "department", "contact", "n", "combos")


@query("""WITH g AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*) AS n, min(c_name) || ', "' || max(c_name) || '"' AS names FROM customer GROUP BY ALL),
j AS (SELECT string_agg('{"nation": ' || a || ', "segment": "' || b || '", "n": ' || n || '}', ',' || chr(10) ORDER BY a, b) AS t FROM g)
SELECT 'csv' AS kind, 'EFBBBF' AS mark, sha256(chr(65279) || 'nation,segment,n,names' || chr(13) || chr(10) || string_agg(a || ',' || b || ',' || n || ',"' || replace(names, '"', '""') || '"' || chr(13) || chr(10), '' ORDER BY a, b)) AS content_sha256 FROM g
UNION ALL SELECT 'json', '5B0A7B', sha256('[' || chr(10) || t || chr(10) || ']' || chr(10)) FROM j""")
def written_files(spark, sf_dir):
    """A sheet and a report, each written as one file and read again byte by byte."""
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    g = g.agg(F.count("*").alias("n"), F.concat(F.min("c_name"), lit(', "'), F.max("c_name"), lit('"')).alias("names")).orderBy("nation", "segment")
    out = _scratch(spark, "files")
    files.write_file(g, f"{out}/sheet.csv", "csv")
    files.write_file(g.drop("names"), f"{out}/report.json", "json")
    found = spark.read.format("binaryFile").load(out)
    return found.select(F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"), F.hex(F.substring("content", 1, 3)).alias("mark"), F.sha2("content", 256).alias("content_sha256"))


@query("SELECT event_type AS question, count(*) AS n, round(sum(value), 2) AS took FROM events WHERE event_id % 10 <> 0 GROUP BY event_type")
def logged_questions(spark, sf_dir):
    """Daily JSON logs, written and read again without lines that are no JSON."""
    path = _scratch(spark, "log")
    e = table(spark, sf_dir, "events")
    entry = F.to_json(F.struct(F.col("event_type").alias("question"), F.col("value").cast("double").alias("took_ms"), lit("answered").alias("status")))
    e.select(F.when(F.col("event_id") % 10 == 0, lit("{broken")).otherwise(entry).alias("value")).write.text(path)
    got = tables.read_log(spark, path)
    return got.groupBy("question").agg(F.count("*").alias("n"), F.round(F.sum("took_ms"), 2).alias("took"))
