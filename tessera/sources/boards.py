"""Regulation boards and law pages: landed HTML to rows, by expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import clean_text, html_to_text, safe_file_name, strip

#: Fixed value: a post's link in a board's list.
POST_LINK = r'<a[^>]*data-id="(\d+)"[^>]*class="nttInfoBtn"[^>]*>'


def board_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(ntt_sn, department, rule_no, name, date) of each listed post; carries the pages' columns.

    Rows of six cells and more have fixed places; of four or five, name and date are counted
    from the end and there is no number; others, and rows without an id, are skipped."""
    keep = [c for c in pages.columns if c != html_col]
    body = F.regexp_extract(F.col(html_col), r"(?s)<tbody.*?</tbody>", 0)
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<tr.*?</tr>"), F.lit(0))).alias("at", "tr"))
    rows = rows.select(*keep, "at", F.regexp_extract("tr", r'data-id="(\d+)"', 1).alias("ntt_sn"), F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)).alias("tds"))
    rows = rows.where((F.col("ntt_sn") != "") & (F.size("tds") >= 4))
    full = F.size("tds") >= 6
    cell = lambda i: F.element_at("tds", i)
    text = lambda c: strip(F.replace(html_to_text(c), F.lit("\n"), F.lit(" ")))
    picked = rows.select(*keep, "at", "ntt_sn", cell(2).alias("department"), F.when(full, cell(3)).otherwise("").alias("rule_no"), F.when(full, F.try_element_at("tds", F.lit(4))).otherwise(cell(-3)).alias("name"), F.when(full, F.try_element_at("tds", F.lit(5))).otherwise(cell(-2)).alias("date"))
    return picked.select(*keep, "at", "ntt_sn", *(text(F.col(c)).alias(c) for c in ("department", "rule_no", "name", "date")))


def total_count(html) -> Column:
    """The board's number of posts; 0 if it does not say."""
    n = F.regexp_extract(F.regexp_replace(F.col(html), r"<[^>]+>", " "), r"전체[^\d]{0,40}([\d,]+)", 1)
    return F.when(n != "", F.replace(n, F.lit(","), F.lit("")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def page_numbers(boards: DataFrame, total: str = "total", per_page: int = 10) -> DataFrame:
    """A row for each page of a board: at least one."""
    return boards.withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col(total) / per_page)))))


def law_seq(html) -> Column:
    """The law page's number, or null; the source has blanks after the equals sign at times."""
    n = F.regexp_extract(F.col(html), r"(?U)schlPubRulInfoP\.do\?schlPubRulSeq=\s*(\d+)", 1)
    return F.when(n != "", n)


def contact(header: Column, institutions: tuple[str, ...] = ()) -> Column:
    """``department phone`` of the last such line, without the institution's name; or null."""
    pattern = r"(?md)^(.{2,40}),\s*(\d[\d\-]{6,17})\s*$"
    at = lambda i: strip(F.try_element_at(F.regexp_extract_all(header, F.lit(pattern), F.lit(i)), F.lit(-1)))
    name = at(1)
    if institutions:
        name = F.regexp_replace(name, r"(?U)^(" + "|".join(institutions) + r")\s*", "")
    return F.when(at(2).isNotNull(), F.concat(name, F.lit(" "), at(2)))


def law_bodies(pages: DataFrame, html_col: str = "html", institutions: tuple[str, ...] = ()) -> DataFrame:
    """``body`` and ``contact`` of law pages; ``body`` is null where no text is found.

    The text begins with the first chapter or article if any article follows, else with the
    line of the enforcement mark if more than 50 characters follow."""
    full = pages.withColumn("__t", html_to_text(html_col))
    t = F.col("__t")
    first = F.regexp_instr(t, F.lit(r"(?U)(제\s*1\s*장|제\s*1\s*조)"))
    mark = F.regexp_instr(t, F.lit(r"(?U)\[\s*시행\s*[\d.\s]+\]"))
    line = mark - F.instr(F.reverse(F.substring(t, F.lit(1), mark - 1)), "\n") + 1
    line = F.when(F.instr(F.substring(t, F.lit(1), mark - 1), "\n") > 0, line).otherwise(1)
    articles = (first > 0) & F.substring(t, first, F.length(t)).rlike(r"(?U)제\s*\d+\s*조")
    start = F.when(articles, first).when(mark > 0, line)
    body = clean_text(F.substring(t, start, F.length(t)))
    good = articles | (F.length(body) > 50)
    return full.withColumns({"body": F.when(good, body), "contact": F.when(good, contact(F.substring(t, F.lit(1), start - 1), institutions))}).drop("__t")


def rejects(bodies: DataFrame) -> DataFrame:
    """Pages without a text, for the error list."""
    return bodies.where("body is null")


def latest_post(html) -> Column:
    """struct(ntt_sn, title) of a board's first post."""
    pattern = f"(?s){POST_LINK}(.*?)</a>"
    title = F.regexp_replace(F.regexp_extract(F.col(html), pattern, 2), r"<[^>]+>", "")
    return F.struct(F.regexp_extract(F.col(html), pattern, 1).alias("ntt_sn"), strip(F.regexp_replace(title, r"(?U)\s+", " ")).alias("title"))


def attachment(html, wanted: str = "규정집") -> Column:
    """struct(key, name): the first attachment whose name has the wanted word and a word
    processor's ending, else the first; null without any."""
    pattern = r'(?s)href="/common/nttFileDownload\.do\?fileKey=([0-9a-f]+)"[^>]*>(.*?)</a>'
    part = lambda i: F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(i))
    files = F.transform(F.arrays_zip(part(1).alias("k"), part(2).alias("n")), lambda f: F.struct(f["k"].alias("key"), strip(F.regexp_replace(F.regexp_replace(f["n"], r"<[^>]+>", ""), r"(?U)\s+", " ")).alias("name")))
    good = F.filter(files, lambda f: f["name"].contains(wanted) & f["name"].rlike(r"\.hwpx?"))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.try_element_at(files, F.lit(1)))


def last_records(progress: DataFrame, key: str = "id", order: str = "line_no") -> DataFrame:
    """The last record of each id of a resume log."""
    rest = [c for c in progress.columns if c not in (key, order)]
    best = progress.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def not_done(rows: DataFrame, progress: DataFrame, key: str = "id") -> DataFrame:
    """What a resumed collection still has to fetch."""
    return rows.join(progress.select(key).distinct(), key, "left_anti")


def stored_text(rows: DataFrame, fields: dict[str, str], body: str = "body") -> DataFrame:
    """``file_name`` and ``content``: a header of ``label: value`` lines, a rule, and the body."""
    head = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in fields.items()]
    return rows.withColumns({"file_name": F.concat(safe_file_name("name"), F.lit(".txt")), "content": F.concat_ws("\n", *head, F.lit(C.BODY_RULE), F.concat(F.col(body), F.lit("\n")))})
