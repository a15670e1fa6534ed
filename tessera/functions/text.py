"""Text cleaning, names, dates, tokens and excerpts as Column expressions.

Java's ``\\s``, ``\\d`` and ``\\w`` are ASCII unless (?U) is set, and ``trim`` knows only the
space; so patterns that must see Hangul, NBSP or U+3000 carry (?U) here.
"""

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as C


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Fixed value: all characters that are white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_col(text), F.lit(WHITE))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(text) -> Column:
    """No control characters; each line's runs of blanks are one space, and its ends bare; at
    most one empty line in a row; bare ends."""
    t = F.regexp_replace(_col(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{feff}]", "")
    t = F.regexp_replace(t, r"[ \t\x{a0}\x{3000}]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    """All named and numbered character references; Spark has no expression for them."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_closed(s: pd.Series) -> pd.Series:
    """Those that a semicolon ends."""
    closed = re.compile("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[0-9A-Za-z]+);")
    return s.map(lambda t: closed.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0], t), na_action="ignore")


def unescape_html(text, closed: bool = False) -> Column:
    """Character references resolved, or only those that a semicolon ends (``closed``): browsers also resolve
    old ones without it.  Texts without any do not go to Python."""
    t = _col(text)
    return F.coalesce((_unescape_closed if closed else _unescape)(F.when(t.contains("&"), t)), t)


def _without_tags(text) -> Column:
    """What stands after the last closing bracket has no tags, and is not searched for any."""
    t = _col(text)
    tail = F.when(t.contains(">"), F.substring_index(t, ">", -1)).otherwise(t)
    head = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
    head = F.regexp_replace(head, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    head = F.regexp_replace(head, r"(?s)<!--.*?-->", " ")
    head = F.regexp_replace(head, "(?i)" + C.BLOCK_TAGS, "\n")
    head = F.regexp_replace(head, "(?s)" + C.TAG, " ")
    return F.concat(F.regexp_replace(head, r"<[^>]+>", " "), tail)


def html_to_text(text, closed: bool = False) -> Column:
    """What a reader sees of a page: no scripts, comments and tags, references resolved (see unescape_html())."""
    t = unescape_html(_without_tags(text), closed)
    t = F.regexp_replace(t, C.CLICK_RESIDUE, " ")
    return clean_text(_without_attributes(t))


def _without_attributes(t: Column) -> Column:
    """Only texts with an attribute after a quote are searched for its rest, which begins where a run of
    word characters does, or the match before ended: each run is read once."""
    there = t.rlike(r'(?U)"\s+(?:src|value|alt|title)="')
    return F.when(there, F.regexp_replace(t, r"(?U)(?:\G|(?<![\w가-힣 ]))" + C.ATTRIBUTE_RESIDUE, " ")).otherwise(t)


def safe_file_name(name, longest: int = 80) -> Column:
    t = F.regexp_replace(_col(name), r'[\\/:*?"<>|\r\n]+', "_")
    t = strip(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.regexp_replace(F.substring(t, 1, longest), r"^[ ._]+|[ ._]+\z", "")


def without_residue(text) -> Column:
    """Without pieces of markup that earlier cleaning left behind."""
    t = _col(text)
    for pattern in C.JUNK_PATTERNS:
        # A pattern that opens with word characters begins where they do: each run is read once.
        anchored = r"(?:\G|(?<!\w))" if pattern.startswith(r"\w*") else ""
        t = F.regexp_replace(t, "(?U)" + anchored + pattern, " ")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def residue_count(texts, column: str = "text"):
    """(n, n_changed) of a table of texts whose residue goes."""
    new = without_residue(column)
    return texts.agg(F.count("*").alias("n"), F.count_if(~new.eqNullSafe(F.col(column))).alias("n_changed"))


def norm_name(name, institution: str = "") -> Column:
    """A regulation's name as a key: no blanks, dots, hyphens and brackets, and without the name
    of the institution that issues it."""
    t = F.regexp_replace(_col(name), r"(?U)[\s·ㆍ\-()\[\]「」]", "")
    return F.replace(t, F.lit(institution), F.lit("")) if institution else t


def norm_title(text) -> Column:
    return F.regexp_replace(_col(text), r"(?U)[\s·ㆍ・「」『』()\[\]〔〕<>,.'\"‘’“”]+", "")


def loose_title(text) -> Column:
    return F.replace(norm_title(F.regexp_replace(_col(text), r"\[[^\]]*\]", "")), F.lit("산학협력단"), F.lit(""))


_DATE = r"(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})"


def norm_date(text) -> Column:
    """``2026. 5. 9`` as ``2026-05-09``, or empty."""
    part = lambda i: F.regexp_extract(_col(text), r"(?U)^\s*" + _DATE, i)
    return F.when(part(1) == "", "").otherwise(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def law_header(text) -> Column:
    """struct(enforce_date, revision_date, revision_type, rule_no) of the first header; else empty."""
    pattern = r"(?U)\[\s*시행\s*(" + _DATE.replace("(", "(?:") + r")\s*\.?\s*\]\s*\[\s*([^,\]]+?)\s*,\s*(" + _DATE.replace("(", "(?:") + r")\s*\.?\s*,\s*([^\]]+?)\s*\]"
    g = lambda i: F.regexp_extract(_col(text), pattern, i)
    return F.struct(
        norm_date(g(1)).alias("enforce_date"),
        norm_date(g(3)).alias("revision_date"),
        F.regexp_replace(g(4), r"(?U)\s+", "").alias("revision_type"),
        strip(F.regexp_replace(g(2), r"(?U)\s+", " ")).alias("rule_no"),
    )


def revision_history(text) -> Column:
    """struct as law_header()'s from the history lines of a rulebook's text."""
    pattern = rf"(?U)({C.HISTORY_KINDS})\s*[:：]?\s*" + _DATE
    group = lambda i: F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(i))
    hits = F.arrays_zip(group(1).alias("k"), group(2).alias("y"), group(3).alias("m"), group(4).alias("d"))
    hits = F.transform(hits, lambda h: F.struct(h["k"].alias("kind"), F.concat_ws("-", h["y"], F.lpad(h["m"], 2, "0"), F.lpad(h["d"], 2, "0")).alias("date")))
    last, first = F.try_element_at(hits, F.lit(-1)), F.try_element_at(F.filter(hits, lambda h: h["kind"] == "제정"), F.lit(1))
    kind = F.when((last["kind"] == "제정") & (first["date"] == last["date"]), "제정").when(last["kind"] == C.REPEALED, C.REPEALED).when(last["kind"].isNotNull(), "개정")
    date = F.coalesce(last["date"], F.lit(""))
    return F.struct(date.alias("enforce_date"), date.alias("revision_date"), F.coalesce(kind, F.lit("")).alias("revision_type"), F.lit("").alias("rule_no"))


def status(name, revision_type) -> Column:
    return F.when(F.coalesce(_col(name), F.lit("")).contains(C.REPEALED) | F.coalesce(_col(revision_type), F.lit("")).contains(C.REPEALED), C.REPEALED).otherwise(C.IN_FORCE)


def department(department, contact) -> Column:
    """struct(primary, parent, phone): the contact's own department before the listed one."""
    c, d = F.coalesce(_col(contact), F.lit("")), F.coalesce(_col(department), F.lit(""))
    own = strip(F.regexp_replace(c, r"\d[\d-]+", ""))
    pair = r"^([^()]+)\(([^()]+)\)$"
    listed = F.filter(F.transform(F.split(d, ">"), strip), lambda x: x != "")
    inner = F.when(own.rlike(pair), strip(F.regexp_extract(own, pair, 2))).otherwise(own)
    primary = F.when(inner != "", inner).otherwise(F.coalesce(F.try_element_at(listed, F.lit(-1)), F.lit("")))
    parent = F.when(inner == "", F.coalesce(F.try_element_at(listed, F.lit(-2)), F.lit(""))).when(own.rlike(pair), strip(F.regexp_extract(own, pair, 1))).otherwise("")
    phone = F.regexp_extract(c, r"\d{2,4}-\d{3,4}-\d{4}", 0)
    return F.struct(F.when(primary == "", C.UNKNOWN_DEPARTMENT).otherwise(primary).alias("primary"), F.when(parent == primary, "").otherwise(parent).alias("parent"), phone.alias("phone"))


def category_label(category) -> Column:
    pattern = r"(?U)^(제\s*\d+\s*편)\s*(.*)$"
    rest = F.regexp_replace(F.regexp_extract(_col(category), pattern, 2), r"(?U)\s+", " ")
    rest = strip(F.regexp_replace(F.regexp_replace(rest, " 및 ", "·"), "기 타", "기타"))
    return F.when(_col(category).rlike(pattern), F.concat(F.regexp_replace(F.regexp_extract(_col(category), pattern, 1), r"(?U)\s+", ""), F.lit(" "), rest)).otherwise(_col(category))


def category_key(category) -> Column:
    """struct that sorts the fixed categories first, then numbered parts, then the rest."""
    c = _col(category)
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in C.CATEGORY_ORDER.items() for x in kv]), c)
    number = F.regexp_extract(c, r"(?U)^제\s*(\d+)\s*편", 1)
    return F.struct(
        F.when(fixed.isNotNull(), 0).when(number != "", 1).otherwise(2).alias("kind"),
        F.coalesce(fixed.cast("bigint"), F.when(number != "", number.cast("bigint")), F.lit(0).cast("bigint")).alias("number"),
        c.alias("category"),
    )


def tokens(text) -> Column:
    """Lower-case runs of letters, Hangul syllables and digits; single ones only if digits."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit("([0-9A-Za-z가-힣]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) >= C.TOKEN_LEAST) | t.rlike("^[0-9]+$"))


def topic_particle(word) -> Column:
    """은 after a final consonant, 는 after a vowel; 은 after what is no Hangul syllable."""
    code = F.ascii(F.substring(strip(word), -1, 1))
    return F.when((code >= 0xAC00) & (code <= 0xD7A3) & ((code - 0xAC00) % 28 == 0), "는").otherwise("은")


def snippet(text, query, width: int = C.SNIPPET_WIDTH) -> Column:
    """An excerpt of 2 * width around the longest query term that occurs, else from the start."""
    t = _col(text)
    terms = F.regexp_extract_all(_col(query), F.lit("([0-9A-Za-z가-힣]+)"), F.lit(1))
    ranked = F.array_sort(F.transform(terms, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    first = F.try_element_at(F.filter(ranked, lambda r: F.instr(t, r["x"]) > 0), F.lit(1))
    at = F.instr(t, first["x"])
    start = F.when(first.isNull(), 1).otherwise(F.greatest(F.lit(1), at - width // 2))
    cut = strip(F.replace(F.substring(t, start, F.lit(2 * width)), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(cut) >= 2 * width, F.concat(F.substring(cut, 1, 2 * width), F.lit("…"))).otherwise(cut)


def highlight(text, query) -> Column:
    """Escaped text with every query word in <mark>, longer words first, in any case."""
    t = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    words = F.filter(F.split(_col(query), r"(?U)\s+"), lambda w: w != "")
    ranked = F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda r: F.regexp_replace(r["w"], r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    return F.when(F.size(ranked) > 0, F.regexp_replace(t, F.concat(F.lit("(?iu)("), F.array_join(ranked, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(t)


def article_span(full_text, article, chunk_text) -> Column:
    """struct(start, end), from 0, of an article in its regulation's text, or of the chunk's
    beginning; -1 where neither occurs."""
    t, label = _col(full_text), F.regexp_replace(strip(article), r"(?U)\s+", "")
    named = label.rlike(r"(?U)^제\d+조")
    marked = F.regexp_replace(t, F.concat(F.lit(r"(?Ud)(^|\n)(\s*)"), label, F.lit(r"(?![\d의])")), F.concat(F.lit("$1\x01$2"), label))
    begin = F.when(named & marked.contains("\x01"), F.instr(marked, "\x01") - 1).otherwise(-1)
    rest = F.substring(t, begin + F.length(label) + 1, F.length(t))
    ended = F.regexp_replace(rest, r"(?Ud)(\n\s*(?:제\s*\d+조|부\s*칙|별\s*표|별\s*지))", "\x01$1")
    end = F.when(ended.contains("\x01"), begin + F.length(label) + F.instr(ended, "\x01") - 1).otherwise(F.length(t))
    probe = strip(chunk_text)
    at = F.when(F.length(probe) > 0, F.instr(t, F.substring(probe, 1, 40)) - 1).otherwise(-1)
    return F.when(begin >= 0, F.struct(begin.alias("start"), end.alias("end"))).otherwise(
        F.struct(at.alias("start"), F.when(at >= 0, F.least(F.length(t), at + F.length(probe))).otherwise(-1).alias("end"))
    )
