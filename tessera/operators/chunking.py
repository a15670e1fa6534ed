"""Regulation texts to article- and clause-level chunks.

A body becomes its chunks in one projection and an explode: no shuffle, no Python.
Cuts are marked with control characters, which clean texts do not have.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import let, strip

APPENDIX = r"(?Umd)^(부\s*칙|별\s*표|별\s*지|\[별표|〔별표|\[별지)"
ARTICLE = r"(?Umd)^(제\s*\d+\s*조(?:의\s*\d+)?)\s*(\([^)]{1,60}\))?"
CHAPTER = r"(?Umd)^(제\s*\d+\s*장[^\n]{0,60})"
_CUT = "\x01"
_PIECE = "struct<clause:string,text:string>"
META = ["source", "category", "name", "department", "contact", "source_url", "law_url"]


def body_of(text: Column) -> Column:
    """What follows the header's closing rule, else all, with bare ends."""
    at = F.instr(text, C.BODY_RULE)
    return strip(F.when(at > 0, F.substring(text, at + len(C.BODY_RULE), F.length(text))).otherwise(text))


def packed_paragraphs(text: Column, most: int = C.MAX_CHARS) -> Column:
    """Paragraphs packed greedily: one more joins while both lengths, without the newline between
    them, are at most ``most``; a longer single paragraph stays whole."""
    state = lambda out, buf: F.struct(out.alias("out"), buf.alias("buf"))

    def step(s, para):
        full = (F.length(s["buf"]) + F.length(para) > most) & (s["buf"] != "")
        joined = F.when(s["buf"] == "", para).otherwise(F.concat(s["buf"], F.lit("\n"), para))
        return state(F.when(full, F.concat(s["out"], F.array(strip(s["buf"])))).otherwise(s["out"]), F.when(full, para).otherwise(joined))

    rest = lambda s: F.when(strip(s["buf"]) != "", F.concat(s["out"], F.array(strip(s["buf"])))).otherwise(s["out"])
    return F.aggregate(F.split(text, "\n", -1), state(F.array().cast("array<string>"), F.lit("")), step, rest)


def clauses(text: Column, most: int = C.MAX_CHARS) -> Column:
    """array of (clause, text): cut before the second and later clause marks, or else packed."""
    marks = f"[{C.CLAUSE_MARKS}]"

    def numbered(parts):
        # The first piece keeps the heading and the first mark.
        lead = F.concat(F.element_at(parts, 1), F.element_at(parts, 2))
        cut = F.transform(F.concat(F.array(lead), F.slice(parts, 3, F.size(parts) - 2)), strip)
        number = lambda p: F.concat(F.lit("제"), F.instr(F.lit(C.CLAUSE_MARKS), F.substring(p, 1, 1)).cast("string"), F.lit("항"))
        each = F.transform(cut, lambda p, i: F.struct(F.when(p.rlike("^" + marks), number(p)).when(i == 0, "제1항").otherwise("").alias("clause"), p.alias("text")))
        return F.filter(each, lambda p: p["text"] != "")

    plain = F.transform(packed_paragraphs(text, most), lambda p: F.struct(F.lit("").alias("clause"), p.alias("text")))
    parts = F.split(F.regexp_replace(text, f"({marks})", _CUT + "$1"), _CUT, -1)
    return let(parts, lambda p: F.when(F.size(p) >= 3, numbered(p)).otherwise(plain))


def _fitted(text: Column, most: int) -> Column:
    """The text as one piece if it is short enough, else its clauses."""
    return F.when(F.length(text) <= most, F.array(F.struct(F.lit("").alias("clause"), text.alias("text")))).otherwise(clauses(text, most))


def chunk(regulations: DataFrame, id_col: str = "id", body_col: str = "body", most: int = C.MAX_CHARS, carry: list[str] | None = None) -> DataFrame:
    """Chunks of each regulation: chunk_id, reg_id, article, article_title, chapter, clause, text.

    Numbers count every piece; pieces under 15 characters are dropped after that, so ids
    have gaps.  An article's chapter is the nearest heading before it."""
    carry = [c for c in META if c in regulations.columns] if carry is None else carry
    as_chunks = lambda pieces, article, title, chapter, keep_clause=True: F.transform(
        pieces, lambda p: F.struct(article.alias("article"), title.alias("title"), chapter.alias("chapter"), (p["clause"] if keep_clause else F.lit("")).alias("clause"), p["text"].alias("text"))
    )
    empty = F.lit("")
    cut = regulations.select(id_col, *carry, F.split(F.regexp_replace(F.col(body_col), APPENDIX, _CUT + "$0"), _CUT, -1).alias("parts"))
    cut = cut.select(id_col, *carry, F.split(F.regexp_replace(F.element_at("parts", 1), ARTICLE, _CUT + "$0"), _CUT, -1).alias("articles"), F.expr("slice(parts, 2, greatest(size(parts) - 1, 0))").alias("extras"))
    cut = cut.withColumn("head", strip(F.element_at("articles", 1)))
    head = F.col("head")
    preamble = F.when(F.length(head) > C.PREAMBLE_OVER, as_chunks(F.array(F.struct(empty.alias("clause"), head.alias("text"))), F.lit("머리말"), empty, empty)).otherwise(F.array())
    cut = cut.withColumn("headings", F.transform("articles", lambda a: F.try_element_at(F.regexp_extract_all(a, F.lit(CHAPTER), F.lit(1)), F.lit(-1))))
    nearest = lambda i: F.coalesce(F.try_element_at(F.filter(F.slice("headings", F.lit(1), i), lambda h: h.isNotNull()), F.lit(-1)), empty)

    def article(a, i):
        # A piece begins with its label, so the search ends there.
        label = F.regexp_replace(F.regexp_extract(a, ARTICLE, 1), r"(?U)\s+", "")
        title = F.btrim(F.regexp_extract(a, ARTICLE, 2), F.lit("() "))
        meta = F.struct(label.alias("l"), title.alias("t"), strip(F.regexp_replace(nearest(i + 1), r"(?U)\s+", " ")).alias("c"))
        return let(meta, lambda m: as_chunks(_fitted(a, most), m["l"], m["t"], m["c"]))

    bare = F.transform(F.expr("slice(articles, 2, size(articles) - 1)"), strip)
    main = F.flatten(F.transform(bare, article))
    whole = F.when(head != "", as_chunks(clauses(head, most), F.lit("전문"), empty, empty, False)).otherwise(F.array())

    def extra(s):
        label = F.btrim(F.regexp_replace(F.regexp_extract(s, APPENDIX, 1), r"(?U)\s+", ""), F.lit("[〔"))
        return let(label, lambda x: as_chunks(_fitted(s, most), x, empty, empty, False))

    chunks = F.concat(F.when(F.size("articles") > 1, F.concat(preamble, main)).otherwise(whole), F.flatten(F.transform(F.transform("extras", strip), extra)))
    out = cut.select(F.col(id_col).alias("reg_id"), *carry, F.posexplode(chunks).alias("i", "c"))
    out = out.select(
        F.concat(F.col("reg_id").cast("string"), F.lit("#"), F.col("i").cast("string")).alias("chunk_id"), "reg_id", *carry,
        F.col("c.article").alias("article"), F.col("c.title").alias("article_title"), F.col("c.chapter").alias("chapter"), F.col("c.clause").alias("clause"), strip(F.col("c.text")).alias("text"),
    )
    return out.where(F.length("text") >= C.PIECE_LEAST)


def refreshed(old: DataFrame, new: DataFrame, key: str = "reg_id") -> DataFrame:
    """``old`` with the rows of each refreshed key replaced by ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def report(chunks: DataFrame, regulations: DataFrame, id_col: str = "id") -> DataFrame:
    """(reg_id, n_chunks, mean_chars): every regulation, with 0 chunks where chunking failed."""
    counts = chunks.groupBy("reg_id").agg(F.count("*").alias("n_chunks"), F.avg(F.length("text")).alias("mean_chars"))
    return regulations.select(F.col(id_col).alias("reg_id")).distinct().join(counts, "reg_id", "left").select("reg_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "mean_chars")
