"""Rulebooks: zipped XML to paragraphs, their table of contents, and the split into regulations."""

import difflib
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import clean_text, loose_title, norm_title, strip
from ..shipping import attach
from ..storage import keep


def paragraphs(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, pos, text): paragraphs of each file, sections in the order of their numbers.

    ``files`` is as spark.read.format("binaryFile") gives it.  Only unzipping is Python; files
    that are no archives, or have no sections, give no rows."""

    attach(files.sparkSession)
    def sections(batches):
        for table in batches:
            out = []
            for path, data in zip(table[path_col], table[content_col], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        names = [(int(m[1]), n) for n in z.namelist() if (m := re.match(r"Contents/section(\d+)\.xml", n))]
                        out += [(path, i, z.read(n).decode("utf-8", "replace")) for i, n in sorted(names)]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["path", "section", "xml"])

    xml = files.select(path_col, content_col).mapInPandas(sections, "path string, section int, xml string")
    each = xml.select("path", "section", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<hp:p[ >].*?</hp:p>"), F.lit(0))).alias("at", "p"))
    text = F.array_join(F.regexp_extract_all("p", F.lit(r"(?s)<hp:t[^>]*>(.*?)</hp:t>"), F.lit(1)), "")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = clean_text(F.regexp_replace(text, r"(?U)HWPHYPERLINK\S*", ""))
    order = Window.partitionBy("path").orderBy("section", "at")
    return each.select("path", (F.row_number().over(order) - 1).alias("pos"), text.alias("text"))


def contents(paras: DataFrame) -> DataFrame:
    """(path, pos, no, name, part, department, page_start, page_end): the table of contents, from
    the first 800 paragraphs; pages and department stand in the paragraphs after a name."""
    w = Window.partitionBy("path").orderBy("pos")
    ahead = {f"__{i}": F.lead("text", i).over(w) for i in range(1, 6)}
    part = F.when(F.col("text").rlike(r"(?U)^제\s*(\d+)\s*편\s*(.+)$"), F.concat(F.lit("제"), F.regexp_extract("text", r"(?U)^제\s*(\d+)\s*편\s*(.+)$", 1), F.lit("편 "), strip(F.regexp_extract("text", r"(?U)^제\s*(\d+)\s*편\s*(.+)$", 2))))
    # One paragraph more than is read may be looked at ahead.
    rows = paras.where(F.col("pos") < C.TOC_PARAGRAPHS + 5).withColumns(ahead).withColumn("__part", part)
    rows = rows.withColumn("part", F.coalesce(F.last("__part", ignorenulls=True).over(w), F.lit(""))).where(F.col("pos") < C.TOC_PARAGRAPHS)
    entry = r"(?U)^(\d{1,3})[.\s]\s*(.+?)\s*$"
    title = F.regexp_extract("text", entry, 2)
    rows = rows.where(F.col("__part").isNull() & title.rlike(rf"(?U)({C.RULE_NOUNS})\s*(\[[^\]]*\])?\s*$"))
    paged = F.col("__1").rlike(r"(?U)^\d+$") & F.col("__2").isin("~", "∼", "〜", "～") & F.col("__3").rlike(r"(?U)^\d+$")
    office = F.coalesce(*[F.when(F.col(f"__{i}").rlike(r"^[가-힣]+(과|실|센터|단)$"), F.col(f"__{i}")) for i in range(1, 6)], F.lit(""))
    return rows.select("path", "pos", F.regexp_extract("text", entry, 1).cast("int").alias("no"), strip(F.regexp_replace(title, r"(?U)\s+", " ")).alias("name"), "part", office.alias("department"), F.when(paged, F.col("__1").cast("int")).alias("page_start"), F.when(paged, F.col("__3").cast("int")).alias("page_end"))


def contents_end(paras: DataFrame, toc: DataFrame) -> DataFrame:
    """(path, toc_end): the last paragraph of the table of contents."""
    parts = paras.where((F.col("pos") < C.TOC_PARAGRAPHS) & F.col("text").rlike(r"(?U)^제\s*(\d+)\s*편\s*(.+)$")).select("path", "pos")
    return parts.union(toc.select("path", "pos")).groupBy("path").agg(F.max("pos").alias("toc_end"))


def start_pages(toc: DataFrame, names: DataFrame) -> DataFrame:
    """(name, page_start): where a regulation of just this name starts, each name once."""
    first = toc.where("page_start is not null").groupBy("name").agg(F.min_by("page_start", "pos").alias("page_start"))
    return names.select("name").distinct().join(first, "name")


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks; edit distance is another measure."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def _numbered(text) -> F.Column:
    """A text's characters, each with how often it came before: a set that overlaps as the characters do."""
    chars = F.sort_array(F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0)))
    # Inside an array of its own, so that it is made once and not for each character.
    return F.transform(F.array(chars), lambda cs: F.transform(cs, lambda c, i: F.concat(c, (i - F.array_position(cs, c)).cast("string"))))[0]


def title_candidates(entries: DataFrame, shaped: DataFrame) -> DataFrame:
    """(path, pos, p, loose, other): pairs of an entry (path, pos, m, loose) and a paragraph (path, p, n, other)
    whose characters allow a ratio of matching blocks of 0.9 or more, of lengths 15 apart at most.

    Blocks match no more characters than both have.  For the ratio both must share 9 of 20 of all characters, so
    9 of 11 of each; hence two of the rarest L - ceil(9 L / 11) + 2 of its L are among as many
    of the other's (of one, that one), and pairs are an equi-join by file and two such characters:
    an alphabet is soon used up by many titles, its pairs are not."""
    pairs = _met_pairs(entries, shaped)
    shared = F.size(F.array_intersect(_numbered(F.col("loose")), _numbered(F.col("other"))))
    return pairs.where(F.col("both") * 9 <= shared * 20).drop("both")


def _met_pairs(entries: DataFrame, shaped: DataFrame) -> DataFrame:
    """The pairs of title_candidates() before all of their characters are compared, with how many ``both`` have."""
    spans = entries.groupBy("path").agg((F.min("m") - 15).alias("least"), (F.max("m") + 15).alias("most"))
    shaped = keep(shaped.join(spans, "path").where("n between least and most").drop("least", "most"), "titles-shaped")
    sides = [df.withColumn("t", F.explode(_numbered(F.col(text)))) for df, text in ((entries, "loose"), (shaped, "other"))]
    times = sides[0].select("t").union(sides[1].select("t")).groupBy("t").agg(F.count("*").alias("times"))

    def rarest(side, keys):
        rows = side.join(times, "t").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("times", "t"))).alias("ts"))
        size = F.size("ts")
        rows = rows.select(*keys, size.alias("size_" + keys[1]), F.slice("ts", F.lit(1), size - F.floor((size * 9 + 10) / 11).cast("int") + 2)["t"].alias("ts"))
        two = F.flatten(F.transform("ts", lambda a, i: F.transform(F.slice("ts", i + 2, F.size("ts")), lambda b: F.xxhash64(a, b))))
        return rows.withColumn("x", F.explode(F.when(F.size("ts") < 2, F.transform("ts", lambda a: F.xxhash64(a))).otherwise(two))).drop("ts")

    pairs = rarest(sides[0], ["path", "pos", "m", "loose"]).join(rarest(sides[1], ["path", "p", "n", "other"]), ["path", "x"])
    both = F.col("size_pos") + F.col("size_p")
    pairs = pairs.where((F.abs(F.col("n") - F.col("m")) <= 15) & (both * 9 <= F.least("size_pos", "size_p") * 20))
    return pairs.select("path", "pos", "p", "loose", "other", both.alias("both")).distinct()


def titles(paras: DataFrame, toc: DataFrame) -> DataFrame:
    """``toc`` with ``start``: the first paragraph that is an entry's title, or null.

    The same normalised title comes before the same loose one, and that before the most like
    of at least 0.9.  All three are equi-joins: only pairs that title_candidates() leaves are compared."""
    body = paras.join(contents_end(paras, toc), "path").where("pos > toc_end and text <> ''").select("path", F.col("pos").alias("p"), F.col("text").alias("t"))
    body = body.select("*", norm_title("t").alias("exact"), loose_title("t").alias("loose"), F.length("t").alias("n"))
    entries = toc.select("*", norm_title("name").alias("exact"), loose_title("name").alias("loose"), F.length("name").alias("m"))
    by_title = lambda key, more: entries.join(body.select("path", key, "p", "n"), ["path", key]).where(F.col("n") <= F.col("m") + more).groupBy("path", "pos").agg(F.min("p").alias(key + "_at"))
    found = entries.join(by_title("exact", 30), ["path", "pos"], "left").join(by_title("loose", 40), ["path", "pos"], "left")
    found = found.withColumn("start", F.coalesce("exact_at", "loose_at"))
    shaped = body.where(~F.col("t").startswith("제") & F.col("t").rlike(rf"(?U)({C.RULE_NOUNS})\s*$")).select("path", "p", "n", F.col("loose").alias("other"))
    found = keep(found, "titles-found")  # read several times below
    near = title_candidates(found.where("start is null").select("path", "pos", "m", "loose"), shaped).withColumn("r", _likeness("other", "loose"))
    best = near.groupBy("path", "pos").agg(F.max(F.struct("r", (-F.col("p")).alias("q"))).alias("b")).where(F.col("b.r") >= C.TITLE_RATIO)
    found = found.join(best.select("path", "pos", (-F.col("b.q")).alias("like_at")), ["path", "pos"], "left")
    return found.withColumn("start", F.coalesce("start", "like_at")).select(*toc.columns, "start")


#: Paragraphs of a stretch, by which paragraphs meet the entries that reach into it.
STRETCH = 1024


def split(paras: DataFrame, toc: DataFrame) -> DataFrame:
    """``toc`` with ``body``: paragraphs from an entry's title to the next title, none for all but the last of
    entries of one title; entries whose title is not found have no row (see missing()).

    Entries and paragraphs meet by file and stretch, so no file is one task's work."""
    starts = titles(paras, toc).where("start is not null")
    ends = starts.withColumn("__end", F.lead("start", 1).over(Window.partitionBy("path").orderBy("start", "pos")))
    ends = ends.join(paras.groupBy("path").agg(F.max("pos").alias("__last")), "path").withColumn("__end", F.coalesce("__end", F.col("__last") + 1))
    stretch = lambda c: F.floor(c / STRETCH)
    ends = ends.withColumn("__s", F.explode(F.sequence(stretch(F.col("start")), stretch(F.greatest(F.col("start"), F.col("__end") - 1)))))
    lines = paras.where("text <> ''").select(F.col("path").alias("__path"), F.col("pos").alias("p"), F.col("text").alias("__text"), stretch(F.col("pos")).alias("__at"))
    met = ends.join(lines, (F.col("path") == F.col("__path")) & (F.col("__s") == F.col("__at")) & (F.col("p") >= F.col("start")) & (F.col("p") < F.col("__end")), "left")
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "__text")))), lambda x: x["__text"])
    return met.groupBy(*toc.columns).agg(clean_text(F.array_join(texts, "\n")).alias("body"))


def missing(paras: DataFrame, toc: DataFrame) -> DataFrame:
    """Names of entries without a title in the text."""
    return titles(paras, toc).where("start is null").select("name")
