"""Collecting boards from landed pages: lists, posts and law pages become regulations and an error list.

Fetching is not done here: ``pages`` hold what a fetcher has landed.  A collection that was
broken off goes on where its log ends.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import boards


def collected(posts: DataFrame, details: DataFrame, laws: DataFrame, progress: DataFrame, source: str, category: str, institutions: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(regulations, errors) of the listed ``posts`` (as boards.board_rows()) that ``progress`` (id) lacks.

    ``details`` is (ntt_sn, html), the posts' own pages, of which the law page's number is read;
    ``laws`` is (law_seq, html).  A post without a detail page, number, law page or text is an
    error, with what was missing."""
    todo = boards.not_done(posts.withColumn("id", F.concat(F.lit(f"{source}:"), "ntt_sn")), progress)
    told = details.select("ntt_sn", boards.law_seq("html").alias("law_seq"), F.lit(True).alias("__detail"))
    texts = boards.law_bodies(laws.select("law_seq", "html", F.lit(True).alias("__law")), institutions=institutions).drop("html")
    met = todo.join(told, "ntt_sn", "left").join(texts, "law_seq", "left")
    why = F.when(F.col("__detail").isNull(), "no page").when(F.col("law_seq").isNull(), "no law number").when(F.col("__law").isNull(), "no law page").when(F.col("body").isNull(), "no text")
    met = met.withColumn("error", why)
    made = met.where("error is null").select("id", F.lit(source).alias("source"), F.lit(category).alias("category"), "name", "department", F.coalesce("contact", F.lit("")).alias("contact"), "rule_no", "date", "law_seq", "body")
    return made, met.where("error is not null").select("id", "name", "error")


def collected_page(page: DataFrame, source: str, category: str, name: str, html: str = "html", institutions: tuple[str, ...] = ()) -> DataFrame:
    """The regulations of single pages that are law pages themselves; pages without a text give none."""
    rows = boards.law_bodies(page.withColumnRenamed(html, "html"), institutions=institutions).where("body is not null")
    return rows.select(F.lit(f"{source}:{name}").alias("id"), F.lit(source).alias("source"), F.lit(category).alias("category"), F.lit(name).alias("name"), F.coalesce("contact", F.lit("")).alias("contact"), "body")

