"""Aggregations over logs, catalogues and evaluations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import category_key, strip


def popular_counts(log: DataFrame, question: str = "question", status: str = "status", order: str = "timestamp") -> DataFrame:
    """(query, n, first_seen) of answered questions, by their text without ending marks."""
    q = F.regexp_replace(F.regexp_replace(strip(F.coalesce(question, F.lit(""))), r"(?U)\s+", " "), r"[?？.!]+\z", "")
    rows = log.where(F.col(status) == "answered").select(q.alias("query"), F.col(order).alias("__at"))
    rows = rows.where(F.length("query").between(*C.POPULAR_LENGTH))
    counts = rows.groupBy("query").agg(F.count("*").alias("n"), F.min("__at").alias("first_seen")).where(F.col("n") >= C.POPULAR_LEAST)
    for word in C.POPULAR_STOP:
        counts = counts.where(~F.lower("query").contains(word))
    return counts


def popular(log: DataFrame, limit: int = 8, **columns: str) -> DataFrame:
    """(query, n): the most frequent questions, earlier ones first among equals, and then defaults."""
    asked = popular_counts(log, **columns).orderBy(F.col("n").desc(), "first_seen", "query").limit(limit)
    more = log.sparkSession.createDataFrame([(q, i) for i, q in enumerate(C.POPULAR_DEFAULTS)], "query string, i int").join(asked.select("query"), "query", "left_anti")
    first = asked.select("query", "n", F.lit(0).alias("k"), F.col("first_seen").cast("string").alias("o"), F.lit(0).alias("i"))
    then = more.select("query", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("k"), F.lit("").alias("o"), "i")
    return first.union(then).orderBy("k", F.col("n").desc(), "o", "i", "query").limit(limit).select("query", "n")


def log_summary(log: DataFrame, backend: str = "backend", status: str = "status", took: str = "took_ms") -> DataFrame:
    """(kind, key, n, avg_took_ms): totals, by backend and by status in one pass of grouping sets."""
    rows = log.select(F.coalesce(backend, F.lit("unknown")).alias("backend"), F.coalesce(status, F.lit("unknown")).alias("status"), F.col(took).alias("took"))
    by = rows.rollup("backend").agg(F.count("*").alias("n"), F.avg("took").alias("avg_took_ms"), F.grouping("backend").alias("g"))
    total = by.select(F.when(F.col("g") == 1, "total").otherwise("backend").alias("kind"), F.when(F.col("g") == 1, "").otherwise(F.col("backend")).alias("key"), "n", "avg_took_ms")
    states = rows.groupBy("status").agg(F.count("*").alias("n"), F.avg("took").alias("avg_took_ms")).select(F.lit("status").alias("kind"), F.col("status").alias("key"), "n", "avg_took_ms")
    return total.union(states)


def estimated_cost(log: DataFrame, backend: str = "backend", external: str = "external_api", unit: float = C.COST_PER_CALL) -> DataFrame:
    """(calls, cost) of calls to a paid service."""
    calls = F.count_if(F.col(backend) == external)
    return log.agg(calls.alias("calls"), (calls * unit).alias("cost"))


def contact_groups(rows: DataFrame, keys: list[str], name: str, order: str, shown: int = 3) -> DataFrame:
    """``keys``, n, names: how many rows a contact has, and its first names in order.  The window's
    limit is applied before the shuffle, so a large group sends a few rows only."""
    first = Window.partitionBy(*keys).orderBy(order)
    few = rows.withColumn("__at", F.row_number().over(first)).where(F.col("__at") <= shown)
    names = few.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", F.col(name).alias("x")))), lambda x: x["x"]), ", ").alias("names"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    same = [counts[k].eqNullSafe(names[k]) for k in keys]
    met = counts.join(names, same).select(*[counts[k] for k in keys], "n", "names")
    return met.select(*keys, "n", F.concat("names", F.when(F.col("n") > shown, C.MORE_NAMES).otherwise("")).alias("names"))


def categories_by_source(chunks: DataFrame, source: str = "source", category: str = "category") -> DataFrame:
    """(source, categories): distinct categories in display order."""
    return chunks.groupBy(source).agg(F.transform(F.array_sort(F.collect_set(category_key(category))), lambda x: x["category"]).alias("categories"))


def ordered_categories(chunks: DataFrame, category: str = "category") -> DataFrame:
    """(category, at): all categories in display order."""
    found = chunks.select(category).distinct().agg(F.array_sort(F.collect_set(category_key(category))).alias("c"))
    return found.select(F.posexplode("c").alias("at", "x")).select(F.col("x.category").alias("category"), (F.col("at") + 1).alias("at"))


def catalogue(chunks: DataFrame, source: str = "source", category: str = "category", reg: str = "reg_id") -> DataFrame:
    """(total_chunks, total_regulations, n_sources, n_categories): one row."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct(reg).alias("total_regulations"), F.count_distinct(source).alias("n_sources"), F.count_distinct(category).alias("n_categories"))


def collection_summary(rows: DataFrame, source: str = "source", category: str = "category") -> DataFrame:
    """(source, prefix, n) by the first word of the category."""
    return rows.groupBy(F.col(source).alias("source"), F.element_at(F.split(category, " "), 1).alias("prefix")).agg(F.count("*").alias("n"))


def hits(results: DataFrame, cases: DataFrame, fields: list[str], first: int = 5) -> DataFrame:
    """(qid, hit): whether any of a query's first results has an expected word in its fields, in
    any case.  Cases without expected words are hits.  ``cases`` is (qid, expects)."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in fields]))
    met = cases.join(results.where(F.col("rank") <= first).select("qid", hay.alias("__hay")), "qid", "left")
    one = F.exists("expects", lambda e: F.col("__hay").contains(F.lower(e)))
    return met.groupBy("qid").agg(F.max(F.coalesce((F.size("expects") == 0) | one, F.lit(False))).alias("hit"))


def hit_rate(found: DataFrame, elapsed: str | None = None) -> DataFrame:
    """(n, n_hit, rate) and, if timed, (avg_elapsed, max_elapsed)."""
    timed = [F.avg(elapsed).alias("avg_elapsed"), F.max(elapsed).alias("max_elapsed")] if elapsed else []
    return found.agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hit"), F.avg(F.col("hit").cast("double")).alias("rate"), *timed)


def answer_verdicts(rows: DataFrame) -> DataFrame:
    """``success`` of evaluated answers by what was expected.  Columns: expect_type, hit, answer,
    used_llm, found, foreign_numbers."""
    refused = F.col("answer").contains(C.NOT_FOUND)
    ok = (
        F.when(F.col("expect_type") == "cite", F.col("hit") & ~refused & F.col("used_llm"))
        .when(F.col("expect_type") == "refuse_soft", refused)
        .otherwise(~F.col("found") & (F.col("answer") == C.NOT_FOUND) & ~F.col("used_llm"))
    )
    return rows.withColumns({"success": ok, "guarded": F.col("answer").contains("[자동 검증 경고]"), "invented": F.size("foreign_numbers") > 0})


def answer_report(rows: DataFrame) -> DataFrame:
    """(n, n_success, n_guarded, n_invented): one row."""
    return rows.agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.count_if("guarded").alias("n_guarded"), F.count_if("invented").alias("n_invented"))


def academic_report(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(n, n_hit, rate, n_attached_first): cases whose first results say an expected word in name, article
    title or location, and cases whose first result is a rule of an attached school."""
    rate = hit_rate(hits(results, cases, ["name", "article_title", "location"]))
    first = results.where(F.col("rank") == 1).join(cases.select("qid"), "qid", "left_semi")
    return rate.join(F.broadcast(first.agg(F.count_if(F.col("name").rlike(C.ATTACHED_FIRST)).alias("n_attached_first"))), F.lit(True))


def contacts_by_source(groups: DataFrame, source: str) -> DataFrame:
    """(source, n): how many contacts each source has."""
    return groups.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
