"""Ranking steps of the hybrid search, each over many queries at once (by qid)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import norm_name, strip

#: Decimals at which scores are compared, so that the order of sums does not decide ties.
TIE = 9


def best_first(*keys: str):
    """Order by score, larger first, and then by the keys."""
    return [F.round("score", TIE).desc(), *(F.col(k) for k in keys)]


def is_question(query) -> Column:
    """Whether a query is a question: a question mark, or three words and an asking form."""
    q = strip(F.col(query) if isinstance(query, str) else query)
    words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    return q.contains("?") | ((words >= C.QUESTION_WORDS) & q.rlike("(?U)" + C.QUESTION_PATTERN))


def candidates(vector: DataFrame, keyword: DataFrame, vector_floor: float = C.VECTOR_FLOOR, keyword_floor: float = C.KEYWORD_FLOOR) -> DataFrame:
    """(qid, chunk_id, vector, keyword) of what either search finds relevant; missing is 0."""
    zero = F.lit(0.0)
    rows = vector.select("qid", "chunk_id", "vector", zero.alias("keyword")).unionByName(keyword.select("qid", "chunk_id", zero.alias("vector"), "keyword"))
    # Each search has a pair once, so the sums are the two values; an aggregate needs no sort, as a join would.
    # Dealt out by chunk, they meet what is known of chunks where they are.
    both = rows.repartition("chunk_id").groupBy("qid", "chunk_id").agg(F.sum("vector").alias("vector"), F.sum("keyword").alias("keyword"))
    return both.where((F.col("vector") >= vector_floor) | (F.col("keyword") > keyword_floor))


def in_force(found: DataFrame, include_repealed: str = "include_repealed", asked: str = "asks_repealed", status: str = "status") -> DataFrame:
    """Without repealed regulations, unless they are asked for; no status counts as in force."""
    return found.where(F.col(include_repealed) | F.col(asked) | (F.coalesce(F.col(status), F.lit(C.IN_FORCE)) != C.REPEALED))


def since(found: DataFrame, since_col: str = "since", date: str = "enforce_date") -> DataFrame:
    """Enforced on or after the query's date, if it gives one; an unknown date never is."""
    day = F.coalesce(F.col(since_col), F.lit(""))
    return found.where((day == "") | (F.coalesce(F.col(date), F.lit("")) >= day))


def minmax(found: DataFrame, *columns: str) -> DataFrame:
    """Each column scaled to 0..1 within the query; all equal: 1 if positive, else 0.  The extremes
    are one aggregate that is joined back, so no query's rows meet in one task."""
    ends = found.groupBy("qid").agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    found = found.join(ends, "qid")
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        scaled = F.when(hi - lo < C.MINMAX_EPSILON, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - lo) / (hi - lo))
        found = found.withColumn(f"{c}_scaled", scaled).drop(f"__lo_{c}", f"__hi_{c}")
    return found


#: What a penalty is called, its pattern and the query pattern that lifts it, its factor, and whose text it reads.
PENALTIES = {"attached": (*C.ATTACHED_SCHOOL, "name"), "non_article": (*C.NON_ARTICLE, "article"), "graduate": (*C.GRADUATE, "name")}


def query_facts(queries: DataFrame, query: str = "text") -> DataFrame:
    """What ranking asks of a query's text, once for each query: ``asks``, ``asks_repealed``, and
    which penalties it does not lift."""
    lifted = {f"may_{k}": ~F.col(query).rlike("(?U)" + asked) for k, (_, asked, _, _) in PENALTIES.items()}
    return queries.withColumns({"asks": is_question(query), "asks_repealed": F.col(query).contains(C.REPEALED), **lifted})


def chunk_facts(chunks: DataFrame, institution: str = "") -> DataFrame:
    """What ranking asks of a chunk's labels, once for each chunk: ``merge_name``, and which
    penalties its labels call for."""
    hits = {f"is_{k}": F.coalesce(F.col(column), F.lit("")).rlike("(?U)" + pattern) for k, (pattern, _, _, column) in PENALTIES.items()}
    return chunks.withColumns({"merge_name": norm_name("name", institution), **hits})


def fused(found: DataFrame) -> DataFrame:
    """``score``: the weighed sum of both scaled scores; questions lean on meaning."""
    found = minmax(found, "vector", "keyword")
    w = lambda i: F.when(F.col("asks"), C.QUESTION_WEIGHTS[i]).otherwise(C.WEIGHTS[i])
    return found.withColumn("score", w(0) * F.col("vector_scaled") + w(1) * F.col("keyword_scaled")).drop("vector_scaled", "keyword_scaled")


def factor() -> Column:
    """What a score is multiplied with, for kinds of text that the query does not ask for."""
    found = F.lit(1.0)
    for k, (_, _, by, _) in PENALTIES.items():
        found = found * F.when(F.col(f"may_{k}") & F.col(f"is_{k}"), by).otherwise(1.0)
    return found


def penalised(found: DataFrame) -> DataFrame:
    """Scores lowered, factor by factor, for kinds of text that the query does not ask for."""
    return found.withColumn("score", F.col("score") * factor())


#: What equal results share.
SAME = ["merge_name", "article", "clause"]


def with_twins(chunks: DataFrame) -> DataFrame:
    """``twin``: whether another chunk has the same name, article and clause, so that they may merge."""
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SAME]
    many = chunks.select(*keys).groupBy(*SAME).agg(F.count("*").alias("__m")).where("__m > 1").withColumn("twin", F.lit(True)).drop("__m")
    same = [F.coalesce(chunks[c], F.lit("")) == many[c] for c in SAME]
    return chunks.join(many, same, "left").select(*[chunks[c] for c in chunks.columns], F.coalesce("twin", F.lit(False)).alias("twin"))


def merged(found: DataFrame) -> DataFrame:
    """One row of equal (merge_name, article, clause): the best; ``also_sources`` has the others'
    sources, but for its own."""
    same = Window.partitionBy("qid", "merge_name", "article", F.coalesce("clause", F.lit("")))
    ranked = found.withColumns({"__at": F.row_number().over(same.orderBy(*best_first("chunk_id"))), "__all": F.collect_set("source").over(same)})
    return ranked.where("__at = 1").withColumn("also_sources", F.array_sort(F.array_except("__all", F.array("source")))).drop("__at", "__all")


def merged_twins(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, chunk_id, source, score, also_sources), as merged() leaves them: only rows with a ``twin`` meet,
    and only they need their ``keys`` (chunk_id and what equal results share)."""
    out = ["qid", "chunk_id", "source", "score", "also_sources"]
    alone = found.where("not twin").withColumn("also_sources", F.array().cast("array<string>"))
    return alone.select(out).union(merged(found.where("twin").join(keys, "chunk_id")).select(out))


def pooled(found: DataFrame, most: int = C.MOST_RESULTS, least: int = C.SOURCE_LEAST) -> DataFrame:
    """All that a query's results can come from: its best, and the best of each of its sources.  A
    source's best are a limit that Spark applies before it shuffles, so no task sorts a query's rows."""
    best = lambda *keys: F.row_number().over(Window.partitionBy("qid", *keys).orderBy(*best_first("chunk_id")))
    each = found.withColumn("__nth", best("source")).where(F.col("__nth") <= max(most, least))
    return each.withColumn("__at", best()).where((F.col("__at") <= most) | (F.col("__nth") <= least)).drop("__at", "__nth")


def reordered(found: DataFrame, top_k: str = "top_k", second: str = "second_score") -> DataFrame:
    """``rank`` by a second model's order among those close to the best; the score stays.  Only the
    first max(10, top_k) take part, and rows beyond them follow in their order."""
    by_score = Window.partitionBy("qid").orderBy(*best_first("chunk_id"))
    found = found.withColumns({"__at": F.row_number().over(by_score), "__top": F.max("score").over(Window.partitionBy("qid"))})
    close = (F.col("__at") <= F.greatest(F.lit(C.RERANK_POOL), F.col(top_k))) & (F.col("score") >= F.col("__top") - C.RERANK_GATE)
    order = Window.partitionBy("qid").orderBy(close.desc(), F.when(close, F.col(second)).desc_nulls_last(), "__at")
    return found.withColumn("rank", F.row_number().over(order)).drop("__at", "__top")


def ranked(found: DataFrame) -> DataFrame:
    """``rank`` by score."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*best_first("chunk_id"))))


def with_sources(found: DataFrame, top_k: str = "top_k", source: str = "source", least: int = C.SOURCE_LEAST, from_k: int = C.SOURCE_FROM_K) -> DataFrame:
    """The first top_k of each query with every source given its due, and ``rank`` anew.

    If top_k is 8 or more and the query filters no source, sources with under three rows
    get their next best ones at the end, in source order; each puts out the last row of
    a source that has more than three, and if there is none, is added all the same.
    What can be put out are a source's fourth and later rows, the last of all sources'
    first, whichever source it makes room for; so it is known without taking turns.
    Only each source's first three and the first top_k of a query take part."""
    of_source = Window.partitionBy("qid", source)
    pool = found.withColumn("__nth", F.row_number().over(of_source.orderBy("rank")))
    first = F.col("rank") <= F.col(top_k)
    pool = pool.where(first | (F.col("__nth") <= least))
    open_ = F.col("free") & (F.col(top_k) >= from_k)
    pool = pool.withColumn("__late", ~first & open_ & (F.count_if(first).over(of_source) < least))
    pool = pool.where(first | F.col("__late")).withColumn("__spare", ~F.col("__late") & (F.col("__nth") > least))
    of_query = Window.partitionBy("qid")
    out_first = F.row_number().over(of_query.orderBy(F.col("__spare").desc(), F.col("rank").desc()))
    pool = pool.withColumns({"__room": F.count_if("__late").over(of_query), "__out": out_first})
    pool = pool.where(~(F.col("__spare") & (F.col("__out") <= F.col("__room"))))
    order = of_query.orderBy("__late", F.when(F.col("__late"), F.col(source)), "rank")
    return pool.withColumn("rank", F.row_number().over(order)).drop("__nth", "__late", "__spare", "__room", "__out")


def by_date(found: DataFrame) -> DataFrame:
    """Rows of queries that sort by date in the order of (enforce_date, score), newest first."""
    dated = F.col("sort") == "date"
    order = Window.partitionBy("qid").orderBy(F.when(dated, F.coalesce("enforce_date", F.lit(""))).desc(), F.when(dated, F.round("score", 4)).desc(), "rank")
    return found.withColumn("rank", F.row_number().over(order))


def grouped(found: DataFrame, name: str = "name") -> DataFrame:
    """(group_rank, group_size): results grouped by regulation in order of first appearance."""
    same = Window.partitionBy("qid", name)
    found = found.withColumns({"__first": F.min("rank").over(same), "group_size": F.count("*").over(same)})
    return found.withColumn("group_rank", F.dense_rank().over(Window.partitionBy("qid").orderBy("__first"))).drop("__first")


def related(found: DataFrame, name: str = "name") -> DataFrame:
    """(qid, related_regulations): distinct names in the order of results."""
    firsts = found.groupBy("qid", name).agg(F.min("rank").alias("at"))
    return firsts.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", name))), lambda x: x[name]).alias("related_regulations"))
