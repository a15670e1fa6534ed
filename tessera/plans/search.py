"""The hybrid search as one plan for any number of queries.

queries: qid, text, vector (array), and the options of OPTIONS where they differ from the
defaults.  chunks: as sources.tables.CHUNK.  regulations: id, enforce_date, status, ...
vectors: chunk_id, embedding.
"""

from collections import OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import snippet
from ..operators import keyword, postings, ranking, vector
from ..storage import keep

OPTIONS = {"top_k": ("int", 10), "sources": ("array<string>", None), "categories": ("array<string>", None), "include_repealed": ("boolean", False), "since": ("string", ""), "sort": ("string", "relevance")}
#: Options that filter chunks, each with the column that it is about, and values of one that narrow an index at most.
FILTERS, MOST_VALUES = {"sources": "source", "categories": "category"}, 1000
REGULATION_FIELDS = ["enforce_date", "revision_date", "revision_type", "rule_no"]


def with_options(queries: DataFrame) -> DataFrame:
    """Every option as a column; null takes the default."""
    for name, (kind, default) in OPTIONS.items():
        given = F.col(name) if name in queries.columns else F.lit(None)
        queries = queries.withColumn(name, F.coalesce(given.cast(kind), F.lit(default).cast(kind)))
    return queries


def checked(queries: DataFrame) -> DataFrame:
    """Queries with a bad date, order or number of results fail when they are read."""
    queries = queries.withColumn("top_k", F.when(F.col("top_k").between(1, C.MOST_RESULTS), F.col("top_k")).otherwise(F.raise_error(F.lit(f"top_k must be 1 to {C.MOST_RESULTS}")).cast("int")))
    bad = (F.col("since") != "") & ~F.col("since").rlike(r"^\d{4}-\d{2}-\d{2}$") | ~F.col("sort").isin("relevance", "date")
    return queries.withColumn("sort", F.when(bad, F.raise_error(F.lit("since must be YYYY-MM-DD, sort relevance or date"))).otherwise(F.col("sort")))


def last_year(today: Column | None = None) -> Column:
    """The day a year before, as the option ``since`` takes it."""
    return F.date_format(F.add_months(F.current_date() if today is None else today, -12), "yyyy-MM-dd")


def searched_text() -> Column:
    """What keyword search reads of a chunk."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "article", "article_title", "text")])


def _allowed(source: str, category: str) -> Column:
    one = lambda wanted, have: F.col(wanted).isNull() | (F.size(wanted) == 0) | F.array_contains(wanted, F.col(have))
    return one("sources", source) & one("categories", category)


def _wanted(index: keyword.Index, queries: DataFrame) -> keyword.Index:
    """The index with only those rows to be scored that the filters of some query allow, where it carries
    what they are about."""
    for wanted, have in FILTERS.items():
        if have in index.forward.columns:
            free = F.col(wanted).isNull() | (F.size(wanted) == 0)
            any_free, values = queries.agg(F.bool_or(free), F.array_distinct(F.flatten(F.collect_set(wanted)))).first()
            values = [v for v in values if v is not None]
            if any_free is False and len(values) <= MOST_VALUES:
                index = index._replace(forward=index.forward.where(F.col(have).isin(values)))
    return index


def _nearest(vectors: DataFrame, queries: DataFrame, meta: DataFrame, pool: int, filtered: bool) -> DataFrame:
    """Filters of source and category hold before the nearest are taken, all of them in the same pass.
    Vectors that are stored with ``source`` and ``category`` need no join for that."""
    attributes = FILTERS if filtered else None
    if filtered and not {"source", "category"} <= set(vectors.columns):
        vectors = vectors.select("chunk_id", "embedding").join(meta.select("chunk_id", "source", "category"), "chunk_id", "left")
    found = vector.nearest(vectors, queries.select("qid", "vector", *(attributes or ())), pool, "chunk_id", "embedding", attributes=attributes)
    return found.select("qid", F.col("id").alias("chunk_id"), "vector")


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, regulations: DataFrame | None = None, institution: str = "", reranker: Callable[[pd.Series, pd.Series], pd.Series] | None = None, pool: int = C.VECTOR_POOL, vector_floor: float = C.VECTOR_FLOOR, index: keyword.Index | postings.Postings | None = None) -> DataFrame:
    """(qid, rank, and the fields of a result) for every query.

    ``index`` is a stored keyword index of the chunks, or its inverted lists; without one it is built.  ``reranker`` scores
    pairs of (query, text) batch by batch; without one, and where it fails, the order is
    that of the scores.  Chunks without a vector, or vectors without a chunk, are no error."""
    filtered = "sources" in queries.columns or "categories" in queries.columns
    queries = checked(with_options(queries))
    meta = chunks.select("chunk_id", "reg_id", "source", "category", "name", "article", "clause")
    near = _nearest(vectors, queries, meta, pool, filtered)
    carried = tuple(FILTERS.values()) if filtered else ()
    index = index or keyword.build(chunks.select("chunk_id", searched_text().alias("text"), *carried), "chunk_id", "text", carried)
    index = _wanted(index, queries) if filtered and isinstance(index, keyword.Index) else index
    asked = queries.select("qid", keyword.expanded_column("text").alias("text"))
    words = (postings if isinstance(index, postings.Postings) else keyword).scores(index, asked).withColumnRenamed("doc_id", "chunk_id")
    found = ranking.candidates(near, words, vector_floor)

    fields = ["status", *REGULATION_FIELDS]
    if regulations is not None:
        have = [c for c in fields if c in regulations.columns]
        meta = meta.join(regulations.select(F.col("id").alias("reg_id"), *have), "reg_id", "left")
    meta = meta.withColumns({c: F.lit(None).cast("string") for c in fields if c not in meta.columns})
    # Narrow rows that are read several times, and would else be made of the texts each time.
    meta = keep(ranking.with_twins(ranking.chunk_facts(meta, institution).drop("name")), "chunk-facts")
    facts = ranking.query_facts(queries).drop("vector", "text")
    few = queries.count() <= keyword.MOST_TERMS
    small = lambda df: F.broadcast(df) if few else df
    about = meta.select("chunk_id", "source", "category", "status", "enforce_date", "twin", *(f"is_{k}" for k in ranking.PENALTIES))
    found = found.join(about, "chunk_id").join(small(facts), "qid").where(_allowed("source", "category"))
    # Read several times from here on, so both searches run once, and rows are narrow; the rest comes back with the pool.
    found = ranking.since(ranking.in_force(found))
    found = keep(found.select("qid", "chunk_id", "vector", "keyword", "source", "twin", "asks", ranking.factor().alias("factor")), "candidates")
    scored = ranking.fused(found).withColumn("score", F.col("score") * F.col("factor"))
    found = ranking.merged_twins(scored.select("qid", "chunk_id", "source", "score", "twin"), meta.select("chunk_id", *ranking.SAME))
    found = ranking.pooled(found).join(small(queries.select("qid", "text", "top_k", "sources", "sort")), "qid")
    found = found.withColumn("free", F.col("sources").isNull() | (F.size("sources") == 0)).drop("sources")
    found = _reranked(found, chunks, reranker) if reranker else ranking.ranked(found)
    # The results are few as a rule, and meet the chunks where these lie.
    found = keep(ranking.with_sources(found), "results")
    few = found.count() <= keyword.MOST_TERMS
    found = ranking.by_date(small(found).join(meta.drop("source", "merge_name", "twin", *(f"is_{k}" for k in ranking.PENALTIES)), "chunk_id"))

    rest = chunks.select("chunk_id", "name", F.col("text").alias("__text"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("article_title", "chapter", "department", "contact", "source_url", "law_url") if c in chunks.columns))
    found = small(found).join(rest, "chunk_id")
    location = F.concat_ws(" ", "article", F.when(F.coalesce("clause", F.lit("")) != "", F.col("clause")))
    return found.select(
        "qid", "rank", "chunk_id", "reg_id", "source", "category", "name", "article", F.coalesce("clause", F.lit("")).alias("clause"), location.alias("location"), *[c for c in rest.columns if c not in ("chunk_id", "name", "__text")],
        snippet("__text", "text").alias("snippet"), *(F.coalesce(c, F.lit("")).alias(c) for c in REGULATION_FIELDS), F.coalesce("status", F.lit(C.IN_FORCE)).alias("status"), "also_sources", F.round("score", 4).alias("score"),
    )


def _reranked(found: DataFrame, chunks: DataFrame, reranker) -> DataFrame:
    """A second model's order of the best of each query; only these rows meet the model.  A query
    whose scores are not all there keeps its order."""
    found = ranking.ranked(found)
    best = found.where(F.col("rank") <= F.greatest(F.lit(C.RERANK_POOL), F.col("top_k"))).select("qid", "chunk_id", F.col("text").alias("q")).join(chunks.select("chunk_id", F.col("text").alias("t")), "chunk_id")
    model = _model(reranker)
    scored = best.select("qid", "chunk_id", model("q", "t").alias("second_score"))
    whole = scored.groupBy("qid").agg(F.bool_and(F.col("second_score").isNotNull()).alias("__whole"))
    found = found.drop("rank").join(scored, ["qid", "chunk_id"], "left").join(whole, "qid", "left")
    found = found.withColumn("second_score", F.when(F.col("__whole"), F.col("second_score"))).drop("__whole")
    return ranking.reordered(found)


def _model(reranker):
    """Scores by ``reranker``, null from the first failure of a task on: those rows keep their order."""
    failed = []

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        if not failed:
            try:
                return pd.Series(reranker(q, t), index=q.index, dtype=float)
            except Exception as e:  # a model that does not load or run must not stop the search
                failed.append(e)
        return pd.Series([None] * len(q), index=q.index, dtype=float)

    return score


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The chunk of an id, or no row."""
    return chunks.where(F.col("chunk_id") == chunk_id)


def regulation_text(regulations: DataFrame, bodies: DataFrame, reg_id: str) -> DataFrame:
    """A regulation with its ``full_text``; no row if there is no such regulation, or its file is gone.
    Stored paths may have backslashes, and be relative to where ``bodies`` are."""
    path = F.replace("text_file", F.lit("\\"), F.lit("/"))
    one = regulations.where(F.col("id") == reg_id).withColumn("__path", path)
    files = bodies.select(F.col("text_file").alias("__file"), F.col("body").alias("full_text"))
    return one.join(files, F.col("__file").endswith(F.concat(F.lit("/"), F.col("__path"))) | (F.col("__file") == F.col("__path"))).drop("__path", "__file")


class ResultCache:
    """The latest small results by all their parameters, for interactive use."""

    def __init__(self, most: int = C.CACHE_SIZE):
        self.most, self.rows = most, OrderedDict()

    def get(self, key, make: Callable[[], list]) -> tuple[list, bool]:
        """(rows, whether they were cached)."""
        if key in self.rows:
            self.rows.move_to_end(key)
            return self.rows[key], True
        self.rows[key] = make()
        if len(self.rows) > self.most:
            self.rows.popitem(last=False)
        return self.rows[key], False
