"""BM25 over an index that is built in one pass and may be stored.

The index has a row for each document, with its terms and how often each occurs: terms are
counted inside the row, so nothing is shuffled.  The weights of the terms that questions
ask for go to the rows as matrices of a block of questions each, so that a document's
scores are summed where its row is; very many weights meet the rows in a join instead.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import let, tokens
from ..shipping import attach
from ..spread import spread
from ..storage import keep
from .vector import Best

#: Rows of (question, term) that are broadcast at most; more are joined by a shuffle.
MOST_TERMS = 200_000
#: Questions of a matrix of weights at most, postings that meet one at a time, and rows that are spread out for it.
BLOCK, AT_ONCE, ROWS = 256, 8192, 256
#: Bytes of all matrices, which are broadcast.
MATRIX_BYTES = 64 << 20


class Index(NamedTuple):
    """forward: (doc_id, dl, terms of (term, tf), and columns carried along); frequencies: (term, df); stats: one
    row (n, total)."""

    forward: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def tokenised(docs: DataFrame, id_col: str, text_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("ts"), *carried)


def counted(ts: Column) -> Column:
    """array of (term, tf): the runs of the sorted tokens."""

    def runs(s):
        starts = F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>")), lambda i: (i == 1) | (F.try_element_at(s, i) != F.try_element_at(s, F.greatest(i - 1, F.lit(1)))))
        run = lambda b: F.transform(b, lambda at, j: F.struct(F.element_at(s, at).alias("term"), (F.coalesce(F.try_element_at(b, j + 2), F.size(s) + 1) - at).alias("tf")))
        return let(starts, run)

    return let(F.sort_array(ts), runs)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> Index:
    """The index of ``docs``: its rows are stored once, and all else is read from them.  A null text
    has no terms but counts as a document.  Columns ``carried`` along may narrow ``forward`` before it is
    scored; frequencies and stats stay those of all documents."""
    rows = tokenised(spread(docs.select(id_col, text_col, *carried)), id_col, text_col, carried)
    none = F.array().cast("array<string>")
    return _index(keep(rows.select("doc_id", let(F.coalesce("ts", none), lambda ts: F.struct(F.size(ts).alias("dl"), counted(ts).alias("terms"))).alias("r"), *carried).select("doc_id", "r.dl", "r.terms", *carried), "keyword-index"))


def _index(forward: DataFrame) -> Index:
    frequencies = forward.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return Index(forward, frequencies, forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")))


def write_index(index: Index, path: str) -> None:
    """Stores an index; what is read from it later is neither tokenised nor counted again."""
    index.forward.write.mode("overwrite").parquet(f"{path}/forward")
    stored = _index(index.forward.sparkSession.read.parquet(f"{path}/forward"))
    stored.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
    stored.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("forward", "frequencies", "stats")))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_docs, total_tokens, avgdl): one row."""
    n = tokenised(spread(docs.select(id_col, text_col)), id_col, text_col).agg(F.count("*").alias("n_docs"), F.sum(F.size("ts")).alias("total_tokens"))
    return n.select("n_docs", "total_tokens", (F.col("total_tokens") / F.greatest(F.col("n_docs"), F.lit(1))).alias("avgdl"))


def document_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df)."""
    each = tokenised(spread(docs.select(id_col, text_col)), id_col, text_col).select(F.explode(F.array_distinct("ts")).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def expanded_column(query) -> Column:
    """A query with the official words for what it says, for keyword search only."""
    q = F.col(query) if isinstance(query, str) else query
    parts = [F.when(q.contains(word) & ~q.contains(s), F.lit(s)) for word, synonyms in C.SYNONYMS.items() for s in synonyms]
    return F.concat_ws(" ", q, *parts)


def weights(frequencies: DataFrame, stats: DataFrame, queries: DataFrame) -> tuple[DataFrame, int]:
    """(term, qid, w, avgdl) of the terms that queries ask for and documents have, and how many pairs of a
    query and a term there are."""
    asked = queries.select("qid", F.explode(tokens("text")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    n_asked = asked.count()
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = frequencies.join(F.broadcast(asked) if n_asked <= MOST_TERMS else asked, "term").join(F.broadcast(stats), F.lit(True))
    return known.select("term", "qid", (F.col("qtf") * idf).alias("w"), (F.col("total") / F.col("n")).alias("avgdl")), n_asked


def scores(docs: DataFrame | Index, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = C.K1, b: float = C.B) -> DataFrame:
    """(qid, doc_id, keyword): BM25 of every document that has a query's term.

    ``docs`` is an index, or texts that become one.  ``queries`` is (qid, text); a term that a
    query repeats counts as often.  N, the mean length and document frequencies are those
    of all documents."""
    index = docs if isinstance(docs, Index) else build(docs, id_col, text_col)
    known, n_asked = weights(index.frequencies, index.stats, queries)
    if n_asked <= MOST_TERMS:
        return _met(index.forward, known.toArrow(), k1, b, None)
    return _joined(index.forward, known, k1, b)


def topk(docs: DataFrame | Index, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", k1: float = C.K1, b: float = C.B) -> DataFrame:
    """(qid, doc_id, keyword, rank): the ``k`` best of scores(); of equal scores, at 9 decimals, the smaller id comes
    first.  Only the best of each partition leave it."""
    index = docs if isinstance(docs, Index) else build(docs, id_col, text_col)
    known, n_asked = weights(index.frequencies, index.stats, queries)
    found = _met(index.forward, known.toArrow(), k1, b, k) if n_asked <= MOST_TERMS else _joined(index.forward, known, k1, b)
    order = Window.partitionBy("qid").orderBy(F.round("keyword", 9).desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _joined(forward: DataFrame, known: DataFrame, k1: float, b: float) -> DataFrame:
    """The same as _met() by a join of all postings with the terms asked for."""
    postings = forward.select("doc_id", "dl", F.explode("terms").alias("t")).select("doc_id", "dl", "t.term", "t.tf")
    s = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    each = postings.join(known, "term").select("doc_id", s.alias("s"), "qid", "w")
    return each.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("s")).alias("keyword"))


def _blocks(known: pa.Table) -> list[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(terms, questions, weights of each pair) of so many questions at a time that all matrices have
    MATRIX_BYTES at most: questions that share few words share a matrix with few others."""
    qids, at = pc.unique(known["qid"]), BLOCK
    place = pc.index_in(known["qid"], value_set=qids).to_numpy()
    term = known["term"].combine_chunks().dictionary_encode()
    code = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy().astype(np.int64)
    size = lambda n: 8 * n * len(np.unique(place // n * (len(term) + 1) + code))
    while at > 1 and size(at) > MATRIX_BYTES:
        at //= 2
    out = []
    for a in range(0, len(qids), at):
        block = qids.slice(a, at)
        rows = known.filter(pa.array(place // at == a // at))
        terms = pc.unique(rows["term"])
        weights = np.zeros((len(terms), len(block)))
        weights[pc.index_in(rows["term"], value_set=terms).to_numpy(), pc.index_in(rows["qid"], value_set=block).to_numpy()] = rows["w"].to_numpy()
        out.append((terms, block, weights))
    return out


def _met(forward: DataFrame, known: pa.Table, k1: float, b: float, k: int | None) -> DataFrame:
    """The scores of each row of the index for all questions, or of each partition's ``k`` best for each."""
    spark = forward.sparkSession
    attach(spark)
    mean = known["avgdl"][0].as_py() if known.num_rows else 1.0
    sent = spark.sparkContext.broadcast(_blocks(known))
    qid_type = known.schema.field("qid").type

    def scored(batches):
        """(block, rows' ids, scores of rows and the block's questions)."""
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            ids, dl, lists = batch.columns
            sizes = pc.list_value_length(lists).to_numpy()
            flat = lists.flatten()
            term, tf = flat.field("term"), flat.field("tf").to_numpy().astype(float)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl.to_numpy()[row] / mean))
            for block, (terms, _, weights) in enumerate(sent.value):
                at = pc.fill_null(pc.index_in(term, value_set=terms), -1).to_numpy()
                hit = np.flatnonzero(at >= 0)
                r, t, s = row[hit], at[hit], part[hit]
                edge = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else r
                a = 0
                while a < len(edge):  # whole rows, until they have enough postings
                    z = max(a + 1, int(np.searchsorted(edge, edge[a] + AT_ONCE)))
                    upto = edge[z] if z < len(edge) else len(r)
                    own = slice(edge[a], upto)
                    score = np.add.reduceat(weights[t[own]] * s[own, None], edge[a:z] - edge[a], axis=0)
                    yield block, ids.take(pa.array(r[edge[a:z]])), score
                    a = z

    names = ["qid", "doc_id", "keyword"]

    def run(batches):
        if k is None:
            for block, ids, score in scored(batches):
                i, q = np.nonzero(score)
                yield pa.RecordBatch.from_arrays([sent.value[block][1].take(pa.array(q)), ids.take(pa.array(i)), pa.array(score[i, q])], names)
            return
        best, kind = [Best(questions, weights.T, k) for _, questions, weights in sent.value], None
        for block, ids, score in scored(batches):
            kind = ids.type
            best[block].take(ids.to_numpy(zero_copy_only=False), np.where(score > 0, score, -np.inf).T)
        for b in best:
            yield from b.rows(names, kind)

    kinds = {f.name: f.dataType.simpleString() for f in forward.schema}
    return forward.select("doc_id", "dl", "terms").mapInArrow(run, f"qid {_spark_type(qid_type)}, doc_id {kinds['doc_id']}, keyword double")


def _spark_type(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()
