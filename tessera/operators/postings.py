"""BM25 by inverted lists with block bounds: the best of each question, exactly, without reading all postings.

Documents are dealt to shards, as they lie, and each shard has its own inverted lists, a row for
each term, cut into blocks by ranges of documents.  A posting has what the term's frequency and
the document's length make of a term's weight, and a block the largest of these.  Lists are
stored in folders by buckets of terms; a search reads the buckets of the terms asked for and
shuffles those terms' lists to their shards.  There a question's lists are added up from the
one that can add most on, until the rest together cannot bring a new document among the k
best; from then on only documents that the blocks' bounds leave in the race are looked up.
Only the k best of each question leave a shard.
"""

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..shipping import attach
from ..storage import shared_folder
from . import keyword

#: Documents of a shard, its postings, but for the rows that a step adds, and rows of a step.
SHARD_DOCS, SHARD_POSTINGS, STEP = 1 << 13, 1 << 20, 64
#: Documents of a block's range, buckets of terms, and rows of lists that are sent at a time.
RANGE, BUCKETS, ROWS = 64, 16, 1024
#: Scores are compared at 9 decimals; bounds allow for that, and for the order of sums.
SLACK = 1e-8


class Postings(NamedTuple):
    """lists: (bucket, shard, term, docs, part, block, at, most, ids), where the row of a shard that has no term
    has its documents' ids; frequencies and stats as of keyword.Index."""

    lists: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def _lists(values: np.ndarray, edges: np.ndarray, kind: type = np.int32) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(kind)))


def _inverted(shard: int, ids: pa.Array, base: np.ndarray, k1: float, terms: pa.Array, tf: np.ndarray, sizes: np.ndarray):
    """Batches of a shard's rows: its documents, and its terms in order."""
    names = ["shard", "term", "docs", "part", "block", "at", "most", "ids"]
    none = [pa.nulls(1, pa.list_(k)) for k in (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())]
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), *none, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term = place[coded.indices.to_numpy()]
    by_term = np.argsort(term, kind="stable")
    term, doc, tf = term[by_term], np.repeat(np.arange(len(ids)), sizes)[by_term], tf[by_term]
    part = tf * (k1 + 1) / (tf + base[doc])
    begins = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] // RANGE != doc[:-1] // RANGE)))
    edges = np.searchsorted(term, np.arange(len(order) + 1))
    block_edges = np.searchsorted(begins, edges)
    most = np.maximum.reduceat(part, begins)
    words = coded.dictionary.take(pa.array(order)).cast(pa.string())
    at = begins - np.repeat(edges[:-1], np.diff(block_edges))
    for a in range(0, len(words), ROWS):
        z = min(a + ROWS, len(words))
        own, blocks = slice(edges[a], edges[z]), slice(block_edges[a], block_edges[z])
        e, f = edges[a : z + 1] - edges[a], block_edges[a : z + 1] - block_edges[a]
        columns = [_lists(doc[own], e), _lists(part[own], e, float), _lists(doc[begins[blocks]] // RANGE, f), _lists(at[blocks], f), _lists(most[blocks], f, float)]
        yield pa.RecordBatch.from_arrays([pa.array([shard] * (z - a)), words.slice(a, z - a), *columns, pa.nulls(z - a, pa.list_(ids.type))], names)


def build(index: keyword.Index, path: str | None = None, k1: float = C.K1, b: float = C.B) -> Postings:
    """The inverted lists of a keyword index, stored at ``path``, or in the shared folder.  Nothing is shuffled:
    a shard is a run of rows of a partition."""
    spark = index.forward.sparkSession
    attach(spark)
    n, total = index.stats.select("n", "total").first()
    mean = total / n if n and total else 1.0

    def run(batches):
        part, shard, rows, docs, postings = TaskContext.get().partitionId(), 0, [], 0, 0

        def done():
            ids, dl, lists = (pa.concat_arrays([r.column(i) for r in rows]) for i in range(3))
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
            return _inverted(part << 32 | shard, ids, k1 * (1 - b + b * dl.to_numpy() / mean), k1, flat.field("term"), flat.field("tf").to_numpy(), sizes)

        for batch in batches:
            for a in range(0, batch.num_rows, min(STEP, ROWS)):
                rows.append(batch.slice(a, min(STEP, ROWS)))
                docs += rows[-1].num_rows
                postings += pc.sum(pc.list_value_length(rows[-1].column(2))).as_py() or 0
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield from done()
                    shard, rows, docs, postings = shard + 1, [], 0, 0
        if rows:
            yield from done()

    kind, ints = index.forward.schema["doc_id"].dataType.simpleString(), "array<int>"
    schema = f"shard long, term string, docs {ints}, part array<double>, block {ints}, at {ints}, most array<double>, ids array<{kind}>"
    path = path or f"{shared_folder(spark)}/tessera-postings-{uuid.uuid4().hex}"
    lists = index.forward.select("doc_id", F.col("dl").cast("int").alias("dl"), "terms").mapInArrow(run, schema)
    lists = lists.withColumn("bucket", _bucket("term"))
    lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    lists.limit(0).write.mode("overwrite").parquet(f"{path}/shape")  # without documents, nothing else tells the columns
    index.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    return read(spark, path)


def _bucket(term: str):
    return F.when(F.col(term).isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def read(spark: SparkSession, path: str) -> Postings:
    """What build() has stored."""
    shape = spark.read.parquet(f"{path}/shape").schema
    return Postings(spark.read.schema(shape).parquet(f"{path}/lists"), *(spark.read.parquet(f"{path}/{part}") for part in ("frequencies", "stats")))


class _Shard:
    """The lists of a shard for the terms asked for."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table["ids"][pc.index(pc.is_null(table["term"]), True).as_py()].values
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.argsort(self.ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(self.ids))
        self.table, self.rows = table, {t: i for i, t in enumerate(table["term"].to_pylist()) if t is not None}
        self.lists: dict = {}
        self.sums = np.zeros(len(self.ids))

    def list_of(self, term: str):
        """(documents, parts, blocks' ranges, the largest part of each block)."""
        if term not in self.lists:
            self.lists[term] = tuple(self.table[c][self.rows[term]].values.to_numpy() for c in ("docs", "part", "block", "most"))
        return self.lists[term]

    def every(self, weighed) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read) of all documents with a term."""
        for (docs, part, *_), w in weighed:
            self.sums[docs] += w * part
        return (*self._taken(), sum(len(x[0]) for x, _ in weighed))

    def _taken(self) -> tuple[np.ndarray, np.ndarray]:
        docs = np.flatnonzero(self.sums)
        score = self.sums[docs]
        self.sums[docs] = 0
        return docs, score

    def best(self, weighed, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read) of the ``k`` best."""
        weighed = sorted(weighed, key=lambda x: -x[1] * x[0][3].max())
        rest = np.append(np.cumsum([w * x[3].max() for x, w in weighed][::-1])[::-1], 0.0)
        count, i, least = 0, 0, -np.inf
        for i, ((docs, part, *_), w) in enumerate(weighed):
            if rest[i] < least - SLACK:
                break
            self.sums[docs] += w * part
            count += len(docs)
            if rest[i + 1] < w * part.max() * (i + 1):  # else too much is to come
                have = self.sums[self.sums > 0]
                least = np.partition(have, -k)[-k] if len(have) >= k else least
        else:
            i += 1
        docs, score = self._taken()
        left = score + rest[i] >= least - SLACK
        docs, score = docs[left], score[left]
        later = weighed[i:]
        bound = np.zeros((len(later) + 1, len(docs)))
        for j in reversed(range(len(later))):  # what this and all later lists can add to each, by its blocks
            (_, _, block, most), w = later[j]
            at = np.minimum(np.searchsorted(block, docs // RANGE), len(block) - 1)
            bound[j] = bound[j + 1] + np.where(block[at] == docs // RANGE, w * most[at], 0.0)
        for j, ((own, part, *_), w) in enumerate(later):
            if len(docs) > k:
                least = max(least, np.partition(score, -k)[-k])
                left = score + bound[j] >= least - SLACK
                docs, score, bound = docs[left], score[left], bound[:, left]
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            hit = own[at] == docs
            score = score + np.where(hit, w * part[at], 0.0)
            count += int(hit.sum())
        first = np.lexsort((self.rank[docs], -np.round(score, 9)))[:k]
        return docs[first], score[first], count


def _weights(known: pa.Table) -> list[tuple[int, list[tuple[str, float]]]]:
    """Each question's place, and its terms with their weights."""
    out: dict[int, list] = {}
    for q, t, w in zip(known["q"].to_pylist(), known["term"].to_pylist(), known["w"].to_pylist(), strict=True):
        out.setdefault(q, []).append((t, w))
    return sorted(out.items())


def _of_shard(sent, k: int | None):
    def run(table: pa.Table) -> pa.Table:
        qids, weights = sent.value
        shard = _Shard(table)
        q_at, docs, score, read = [], [], [], []
        for q, terms in weights:
            weighed = [(shard.list_of(t), w) for t, w in terms if t in shard.rows]
            if not weighed:
                continue
            d, s, n = shard.every(weighed) if k is None else shard.best(weighed, k)
            q_at.append(np.full(len(d) + 1, q))
            docs.append(np.append(-1, d))
            score.append(np.append(0.0, s))
            read.append(np.append(n, np.zeros(len(d), np.int64)))
        q_at, docs, score, read = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((q_at, np.int64), (docs, np.int64), (score, float), (read, np.int64)))
        ids = shard.ids.take(pa.array(docs, mask=docs < 0))
        return pa.table([qids.take(pa.array(q_at)), ids, pa.array(score, mask=docs < 0), pa.array(read)], names=["qid", "doc_id", "keyword", "postings_read"])

    return run


def _searched(postings: Postings, queries: DataFrame, k: int | None) -> DataFrame:
    """(qid, doc_id, keyword, postings_read), where a shard's first row of a question, without a document,
    tells what was read for it."""
    spark = postings.lists.sparkSession
    attach(spark)
    known, n_asked = keyword.weights(postings.frequencies, postings.stats, queries)
    passes = max(1, -(-n_asked // keyword.MOST_TERMS))
    id_kind, qid_kind = postings.lists.schema["ids"].dataType.elementType.simpleString(), queries.schema["qid"].dataType.simpleString()
    out = None
    for i in range(passes):
        own = (known if passes == 1 else known.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i)).toArrow().combine_chunks()
        qids = pc.unique(own["qid"])
        own = own.append_column("q", pc.index_in(own["qid"], value_set=qids))
        sent = spark.sparkContext.broadcast((qids, _weights(own)))
        terms = pc.unique(own["term"])
        asked = spark.createDataFrame(pa.table({"term": terms.cast(pa.string())}), "term string")
        buckets = [-1, *(r[0] for r in asked.select(_bucket("term").alias("b")).distinct().collect())]
        rows = postings.lists.where(F.col("bucket").isin(buckets))
        rows = rows.where("term is null").union(rows.join(F.broadcast(asked), "term", "left_semi").select(rows.columns)).drop("bucket")

        part = rows.groupBy("shard").applyInArrow(_of_shard(sent, k), f"qid {qid_kind}, doc_id {id_kind}, keyword double, postings_read long")
        out = part if out is None else out.union(part)
    return out


def topk(postings: Postings, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, keyword, rank): the ``k`` best documents of each question, as keyword.scores() has them;
    of equal scores, at 9 decimals, the smaller id comes first."""
    found = _searched(postings, queries, k).where("keyword is not null").drop("postings_read")
    order = Window.partitionBy("qid").orderBy(F.round("keyword", 9).desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scores(postings: Postings, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, keyword) of every document that has a question's term, from those terms' lists alone."""
    return _searched(postings, queries, None).where("keyword is not null").drop("postings_read")


def read_counts(postings: Postings, queries: DataFrame, k: int | None) -> DataFrame:
    """(qid, postings_read, postings_asked): how many postings a search of the ``k`` best scores, and how many
    the question's terms have; all others are not even looked at."""
    read_ = _searched(postings, queries, k).groupBy("qid").agg(F.sum("postings_read").alias("postings_read"))
    asked = queries.select("qid", F.explode(F.array_distinct(keyword.tokens("text"))).alias("term")).join(postings.frequencies, "term")
    return read_.join(asked.groupBy("qid").agg(F.sum("df").alias("postings_asked")), "qid")
