"""Exact nearest neighbours by cosine: blocks of query vectors meet every batch of vectors as
matrix products, and each partition keeps only its best for every query."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import attach
from ..spread import spread

#: Query vectors of a block, bytes of them that one pass over the vectors meets, and vectors of a product.
BLOCK, PASS_BYTES, ROWS = 2048, 64 << 20, 1024


class Best:
    """The k best so far of each query of a block."""

    def __init__(self, qids: pa.Array, asked: np.ndarray, k: int):
        self.qids, self.asked, self.k = qids, asked, k
        self.value, self.ids = np.full((len(asked), 0), 0.0), None

    def meet(self, ids: np.ndarray, data: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Takes the best of some vectors; ``allowed`` says which ones each query may have."""
        found = self.asked @ data.T
        if allowed is not None:
            found[~allowed] = -np.inf
        self.take(ids, found)

    def take(self, ids: np.ndarray, found: np.ndarray) -> None:
        """Takes the best of some ids by what each query found of them; minus infinity is nothing."""
        value = np.concatenate([self.value, found], 1)
        ids = np.broadcast_to(ids, (len(self.asked), len(ids)))
        ids = ids if self.ids is None else np.concatenate([self.ids, ids], 1)
        if value.shape[1] > self.k:
            low = -np.round(value, 9)
            place = np.argpartition(low, self.k - 1, axis=1)[:, : self.k]
            last = np.take_along_axis(low, place, 1).max(1)
            for q in np.flatnonzero(((low <= last[:, None]).sum(1) > self.k) & (last < np.inf)).tolist():  # equals at the end: smaller ids
                place[q] = np.lexsort((ids[q], low[q]))[: self.k]
            value, ids = np.take_along_axis(value, place, 1), np.take_along_axis(ids, place, 1)
        self.value, self.ids = value, np.array(ids)

    def rows(self, names: list[str], kind: pa.DataType):
        if self.ids is not None and self.ids.shape[1]:
            q, at = np.nonzero(self.value > -np.inf)
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(q)), pa.array(self.ids[q, at].tolist(), kind), pa.array(self.value[q, at])], names)


class Filters:
    """The filter sets of a block of queries: for each attribute the values that a query allows, where
    null and none allow all.  Of a block of vectors every value asked for has a bitmap, and a
    filter set is their union within an attribute, and the meeting of those."""

    def __init__(self, wanted: pa.Table):
        sets = list(zip(*(tuple(tuple(sorted({v for v in x or () if v is not None})) if x else None for x in c.to_pylist()) for c in wanted.columns), strict=True))
        known: dict = {}
        self.of_query = np.array([known.setdefault(s, len(known)) for s in sets], np.int64)
        self.values, self.allow = [], []
        for i in range(wanted.num_columns):
            values = sorted({v for s in known if s[i] for v in s[i]})
            at = {v: j for j, v in enumerate(values)}
            allow = np.zeros((len(known), len(values) + 1), bool)  # the last is of values that no query names
            for j, s in enumerate(known):
                allow[j, slice(None) if s[i] is None else [at[v] for v in s[i]]] = True
            self.values.append(values)
            self.allow.append(allow)

    def allowed(self, columns: list[pa.Array]) -> np.ndarray:
        """Which of some vectors each query may have, by their attributes."""
        found = None
        for column, values, allow in zip(columns, self.values, self.allow, strict=True):
            code = pc.fill_null(pc.index_in(column, value_set=pa.array(values, column.type)), len(values)).to_numpy(zero_copy_only=False)
            each = allow[:, code]
            found = each if found is None else found & each
        return found[self.of_query]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", least: float | None = None, attributes: dict[str, str] | None = None) -> DataFrame:
    """(qid, id, vector): the ``k`` vectors of each query with the largest inner product, smaller
    ids first among equals.  ``queries`` is (qid, vector); null vectors match nothing.

    ``attributes`` has filters that hold before the nearest are taken: columns of ``queries`` with the
    values allowed (null or none: all), each with the column of ``vectors`` that it is about; a
    vector without the attribute is only for queries that allow all.  However many filter sets there
    are, they share a pass: one over the vectors for each 64 MB of query vectors."""
    spark = vectors.sparkSession
    attach(spark)
    attributes = attributes or {}
    kind, names = vectors.schema[id_col].dataType.simpleString(), ["qid", "id", "vector"]
    rows = queries.where("vector is not null").select("qid", "vector", *attributes)
    count, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    n, blocks_a_pass = -(-count // BLOCK), max(1, PASS_BYTES // (8 * BLOCK * max(dims or 1, 1)))
    vectors = spread(vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *(F.col(c).alias(f"a{i}") for i, c in enumerate(attributes.values()))))

    def sent(i):
        block = rows if n <= 1 else rows.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)
        table = block.toArrow().combine_chunks()
        matrix = np.array(table["vector"].to_pylist(), float).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))
        filters = Filters(table.select(list(attributes))) if attributes else None
        return spark.sparkContext.broadcast((pa.array(table["qid"].to_pylist(), table["qid"].type), matrix, filters))

    def searched(blocks):
        def run(batches):
            best = [(Best(*b.value[:2], k), b.value[2]) for b in blocks if len(b.value[1])]
            for batch in batches:
                for a in range(0, batch.num_rows if best else 0, ROWS):
                    part = batch.slice(a, ROWS)
                    data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    for b, filters in best:
                        b.meet(ids, data, filters.allowed(part.columns[2:]) if filters else None)
                kept = batch.column(0).type
            for b, _ in best:
                yield from b.rows(names, kept if b.ids is not None else None)

        return vectors.mapInArrow(run, f"qid {queries.schema['qid'].dataType.simpleString()}, id {kind}, vector double")

    out = None
    for i in range(0, max(n, 1), blocks_a_pass):
        part = searched([sent(j) for j in range(i, min(i + blocks_a_pass, max(n, 1)))])
        out = part if out is None else out.union(part)
    order = Window.partitionBy("qid").orderBy(F.round("vector", 9).desc(), "id")
    out = out.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")
    return out if least is None else out.where(F.col("vector") >= least)
