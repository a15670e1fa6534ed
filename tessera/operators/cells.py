"""Approximate nearest neighbours: vectors in cells around trained centroids, with product-quantised codes.

Centroids are trained by rounds of assignment and averaging, each of which is one pass over a
bounded sample of vectors that sends a sum for each cell and partition.  What a vector differs
from its centroid by is cut into parts, each told by one byte, the number of the nearest of 256
trained ones.  A search probes the cells nearest to a query, reads their codes only, keeps the
best by codes, and scores those exactly by their vectors.
"""

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import attach
from ..spread import spread
from ..storage import delete, keep, shared_folder
from . import vector as exact

#: Vectors that train on at most for each centroid (a seeded choice), rounds, parts of a code, and its numbers.
TRAIN_EACH, ROUNDS, PARTS, NUMBERS = 256, 10, 16, 256
#: Candidates that are scored exactly for each result.
RESCORE = 10


class Cells(NamedTuple):
    """codes: (cell, id, code); vectors: (cell, id, embedding); centroids: [cells, d]; books: [parts, 256, d / parts]."""

    codes: DataFrame
    vectors: DataFrame
    centroids: np.ndarray
    books: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row."""
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 1024] @ centroids.T - half, 1) for a in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def _coded(x: np.ndarray, centroids: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, numbers of each part) of vectors."""
    cell = _nearest_of(x, centroids)
    rest = (x - centroids[cell]).reshape(len(x), len(books), -1)
    return cell, np.stack([_nearest_of(rest[:, s], book) for s, book in enumerate(books)], 1) if len(x) else np.zeros((0, len(books)), np.int64)


def _rounds(sample: DataFrame, parts, books: np.ndarray, rounds: int) -> np.ndarray:
    """Books [parts, numbers, width] after so many rounds over the column ``v`` of a stored table; ``parts``
    makes [rows, parts, width] of vectors.  A number without vectors stays where it is."""
    spark = sample.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def run(batches, sent=sent):
            books = sent.value
            sums, counts = np.zeros(books.shape), np.zeros(books.shape[:2])
            for batch in batches:
                x = parts(_matrix(batch.column(0)))
                for s, book in enumerate(books):
                    own = _nearest_of(x[:, s], book)
                    np.add.at(sums[s], own, x[:, s])
                    counts[s] += np.bincount(own, minlength=len(book))
            for s, c in zip(*np.nonzero(counts), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(s)]), pa.array([int(c)]), pa.array([sums[s, c].tolist()]), pa.array([counts[s, c]])], ["s", "c", "x", "n"])

        each = sample.select("v").mapInArrow(run, "s long, c long, x array<double>, n double").select("s", "c", "n", F.posexplode("x").alias("d", "x"))
        found = each.groupBy("s", "c", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
        books = books.copy()
        s, c, d, x, n = (found[i].to_numpy() for i in ("s", "c", "d", "x", "n"))
        books[s, c, d] = x / n
        sent.destroy()
    return books


def build(vectors: DataFrame, cells: int, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, rounds: int = ROUNDS, seed: int = 7, path: str | None = None) -> Cells:
    """Trains on a seeded choice of about TRAIN_EACH vectors a cell (of all, if there are no more), and stores
    every vector by cell, and its code apart.  The dimension is a multiple of ``parts``; null vectors are
    left out; fewer vectors than ``cells`` or 256 make so many cells or numbers."""
    spark = vectors.sparkSession
    attach(spark)
    rows = spread(vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")))
    many = rows.count()
    share = max(1, many // (TRAIN_EACH * max(cells, NUMBERS)))
    order = F.xxhash64(F.lit(seed), "id")
    sample = keep(rows.where(F.pmod(order, F.lit(share)) == 0).select("id", F.col("embedding").alias("v")), "cell-sample")
    first = _matrix(sample.orderBy(order, "id").limit(max(cells, NUMBERS)).select("v").toArrow().combine_chunks()["v"].combine_chunks()) if many else np.zeros((1, parts))
    centroids = _rounds(sample, lambda x: x[:, None, :], first[None, :cells], rounds)[0]
    rest = lambda x: (x - centroids[_nearest_of(x, centroids)]).reshape(len(x), parts, -1)
    books = _rounds(sample, rest, np.ascontiguousarray(rest(first[:NUMBERS]).transpose(1, 0, 2)), rounds)
    delete(sample)
    sent = spark.sparkContext.broadcast((centroids, books))

    def run(batches):
        for batch in batches:
            cell, code = _coded(_matrix(batch.column(1)), *sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), *batch.columns], ["cell", "code", "id", "embedding"])

    kinds = dict(rows.dtypes)
    coded = rows.mapInArrow(run, f"cell int, code binary, id {kinds['id']}, embedding {kinds['embedding']}")
    path = path or f"{shared_folder(spark)}/tessera-cells-{uuid.uuid4().hex}"
    # Ranges by cell, so that files skip by it; large cells are dealt to several tasks.
    coded.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    stored.select("cell", "id", "code").write.mode("overwrite").parquet(f"{path}/codes")
    for name, array in (("centroids", centroids[None]), ("books", books)):
        flat = [(s, c, array[s, c].tolist()) for s in range(array.shape[0]) for c in range(array.shape[1])]
        spark.createDataFrame(pa.table({"s": [r[0] for r in flat], "c": [r[1] for r in flat], "x": [r[2] for r in flat]})).write.mode("overwrite").parquet(f"{path}/{name}")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Cells:
    """What build() has stored."""

    def array(name):
        t = spark.read.parquet(f"{path}/{name}").orderBy("s", "c").toArrow().combine_chunks()
        x = _matrix(t["x"].combine_chunks())
        return x.reshape(len(set(t["s"].to_pylist())), -1, x.shape[1])

    vectors = spark.read.parquet(f"{path}/vectors").select("cell", "id", "embedding")
    return Cells(spark.read.parquet(f"{path}/codes"), vectors, array("centroids")[0], array("books"))


def _probed(centroids: np.ndarray, asked: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each query, by inner product."""
    score = asked @ centroids.T
    return np.argsort(-score, 1, kind="stable")[:, : min(probes, len(centroids))]


def nearest(index: Cells, queries: DataFrame, k: int, probes: int, rescore: int | None = RESCORE) -> DataFrame:
    """(qid, id, vector): ``k`` vectors of each query with large inner products, of the ``probes`` cells nearest
    to it, larger ones first, then smaller ids.  Of these cells' vectors, ``rescore`` times ``k`` are chosen
    by codes and scored exactly; None scores all exactly, so that with all cells the result is that
    of vector.nearest().  ``queries`` is (qid, vector); null vectors match nothing."""
    spark = index.codes.sparkSession
    attach(spark)
    rows = queries.where("vector is not null").select("qid", "vector")
    count, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    passes = max(1, -(-count * 8 * (dims or 1) // exact.PASS_BYTES))
    most = k if rescore is None else k * rescore
    id_kind, qid_kind = (d.schema[c].dataType.simpleString() for d, c in ((index.codes, "id"), (queries, "qid")))
    centroids, books = index.centroids, index.books
    out = None
    for i in range(passes):
        table = (rows if passes == 1 else rows.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i)).toArrow().combine_chunks()
        asked = np.array(table["vector"].to_pylist(), float).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, centroids.shape[1]))
        cells = _probed(centroids, asked, probes)
        by_cell = {int(c): np.flatnonzero((cells == c).any(1)) for c in np.unique(cells)}
        sent = spark.sparkContext.broadcast((pa.array(table["qid"].to_pylist(), table["qid"].type), asked, by_cell, centroids, books))
        source = (index.vectors if rescore is None else index.codes).where(F.col("cell").isin(list(by_cell)) if len(by_cell) < 1000 else F.lit(True))

        def run(batches, sent=sent):
            qids, asked, by_cell, centroids, books = sent.value
            best: dict[int, exact.Best] = {}
            for batch in batches:
                cell = batch.column(0).to_numpy()
                edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)) if len(cell) else [0]
                for a, z in zip(edge[:-1], edge[1:], strict=True):
                    who = by_cell.get(int(cell[a]), ())
                    for p in range(a, z if len(who) else a, exact.ROWS):
                        part = batch.slice(p, min(exact.ROWS, z - p))
                        if rescore is None:
                            x = _matrix(part.column(2))
                        else:  # what codes stand for
                            code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                            x = centroids[cell[a]] + np.concatenate([book[code[:, s]] for s, book in enumerate(books)], 1)
                        c = int(cell[a])
                        if c not in best:
                            best[c] = exact.Best(qids.take(pa.array(who)), asked[who], most)
                        best[c].meet(part.column(1).to_numpy(zero_copy_only=False), x)
            for b in best.values():
                yield from b.rows(["qid", "id", "vector"], id_type(b))

        def id_type(b):
            return pa.array(b.ids.ravel()[:1].tolist()).type

        part = source.select("cell", "id", "embedding" if rescore is None else "code").mapInArrow(run, f"qid {qid_kind}, id {id_kind}, vector double")
        out = part if out is None else out.union(part)
    first = lambda df, n: df.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("vector", 9).desc(), "id"))).where(F.col("at") <= n).drop("at")
    if rescore is None:
        return first(out, k)
    chosen = first(out, most).select("qid", "id").join(rows, "qid").join(index.vectors.select("id", "embedding"), "id")
    score = F.aggregate(F.zip_with("vector", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return first(chosen.select("qid", "id", score.alias("vector")), k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours (qid, id) that were found."""
    both = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.agg(F.count("hit") / F.greatest(F.count("*"), F.lit(1))).first()[0]
