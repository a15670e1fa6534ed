"""Hard negatives by norm-bucketed search for the largest inner products.

Each partition's candidates are sorted by norm, the longest first, and cut into buckets, which
are stored as matrices with their largest norm.  Blocks of anchors meet the buckets of a
partition in that order.  By Cauchy-Schwarz no score of a bucket is above the product of the
anchor's norm and the bucket's, so a bucket is passed over by every window whose lower limit, or
whose k-th score so far, is above that.  Partitions send their k best of each window only.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import attach
from ..spread import spread
from . import kernel
from .storage import Scratch, delete, keep

#: Candidates of a bucket, and anchors that meet a bucket at a time.
BUCKET, BLOCK = 512, 256
#: Bytes of anchors that are sent to all workers for one pass over the buckets; more anchors take more passes.
PASS_BYTES = 32 << 20
#: Scores below this are exact sums of doubles; above it they are summed as whole numbers, up to the other.
EXACT, MOST = 2.0**53, 2.0**56
_LEAST, _LARGEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones end in zeros."""
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    """Norms, and a little more, so that no bound is lost by rounding."""
    return np.sqrt((m.astype(float) ** 2).sum(1)) * (1 + 1e-9)


class Windows:
    """The k best so far of each window of a block of anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: list[np.ndarray], high: list[np.ndarray], k: int, same: bool):
        """A window of an anchor is the scores from ``low`` to ``high``; rows of its label are sought if
        ``same``, else those of others."""
        self.ids, self.labels, self.vectors, self.norms, self.k, self.same = ids, labels, vectors, _norms(vectors), k, same
        self.exact = vectors.astype(float)
        counts = np.array([len(x) for x in low], np.int64)
        self.owner = np.repeat(np.arange(len(ids)), counts)
        self.nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = np.full((len(ids), int(counts.max(initial=0))), -1, np.int64)
        self.at[self.owner, self.nth] = np.arange(len(self.owner))
        self.low, self.high = (np.concatenate(x) if len(self.owner) else np.zeros(0, np.int64) for x in (low, high))
        self.scores, self.found = np.full((len(self.owner), k), _LEAST), np.zeros((len(self.owner), k), np.int64)
        self.size = np.zeros(len(self.owner), np.int64)

    def need(self) -> np.ndarray:
        """The least score that can enter each window."""
        return np.maximum(self.low, np.where(self.size == self.k, self.scores[:, -1], _LEAST))

    def meet(self, longest: float, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
        """Takes what enters from a bucket; how many anchors' scores were computed for that."""
        need, reach = self.need(), self.norms * longest
        open_ = (reach[self.owner] >= need) & (self.low <= self.high)
        who = np.unique(self.owner[open_])
        if not len(who) or not len(ids):
            return 0
        least, most = np.full(len(self.ids), _LARGEST), np.full(len(self.ids), _LEAST)
        np.minimum.at(least, self.owner[open_], need[open_])
        np.maximum.at(most, self.owner[open_], self.high[open_])
        width = min(self.vectors.shape[1], vectors.shape[1])
        top = reach[who].max()
        if top >= MOST:
            raise ValueError(f"scores of {top:.3g} do not fit whole numbers")
        if top < EXACT:
            scores = self.exact[who, :width] @ vectors[:, :width].T.astype(float)
        else:
            scores = self.vectors[who, :width] @ vectors[:, :width].T
        equal = self.labels[who][:, None] == labels[None, :]
        fit = equal & (self.ids[who][:, None] != ids[None, :]) if self.same else ~equal
        a, c = np.nonzero(fit & (scores >= least[who][:, None]) & (scores <= most[who][:, None]))
        value, a = scores[a, c].astype(np.int64), who[a]
        parts = []
        for at in self.at.T:
            w = at[a]
            hit = np.flatnonzero((w >= 0) & (value >= need[w]) & (value <= self.high[w]))
            parts.append((w[hit], value[hit], ids[c[hit]]))
        self._enter(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return len(who)

    def _enter(self, w: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(w)
        old, slot = np.nonzero(np.arange(self.k)[None, :] < self.size[touched][:, None])
        old = touched[old]
        w, value, ids = (np.concatenate(x) for x in ((w, old), (value, self.scores[old, slot]), (ids, self.found[old, slot])))
        order = np.lexsort((ids, -value, w))
        w, value, ids = w[order], value[order], ids[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        first = place < self.k
        self.scores[w[first], place[first]], self.found[w[first], place[first]] = value[first], ids[first]
        self.size[touched] = np.minimum(np.bincount(w, minlength=len(self.size))[touched], self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's place, which of its windows, id, score) of all that was found."""
        w, slot = np.nonzero(np.arange(self.k)[None, :] < self.size[:, None])
        return self.owner[w], self.nth[w], self.found[w, slot], self.scores[w, slot]


def buckets(rows: DataFrame) -> DataFrame:
    """(longest, ids, labels, width, vectors): candidates of each partition by norm, the longest first, in
    buckets of BUCKET; ``rows`` is (id, label, vector), of whole numbers."""
    attach(rows.sparkSession)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ordered = rows.withColumn("norm", norm).sortWithinPartitions(F.desc("norm"), "id")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BUCKET):
                part = batch.slice(a, BUCKET)
                m = _matrix(part.column("vector"))
                size = next(s for s in ("<i2", "<i4", "<i8") if not m.size or s == "<i8" or np.abs(m).max() <= np.iinfo(s).max)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("id", "label")]
                columns = [pa.array([float(_norms(m).max())]), *lists, pa.array([m.shape[1]], pa.int32()), pa.array([size]), pa.array([m.astype(size).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["longest", "ids", "labels", "width", "size", "vectors"])

    kinds = dict(rows.dtypes)
    return ordered.select("id", "label", "vector").mapInArrow(kernel.tidy(run), f"longest double, ids array<{kinds['id']}>, labels array<{kinds['label']}>, width int, size string, vectors binary")


def _blocks(table: pa.Table, k: int, same: bool) -> list[tuple[np.ndarray, tuple]]:
    """(keys, what Windows needs) of BLOCK anchors each."""
    out = []
    for a in range(0, table.num_rows, BLOCK):
        part = table.slice(a, BLOCK).combine_chunks().to_batches()[0]
        spans = [[np.array([s[i] for s in x], np.int64) for x in ([(w["low"], w["high"]) for w in one] for one in part["spans"].to_pylist())] for i in (0, 1)]
        ids, labels = (part[c].to_numpy(zero_copy_only=False) for c in ("id", "label"))
        out.append((part["k"].to_numpy(), (ids, labels, _matrix(part["vector"]), *spans, k, same)))
    return out


def search(stored: DataFrame, anchors: DataFrame, k: int, same: bool, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(k, nth, id, score, rank): the ``k`` best of each window of each anchor, smaller ids first among equals.

    ``stored`` is buckets(), stored; ``anchors`` is (k, id, label, vector, spans of (low, high)), stored too."""
    spark = stored.sparkSession
    size = F.size("vector") * 8 + F.size("spans") * 16 + 64
    passes = -(-(anchors.agg(F.sum(size)).first()[0] or 0) // pass_bytes)
    scratch = Scratch()
    for i in range(max(passes, 1)):
        part = anchors.where(F.pmod(F.xxhash64("k"), F.lit(max(passes, 1))) == i)
        sent = spark.sparkContext.broadcast(_blocks(part.select("k", "id", "label", "vector", "spans").toArrow(), k, same))

        def run(batches, sent=sent):
            blocks = [(keys, Windows(*what)) for keys, what in sent.value]
            for batch in batches:
                for b in range(batch.num_rows):
                    longest, width, kind = (batch.column(c)[b].as_py() for c in ("longest", "width", "size"))
                    ids, labels = (batch.column(c)[b].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
                    m = np.frombuffer(batch.column("vectors")[b].as_buffer(), kind).reshape(len(ids), width).astype(np.int64)
                    for _, windows in blocks:
                        windows.meet(longest, ids, labels, m)
            for keys, windows in blocks:
                owner, nth, found, score = windows.rows()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[owner], nth, found, score)], ["k", "nth", "id", "score"])

        scratch.keep(stored.mapInArrow(kernel.tidy(run), "k long, nth long, id long, score long"), "best")
        sent.destroy()
    found = scratch.tables[0]
    for t in scratch.tables[1:]:
        found = found.union(t)
    order = Window.partitionBy("k", "nth").orderBy(F.desc("score"), "id")
    best = keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
    scratch.clear()
    return best


def mine(vectors: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which
    ``is_anchor`` (a column of the id) holds, and each of its ``positives`` best other rows of
    its label, the ``negatives`` best rows of other labels whose inner product with the
    anchor is from ``low`` to ``high`` hundredths of the positive's.

    Vectors are whole numbers.  Rows with a null id, label, vector or component take no part; vectors
    of other lengths are as if they ended in zeros.  Ties go to smaller ids.  Rows that repeat an
    id stand for themselves, and are no positives of each other; rows that repeat a vector are
    rows like any.  Anchors without another row of their label, and windows that hold nothing
    (as those of a negative score), give no rows; an empty table gives none; other columns,
    whatever their names, are not read.  Scores of 2^56 and more raise an error."""
    whole = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull())
    rows = vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<bigint>").alias("vector"))
    scratch = Scratch()
    stored = scratch.keep(buckets(spread(rows)), "buckets")
    anchors = scratch.keep(rows.where(is_anchor(F.col("id"))).withColumn("k", F.monotonically_increasing_id()), "anchors")
    every = F.array(F.struct(F.lit(int(_LEAST)).alias("low"), F.lit(int(_LARGEST)).alias("high")))
    near = search(stored, anchors.withColumn("spans", every), positives, True)
    each = near.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("ps"))
    spans = F.expr(f"transform(ps, p -> named_struct('low', p.positive_score * {low} div 100 + int(p.positive_score * {low} > p.positive_score * {low} div 100 * 100), 'high', p.positive_score * {high} div 100 - int(p.positive_score * {high} < p.positive_score * {high} div 100 * 100)))")
    wide = scratch.keep(anchors.join(each, "k").withColumn("spans", spans), "windows")
    found = search(stored, wide, negatives, False)
    names = wide.select("k", F.col("id").alias("anchor_id"), F.posexplode("ps").alias("nth", "p")).select("k", F.col("nth").cast("long").alias("nth"), "anchor_id", "p.positive_id", "p.positive_score")
    out = keep(found.join(names, ["k", "nth"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    scratch.clear()
    delete(near, found)
    return out
