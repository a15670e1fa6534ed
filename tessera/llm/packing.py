"""Token ids packed to fixed-length rows by best-fit-decreasing.

Texts are tokenised; a document of more tokens than a row is split, without loss, to full
rows and a rest; and the pieces of a shard fill rows, the longest first, each the row
whose remaining space fits it best.  A segment tree over capacities finds that row.
A packed row has its ids as one line of an id matrix, the cumulative lengths of its
segments, at which positions are reset, and where each segment comes from.
"""

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import attach
from . import kernel

#: Where a vocabulary of byte-level BPE ranks is, unless another is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary cuts texts with before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens in a row, and of a shard, but for a single longer document.
LENGTH = 2048
SHARD_TOKENS = 1 << 20
#: Characters that are tokenised at a time, but for longer stretches without a space.
PART_CHARS = 100_000
#: White space of the pattern's language, and runs of it that its engine may fail on.
RUN_CHARS = 50_000
_CUT = re.compile(r"(?<=\S) ")
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN_CHARS)


class Capacities:
    """Open rows by what fits in them: a segment tree over capacities 0 to ``most``."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the least capacity of at least ``need``, no longer open then."""
        i = self.size + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers; sizes are 1 to ``length``.  Equal sizes keep their order."""
    rows: list[list[int]] = []
    open_ = Capacities(length)
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        found = open_.take(size)
        if found is None:
            found = length, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(piece)
        if capacity > size:
            open_.put(capacity - size, row)
    return rows


@functools.lru_cache(maxsize=2)
def _encoding(data: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("tessera", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str):
    """Parts whose ids are those of the text: each ends before a space that follows a character which
    is no white space, where the pattern splits whatever stands around."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PART_CHARS)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _run_ids(part: str, encoding, whole) -> list[int]:
    """As encoding.encode_ordinary(part), whose regular expression fails on very long runs of white
    space.  PATTERN makes such a run one piece, but for the character before what follows it."""
    ids, at = [], 0
    for run in _LONG_RUN.finditer(part):
        stop = run.end() - (run.end() < len(part))
        ids += encoding.encode_ordinary(part[at : run.start()]) + whole().encode_ordinary(part[run.start() : stop])
        at = stop
    return ids + encoding.encode_ordinary(part[at:])


def encode(text: str, encoding, whole=None, kind: str = "<u4") -> np.ndarray:
    """The ids of a text, those of a long one part by part, so that it needs no list of all.  ``whole`` makes an encoding that
    takes any text as one piece; with PATTERN it is needed for runs of white space of RUN_CHARS and more."""
    one = (lambda part: _run_ids(part, encoding, whole)) if whole else encoding.encode_ordinary
    if len(text) < min(PART_CHARS, RUN_CHARS):
        return np.array(encoding.encode_ordinary(text), kind)
    return np.concatenate([np.array(one(part), kind) for part in _parts(text)])


def _rows(ids: list[np.ndarray], names: pa.Array, length: int, kind: str, shard: str) -> pa.RecordBatch:
    """Packed rows of a shard's documents."""
    pieces = [(d, at, min(length, len(x) - at)) for d, x in enumerate(ids) for at in range(0, len(x), length)]
    rows = best_fit_decreasing(np.array([p[2] for p in pieces], np.int64), length) if pieces else []
    matrix = np.zeros((len(rows), length), kind)
    ends, owners, starts = [], [], []
    for r, members in enumerate(rows):
        at = [0]
        for p in members:
            d, start, n = pieces[p]
            matrix[r, at[-1] : at[-1] + n] = ids[d][start : start + n]
            at.append(at[-1] + n)
            owners.append(d)
            starts.append(start)
        ends.append(np.array(at, np.int64))
    counts = [len(m) for m in rows]
    edges = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * len(rows), pa.string()),
            pa.array(range(len(rows)), pa.int32()),
            pa.array([int(e[-1]) for e in ends], pa.int32()),
            pa.array([m.tobytes() for m in matrix], pa.binary()),
            kernel.list_array(ends, pa.int32()),
            kernel.list_array([e[:-1] for e in ends], pa.int32()),
            pa.ListArray.from_arrays(edges, names.take(pa.array(owners, pa.int64()))),
            pa.ListArray.from_arrays(edges, pa.array(starts, pa.int32())),
        ],
        ["shard", "row", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"],
    )


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = LENGTH) -> DataFrame:
    """Packed rows: shard, row, n_tokens, input_ids (``length`` little-endian ids, zero after the
    last), cu_seqlens (0 and each segment's end), position_resets (where positions start
    at 0 again), doc_ids and doc_starts (each segment's document and its first token there).

    Ids are of 16 bits if the vocabulary allows, else of 32, and those that the whole text has: a long
    text is encoded in parts, cut only where the pattern splits.  Every token of every text is
    in just one segment.  Null and empty texts have none and take no room; a null id stays
    null; repeated rows are packed each; pieces of equal length keep the order of rows;
    an empty table gives no rows; other columns, whatever their names, are not read.  A
    shard is a run of rows of an input partition, so rows depend on the partitions."""
    attach(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    ids_type = docs.schema[id_col].dataType.simpleString()
    kind = "<u2" if max(int(x.split()[1]) for x in sent.value.splitlines()) < 1 << 16 else "<u4"

    def run(batches):
        encoding, part, shard = _encoding(sent.value, pattern), TaskContext.get().partitionId(), 0
        whole = (lambda: _encoding(sent.value, "(?s).+")) if pattern == PATTERN else None
        ids, names, size = [], [], 0
        for batch in batches:
            texts = batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                ids.append(encode(text, encoding, whole, kind))
                size += len(ids[-1])
                names.append(batch.column(0).slice(i, 1))
                if size >= SHARD_TOKENS:
                    yield _rows(ids, pa.concat_arrays(names), length, kind, f"{part:06d}-{shard:05d}")
                    ids, names, size, shard = [], [], 0, shard + 1
        if size:
            yield _rows(ids, pa.concat_arrays(names), length, kind, f"{part:06d}-{shard:05d}")

    schema = f"shard string, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{ids_type}>, doc_starts array<int>"
    return docs.select(id_col, text_col).mapInArrow(kernel.tidy(run), schema)


def positions(cu_seqlens: list[int], length: int = LENGTH) -> np.ndarray:
    """Position of each token of a row in its segment; zero after the last."""
    out = np.zeros(length, np.int32)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def write_packed(rows: DataFrame, path: str) -> None:
    """Writes packed rows as a table of binary matrix lines, wherever Spark can write."""
    rows.write.parquet(path)


def unpacked(rows: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = LENGTH) -> DataFrame:
    """(doc_id, text): the texts that packed rows hold, for ids that occur once."""
    attach(rows.sparkSession)
    with open(vocabulary, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())
    cut = rows.select("input_ids", F.posexplode(F.arrays_zip("doc_ids", "doc_starts")).alias("i", "s"), "cu_seqlens")
    cut = cut.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_starts").alias("start"), F.expr("cu_seqlens[i]").alias("a"), F.expr("cu_seqlens[i + 1]").alias("b"), "input_ids")
    width = F.length("input_ids") / length
    piece = F.expr(f"substring(input_ids, cast(a * (length(input_ids) / {length}) as int) + 1, cast((b - a) * (length(input_ids) / {length}) as int))")
    whole = cut.select("doc_id", "start", piece.alias("p"), width.cast("int").alias("w")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "p"))).alias("ps"), F.first("w").alias("w"))

    def run(batches):
        encoding = _encoding(sent.value, pattern)
        for batch in batches:
            texts = [encoding.decode(np.frombuffer(b"".join(p["p"] for p in ps), f"<u{w}").tolist()) for ps, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return whole.mapInArrow(kernel.tidy(run), f"doc_id {rows.schema['doc_ids'].dataType.elementType.simpleString()}, text string")
