"""Benchmark decontamination with suffix arrays over the training text.

Each slice of training documents is a shard with a suffix array of its words; every
suffix of every benchmark item is looked up in it by binary search, which gives all
verbatim occurrences and, by following them from word to word, the longest matches and
where they are.  Suffixes of the shard that open with fewer words of the benchmark's
vocabulary than its shortest window cannot match and stay out of the array; suffixes of
the benchmark whose first word opens none of the shard's are not looked up.

The benchmark is the query set: it goes to the workers in blocks of a bounded size, made
on the workers too.  A worker holds one block at a time: if there are several, it gathers
more text and lets each block pass over it.  So the benchmark may be of any length.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import attach
from . import kernel

#: Words of an item that make a window; an item of fewer words is one window.
WIDTH = 13
#: Bytes of benchmark text in a block, as nearly as items allow.
BLOCK_BYTES = 4 << 20
#: Bytes of training text in a shard.
SHARD_BYTES = 1 << 20
#: Shards that several blocks pass over at a time.
GATHERED = 32
#: Windows whose keys are made at a time, and occurrences that are followed at a time.
AT_ONCE = 1 << 18


def _keys(ids: np.ndarray, at: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` words of the suffixes at ``at`` as sortable bytes, zero after ``run`` words."""
    out = np.zeros((len(at), width), ">u4")
    for i in range(width):
        inside = run > i
        out[inside, i] = ids[at[inside] + i]
    return out.view(f"S{4 * width}").ravel()


def _each(begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of so many each."""
    return np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


class Block:
    """The suffixes of some benchmark items, ready to be looked up; plain arrays only."""

    def __init__(self, items: list[str], texts: pa.Array, width: int):
        raw, at, _ = kernel.string_buffers(texts)
        words = kernel.Words(raw, at, kernel.alnum_words())
        self.width, self.items = width, np.array(items, object)
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        self.ids = (ids + 1).astype(np.uint32)
        size = np.diff(words.at)
        count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
        owner = np.repeat(np.arange(len(items)), count)
        place = _each(np.zeros(len(items), np.int64), count)
        span = np.minimum(size, width)[owner]
        start = words.at[:-1][owner] + place
        keys = _keys(self.ids, start, span, width)
        # The width follows the words, so that a short window differs from a longer one's beginning.
        order = np.lexsort((span, keys))
        self.owner, self.place, keys, span = owner[order].astype(np.int32), place[order].astype(np.int32), keys[order], span[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (span[1:] != span[:-1])
        #: Of each distinct window: where its words stand, how many they are, and its first suffix.
        self.start, self.span = start[order][fresh].astype(np.int32), span[fresh].astype(np.int32)
        self.first = np.append(np.flatnonzero(fresh), len(keys)).astype(np.int32)
        self.least = int(span.min()) if len(span) else 0

    def find(self, words: kernel.Words):
        """(position, window) of every occurrence; positions count the words of all rows."""
        n, rows = len(words.hash), len(words.at) - 1
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n or not len(self.start):
            return none
        near = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        known = np.where(self.vocabulary[near] == words.hash, near + 1, 0)
        row = np.repeat(np.arange(rows), np.diff(words.at))
        ids = np.zeros(n + rows + self.width, np.int64)  # a gap after each row
        where = np.arange(n) + row
        ids[where] = known
        gaps = np.flatnonzero(ids == 0)
        run = gaps[np.searchsorted(gaps, where)] - where
        keep = np.flatnonzero(run >= self.least)
        keys = _keys(ids, where[keep], np.minimum(run[keep], self.width), self.width)
        order = np.argsort(keys, kind="stable")
        suffixes = keys[order]
        opens = np.zeros(len(self.vocabulary) + 1, bool)
        opens[known[keep]] = True
        asked = np.flatnonzero(opens[self.ids[self.start]])
        out = [none]
        for a in range(0, len(asked), AT_ONCE):
            window = asked[a : a + AT_ONCE]
            low = _keys(self.ids, self.start[window].astype(np.int64), self.span[window], self.width)
            high = low.copy().view(np.uint8).reshape(len(low), 4 * self.width)
            high[np.arange(4 * self.width)[None, :] >= 4 * self.span[window][:, None]] = 255
            lo, hi = np.searchsorted(suffixes, low, "left"), np.searchsorted(suffixes, high.view(low.dtype).ravel(), "right")
            hits = np.flatnonzero(hi > lo)
            times = (hi - lo)[hits]
            out.append((keep[order[_each(lo[hits], times)]], np.repeat(window[hits], times)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def longest(self, words: kernel.Words):
        """(row, item, word of the row, word of the item, length) of the maximal verbatim matches, some rows
        at a time."""
        position, window = self.find(words)
        order = np.argsort(position, kind="stable")
        position, window = position[order], window[order]
        row = np.searchsorted(words.at, position, "right") - 1
        times = np.diff(self.first)[window]
        # Whole rows, until they have enough occurrences.
        ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1 if len(row) else []
        at, total = 0, np.append(0, np.cumsum(times))
        for k, end in enumerate(ends):
            if k + 1 < len(ends) and total[ends[k + 1]] - total[at] <= AT_ONCE:
                continue
            part = slice(at, end)
            at = end
            yield self._followed(words, row[part], position[part], window[part], times[part])

    def _followed(self, words, row, position, window, times):
        entry = _each(self.first[window].astype(np.int64), times)
        row, position, span = (np.repeat(x, times) for x in (row, position, self.span[window]))
        item, place = self.owner[entry], self.place[entry]
        order = np.lexsort((position, position - place, item, row))
        row, item, position, place, span = (x[order] for x in (row, item, position, place, span))
        start = np.ones(len(item), bool)
        start[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (position[1:] - place[1:] != position[:-1] - place[:-1]) | (position[1:] != position[:-1] + 1)
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(item))[: len(begin)] - 1
        return row[begin], item[begin], position[begin] - words.at[row[begin]], place[begin], position[end] - position[begin] + span[begin]


def _searched(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, width: int) -> list[Broadcast]:
    """The benchmark in blocks of about BLOCK_BYTES; the driver passes on one at a time."""
    spark = docs.sparkSession
    attach(spark)
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    rows = rows.repartition(n, F.xxhash64("item", "text")) if n > 1 else rows.coalesce(1)

    def made(batches):
        parts = [pa.Table.from_batches([b]) for b in batches]
        if parts:
            table = pa.concat_tables(parts)
            block = Block(table["item"].to_pylist(), table["text"].cast(pa.large_string()).combine_chunks(), width)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(block), protocol=5)], pa.large_binary())], ["block"])

    return [spark.sparkContext.broadcast(bytes(r["block"])) for r in rows.mapInArrow(kernel.tidy(made), "block binary").toLocalIterator()]


def _unpacked(sent: Broadcast) -> Block:
    block = Block.__new__(Block)
    vars(block).update(pickle.loads(sent.value))
    return block


def _let_go(sent: Broadcast) -> None:
    """A worker that reads a broadcast again from its file need not hold it."""
    if getattr(sent, "_path", None) and hasattr(sent, "_value"):
        del sent._value


def _passed(batches, column: int, blocks: list[Broadcast]):
    """(batch, first row, row after the last, words, matches by block) of every shard; matches are as
    Block.longest()'s, with the items' names."""
    only = _unpacked(blocks[0]) if len(blocks) == 1 else None

    def judged(held):
        found = [[] for _ in held]
        for sent in blocks:
            block = only or _unpacked(sent)
            for k, (*_, words) in enumerate(held):
                found[k] += [(row, block.items[item], *rest) for row, item, *rest in block.longest(words)]
            if only is None:
                del block
                _let_go(sent)
        for (batch, a, b, words), matches in zip(held, found, strict=True):
            none = (np.zeros(0, np.int64), np.zeros(0, object), *(np.zeros(0, np.int64) for _ in range(3)))
            yield batch, a, b, words, tuple(np.concatenate(x) for x in zip(none, *matches, strict=True))

    held = []
    for batch in batches:
        raw, at, _ = kernel.string_buffers(batch.column(column))
        for a, b in kernel.slices(at, SHARD_BYTES):
            held.append((batch, a, b, kernel.Words(raw, at[a : b + 1], kernel.alnum_words())))
            if len(held) >= (1 if only else GATHERED):
                yield from judged(held)
                held = []
    yield from judged(held)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, item_id, doc_word, item_word, n_words): the maximal verbatim matches of at least a
    window, with their places.  Texts without words, and null texts or items, have none."""
    blocks = _searched(docs, benchmark, item_col, item_text, width)

    def run(batches):
        for batch, a, _, _, (row, item, position, place, n) in _passed(batches, 1, blocks):
            columns = [pa.array(item.tolist(), pa.string()), *(pa.array(x.astype(np.int64)) for x in (position, place, n))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), *columns], ["id", "item_id", "doc_word", "item_word", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(kernel.tidy(run), f"id {kind}, item_id string, doc_word bigint, item_word bigint, n_words bigint").withColumnRenamed("id", id_col)


def _judged(words: kernel.Words, found):
    """Words, words inside a match, the items that match, the longest match and its first word, of each row."""
    row, item, position, _, n = found
    rows = len(words.at) - 1
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, words.at[row] + position, 1)
    np.add.at(edge, words.at[row] + position + n, -1)
    inside = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
    order = np.lexsort((position, -n, row))
    begin = np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1])) if len(row) else order
    longest, where = np.zeros(rows, np.int64), np.full(rows, -1)
    first = order[begin]
    longest[row[first]], where[row[first]] = n[first], position[first]
    items = [[] for _ in range(rows)]
    for r, a, b in zip(row[first].tolist(), begin.tolist(), [*begin[1:].tolist(), len(row)], strict=False):
        items[r] = sorted(set(item[order[a:b]].tolist()) - {None})
    return np.diff(words.at), inside[words.at[1:]] - inside[words.at[:-1]], items, longest, where


_REPORT = ["n_words", "n_hit", "n_items", "items", "contaminated", "longest", "longest_at"]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, one_in: int = 20) -> DataFrame:
    """The columns ``keep`` of ``docs`` and n_words, n_hit, n_items, items, contaminated, longest,
    longest_at: the words of the longest verbatim match, 0 without any, and the document's
    first word of it, the first of equally long ones, null without any.

    Words are those of kernel.alnum_words() with A-Z lower-cased.  A word inside an
    occurrence of a window of an item is hit; a document is contaminated if it has
    hits and at least one word in ``one_in`` is hit.  A null or wordless text has no
    words and no hits; items with a null or wordless text have no windows; the hits
    of an item without an id count, but n_items and items leave it out; items that repeat
    are one if they have one id; repeated rows are judged each for itself; an empty table
    of documents gives an empty result, one of items no hits.  Columns of ``docs`` that are
    named like a result give way."""
    blocks = _searched(docs, benchmark, item_col, item_text, width)
    keep = [c for c in keep if c.lower() not in _REPORT]

    def run(batches):
        for batch, a, b, words, found in _passed(batches, 0, blocks):
            n, hit, items, longest, where = _judged(words, found)
            told = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array((hit > 0) & (one_in * hit >= n)), pa.array(longest), pa.array(where, mask=where < 0)]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), *told], [*(f"k{i}" for i in range(len(keep))), *_REPORT])

    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean, longest bigint, longest_at bigint"])
    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(kernel.tidy(run), schema).toDF(*keep, *_REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, one_in: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as contamination() says, with all their columns,
    whatever their names."""
    blocks = _searched(docs, benchmark, item_col, item_text, width)
    column = docs.columns.index(text_col)

    def run(batches):
        for batch, a, b, words, found in _passed(batches, column, blocks):
            n, hit, *_ = _judged(words, found)
            yield batch.slice(a, b - a).filter(pa.array((hit == 0) | (one_in * hit < n)))

    return docs.mapInArrow(kernel.tidy(run), docs.schema)


def items_digest(items):
    """Lower-case hex SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)
