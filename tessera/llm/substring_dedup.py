"""Substring deduplication over sliding spans of sentences.

Every run of several consecutive sentences is hashed, from each sentence on, and runs are
joined over all documents; what any run covers that is not the first of its kind goes.

Passages also repeat without their sentences' borders: cut in the middle, or without any
stops.  So sentences are cut further, to pieces, at words whose hash is the least among
its neighbours', alike wherever a passage stands, and runs of pieces are hashed as well.

Only one row of each run and stretch of texts is sent to the join: in such a stretch, all
but the first of equal runs are known to be later ones.  So a run that a third of all
documents share is as many rows as there are stretches, not as there are documents.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import attach
from . import kernel
from .storage import keep

#: Sentences that a run of sentences has at least, and words.
MIN_SENTENCES, SENTENCE_WORDS = 3, 24
#: Pieces that a run of pieces has at least, and words.
MIN_PIECES, MIN_WORDS = 3, 30
#: Words on either side that a cut inside a sentence is compared with.
RADIUS = 3
#: Words of a stretch of texts whose equal runs are one row; it ends with the slice that reaches them.
STRETCH_WORDS = 1 << 20

_STOPS, _BREAKS, _CLOSERS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_STOPS[list(b".!?")] = True
_BREAKS[list(b".!?;")] = True
_CLOSERS[list(b"\"')]}")] = True
#: Characters of three bytes that end a sentence.
WIDE_STOPS = "。！？．｡…।॥۔"


def _wide_stop(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends with each byte of ``last`` is one of WIDE_STOPS."""
    code = lambda i: raw[np.maximum(last - i, 0)].astype(np.int64)
    three = code(2) << 16 | code(1) << 8 | code(0)
    return np.isin(three, [int.from_bytes(c.encode()[-3:], "big") for c in WIDE_STOPS if len(c.encode()) == 3]) | np.isin(three & 0xFFFF, [int.from_bytes(c.encode(), "big") for c in WIDE_STOPS if len(c.encode()) == 2])


def _words(raw: np.ndarray, at: np.ndarray) -> kernel.Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, but that each character from U+3000 to U+9FFF is one, and that a
    wide stop ends one: their languages have no spaces."""
    data = raw[at[0] : at[-1]]
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    wide = np.flatnonzero(data == 0xEF)
    wide = wide[wide + 2 < len(data)]
    wide = wide[_wide_stop(data, wide + 2)]
    cuts = np.unique(np.concatenate([lead, lead + 3, wide + 3])) if len(lead) or len(wide) else None
    return kernel.Words(raw, at, kernel.space_words(), cuts=cuts)


def borders(raw: np.ndarray, words: kernel.Words, base: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether a sentence ends with it, and whether a piece does, whatever other rows
    hold.  ``base`` is where the words' bytes begin."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    last = base + words.end - 1
    final = words.at[1:][words.at[1:] > words.at[:-1]] - 1
    newline = np.append(0, np.cumsum(raw[base : base + words.end[-1]] == 10))
    before = np.where(words.end - words.start > 1, raw[np.maximum(last - 1, 0)], 0)
    sentence = _STOPS[raw[last]] | _CLOSERS[raw[last]] & _STOPS[before] | _wide_stop(raw, last) & (words.end - words.start > 1)
    sentence[:-1] |= newline[words.start[1:]] > newline[words.end[:-1]]
    sentence[final] = True
    with np.errstate(over="ignore"):
        pair = words.hash.copy()
        pair[:-1] = kernel.windows(words.hash, 2) if n > 1 else pair[:-1]
    pair[final] = words.hash[final]  # no word follows in the row
    row = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    least = np.ones(n, bool)
    for d in range(1, RADIUS + 1):
        other = row[d:] != row[:-d]
        least[d:] &= (pair[d:] <= pair[:-d]) | other  # ties cut, so that a word or words said again and again are cut alike
        least[:-d] &= (pair[:-d] <= pair[d:]) | other
    return sentence, sentence | _BREAKS[raw[last]] | least


def _spans(words: kernel.Words, ends: np.ndarray, min_words: int, min_parts: int):
    """(row, first word, last word + 1) of the shortest run of parts, from each part on, that has
    enough words and parts; ``ends`` says where parts end."""
    last = np.flatnonzero(ends) + 1
    first = np.append(0, last[:-1]) if len(last) else last
    row = np.searchsorted(words.at, first, "right") - 1 if len(first) else first
    stop = np.searchsorted(row, np.arange(len(words.at) - 1), "right")
    upto = np.maximum(np.searchsorted(last, first + min_words), np.arange(len(first)) + min_parts - 1)
    i = np.flatnonzero(upto < stop[row]) if len(row) else first
    return row[i], first[i], last[upto[i]]


def runs(raw: np.ndarray, at: np.ndarray, sentence_words: int, min_words: int):
    """(row, first word of the row, words, hash) of all runs of sentences and of pieces."""
    words = _words(raw, at)
    sentence, piece = borders(raw, words, int(at[0]))
    row, first, last = (np.concatenate(x) for x in zip(_spans(words, sentence, sentence_words, MIN_SENTENCES), _spans(words, piece, min_words, MIN_PIECES), strict=True))
    _, once = np.unique(first * (len(words.hash) + 1) + last, return_index=True)
    row, first, last = row[once], first[once], last[once]
    h = kernel.span_hashes(words.hash, first, last) & np.uint64((1 << 63) - 1)
    return row, first - words.at[row], last - first, h, len(words.hash)


def _sorted_out(ids: pa.Array, row: np.ndarray, first: np.ndarray, n: np.ndarray, h: np.ndarray):
    """(row, first word, words, hash) of a stretch's runs that must be joined: of equal ones that of the
    smallest id and then of the earliest word.  The others are later ones anyhow; those of a
    row that touch or overlap are one, with -1 for the hash."""
    coded = ids.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    rank = rank[coded.indices.to_numpy()][row]
    order = np.lexsort((first, rank, h))
    row, first, n, h, rank = row[order], first[order], n[order], h[order], rank[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else order
    late = (rank != rank[head]) | (first != first[head])  # rows that repeat an id have one place
    at, width = row[late] * (1 << 40) + first[late], n[late]
    order = np.argsort(at, kind="stable")
    at, upto = at[order], np.maximum.accumulate((at + width)[order]) if late.any() else at
    begin = np.ones(len(at), bool)
    begin[1:] = at[1:] > upto[:-1]
    begin = np.flatnonzero(begin)
    end = upto[np.append(begin[1:], len(at))[: len(begin)] - 1]
    return tuple(np.concatenate(x) for x in zip((row[new], first[new], n[new], h[new].astype(np.int64)), (at[begin] >> 40, at[begin] & ((1 << 40) - 1), end - at[begin], np.full(len(begin), -1)), strict=True))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """(id, first_word, n_words): in each row the stretches of words that runs cover which are not the
    first of their kind.

    The first of equal runs is that of the smallest id, then of the earliest word.  Texts
    shorter than a run, null and empty ones have none; rows without an id are left alone;
    rows that repeat an id count as one document; an empty table gives none; other columns,
    whatever their names, are not read.  No text's spans depend on how rows are dealt out."""
    attach(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def told(held):
        ids = pa.concat_arrays([x[0] for x in held])
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        row, first, n, h = _sorted_out(ids, *(np.concatenate([x[i] + base[k] if i == 1 else x[i] for k, x in enumerate(held)]) for i in (1, 2, 3, 4)))
        for a in range(0, len(h), 1 << 17):
            part = slice(a, a + (1 << 17))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[part])), pa.array(first[part] << 32 | n[part]), pa.array(h[part])], ["id", "place", "h"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            raw, at, _ = kernel.string_buffers(batch.column(1))
            for a, b in kernel.slices(at):
                row, first, n, h, words = runs(raw, at[a : b + 1], sentence_words, min_words)
                held.append((batch.column(0).slice(a, b - a), row, first, n, h))
                size += words
                if size >= STRETCH_WORDS:
                    yield from told(held)
                    held, size = [], 0
        if held:
            yield from told(held)

    found = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(kernel.tidy(run), f"id {kind}, place bigint, h bigint")
    # What is known to be later needs no partner: a negative key of its own deals it out.
    found = found.withColumn("h", F.when(F.col("h") < 0, -1 - F.abs(F.xxhash64("id", "place") % (1 << 62))).otherwise(F.col("h")))
    first, n = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    same = Window.partitionBy("h").orderBy("id", "place")
    found = found.withColumns({"__id": F.first("id").over(same), "__place": F.first("place").over(same)})
    later = found.where(F.expr("h < 0 or id <> __id or shiftright(place, 32) <> shiftright(__place, 32)")).select("id", first.alias("first"), (first + n).alias("upto"))

    # Runs of a document that touch or overlap are one stretch.
    order = Window.partitionBy("id").orderBy("first", "upto")
    so_far = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = later.withColumn("__new", F.when(so_far >= F.col("first"), 0).otherwise(1))
    spans = fresh.withColumn("__at", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "__at").agg(F.min("first").alias("first_word"), F.max("upto").alias("upto"))
    return spans.select(F.col("id").alias(id_col), "first_word", (F.col("upto") - F.col("first_word")).alias("n_words"))


def _cut(rows: DataFrame, text_col: str, cuts: str) -> DataFrame:
    """``rows`` with the stretches of words ``cuts`` cut from their texts."""
    names, column, listed = rows.columns, rows.columns.index(text_col), rows.columns.index(cuts)

    def run(batches):
        for batch in batches:
            raw, at, null = kernel.string_buffers(batch.column(column))
            todo = batch.column(listed)
            hit = np.flatnonzero((np.asarray(pc.fill_null(pc.list_value_length(todo), 0)) > 0) & ~null)
            if not len(hit):
                yield batch
                continue
            texts = batch.column(column).to_pylist()
            for r in hit.tolist():
                words, data = _words(raw, at[r : r + 2]), raw[at[r] : at[r + 1]]
                left = np.ones(len(data), bool)
                for cut in todo[r].as_py():
                    upto = cut["first_word"] + cut["n_words"]
                    left[words.start[cut["first_word"]] : words.start[upto] if upto < len(words.start) else len(data)] = False
                texts[r] = data[left].tobytes().decode()
            out = list(batch.columns)
            out[column] = pa.array(texts, pa.string()).cast(out[column].type)
            yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(kernel.tidy(run), rows.schema)


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: str | None = None) -> DataFrame:
    """``docs`` with the words of ``spans`` cut from their texts; rows keep all columns, and a
    text of which nothing is left is empty.  Null texts, and texts without spans, stay as they
    are.  With ``cuts``, a column of this name has each row's spans, null without any."""
    attach(docs.sparkSession)
    names = docs.columns
    fresh = lambda name: next(x for x in (name + "_" * i for i in range(len(names) + 1)) if x.lower() not in {c.lower() for c in names})
    key, listed = fresh("__id"), cuts or fresh("__cuts")
    each = spans.groupBy(F.col(id_col).alias(key)).agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(listed))
    # The same plan at every size: texts meet their spans by a shuffle, however few these may be.
    met = docs.join(each.hint("merge"), docs[id_col] == each[key], "left").select(*(docs[c] for c in names), listed)
    left = _cut(met, text_col, listed)
    return left if cuts else left.drop(listed)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, n_chars, text_sha256) for each row: the stretches that went, in order, and the size and
    digest of the text without them.  A null text stays null; rows without an id stay as they are."""
    spans = keep(repeated_spans(docs, id_col, text_col), "spans")
    left = without_repeats(docs.select(id_col, text_col), spans, id_col, text_col, cuts="spans")
    none = F.array().cast(left.schema["spans"].dataType)
    return left.select(F.col(id_col), F.coalesce("spans", none).alias("spans"), F.length(text_col).cast("long").alias("n_chars"), F.sha2(text_col, 256).alias("text_sha256"))
