"""Cross-entropy difference of two n-gram language models.

A target model (labelled good documents) and a background model (all documents) are
bigram models over one vocabulary, that of the corpus: every word and every pair of
words, as 64-bit hashes, has counts of its own, and a text's first word is paired with
its beginning.  So both are distributions over the vocabulary and the end of a text.
The counts grow with the corpus and stay on the workers: texts are gathered to chunks, each chunk sends its distinct words and pairs with
their counts to buckets by hash, a bucket sums them over all chunks and answers each chunk.
A document's score is the mean over its words of the target's loss less the background's.
"""

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import attach
from . import kernel
from .storage import is_few, keep

#: Words that a task holds, and distinct ones that it keeps of them, before it sends them on to be counted.
HELD_WORDS = 1 << 20
#: Weight of the word model in the pair model, and of each word of the vocabulary in the word model.
ALPHA, BETA = 4.0, 0.5
#: Words of a chunk; a chunk ends with the batch slice that reaches them.
CHUNK_WORDS = 1 << 20
#: Buckets are 2 ** bits: so many bits at least, and more so that each stands for at most so many bytes of text.
LEAST_BITS, BUCKET_BYTES = 9, 1 << 26

_FIRST, _MUL = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)


class Models(NamedTuple):
    """What the models are counted from; the words, and the texts with words, of (target, background);
    the words of the vocabulary and the bytes of all texts."""

    docs: DataFrame
    marked: DataFrame
    columns: tuple[str, str]
    totals: tuple[int, int]
    texts: tuple[int, int]
    vocabulary: int
    size: int


def _pairs(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each word and the one before; a text's first word follows a mark of its own."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[at[:-1][at[:-1] < len(words)]] = _FIRST
    with np.errstate(over="ignore"):
        return kernel.mix(kernel.mix(before * _MUL + _FIRST) ^ words)


def _ids(words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, pair) hashes of each word."""
    return words.hash, _pairs(words.hash, words.at)


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """The (target, background) models, each over all of its documents.  Their words are counted
    here; the counts of each word and pair are made where texts are scored, by the same shuffle.

    Few target ids go to the texts; many meet them in a shuffle, whose result is stored, so that a lost
    task that runs again reads its texts in the same order.  Each task sends its distinct words to a
    shuffle that counts them.  Null and empty texts add nothing; repeated rows count each; ids that no
    document has are no matter."""
    attach(docs.sparkSession)
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("__id")).where("__id is not null").distinct().withColumn("__in", F.lit(True))
    small = is_few(ids, "__id")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(ids) if small else ids, "__id", "left")
    texts = texts.select("__id", "__text", F.coalesce("__in", F.lit(False)).alias("__in"))
    texts = texts if small else keep(texts, "marked-texts")
    sums, most = ["words_in", "words", "texts_in", "texts", "size"], HELD_WORDS

    def run(batches):
        total, held, new, n_new = np.zeros(len(sums), np.int64), np.zeros(0, np.uint64), [], 0
        words = lambda h: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[pa.nulls(len(h), pa.int64())] * len(sums)], ["h", *sums])
        for batch in batches:
            raw, at, _ = kernel.string_buffers(batch.column(0))
            chosen = np.asarray(batch.column(1))
            for a, b in kernel.slices(at):
                found = kernel.Words(raw, at[a : b + 1], kernel.alnum_words())
                n, own = np.diff(found.at), chosen[a:b]
                total += [n[own].sum(), n.sum(), (n[own] > 0).sum(), (n > 0).sum(), at[b] - at[a]]
                new.append(found.hash)
                n_new += len(found.hash)
                if n_new >= most:  # sorted once for so many words, not for each slice
                    held, new, n_new = np.union1d(held, np.concatenate(new)), [], 0
                    if len(held) >= most:
                        yield words(held)
                        held = held[:0]
        yield words(np.union1d(held, np.concatenate([held, *new])))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([v], pa.int64()) for v in total.tolist())], ["h", *sums])

    counted = texts.select("__text", "__in").mapInArrow(kernel.tidy(run), "h bigint, " + ", ".join(f"{c} bigint" for c in sums))
    t = counted.agg(F.count_distinct("h").alias("vocabulary"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums)).first()
    return Models(docs, texts, (id_col, text_col), (t["words_in"], t["words"]), (t["texts_in"], t["texts"]), t["vocabulary"], t["size"])


def _own(keys: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """How often each word's key occurs in its own row."""
    both = row * size + keys
    _, code, times = np.unique(both, return_inverse=True, return_counts=True)
    return times[code]


def _loss(word: np.ndarray, pair: np.ndarray, before: np.ndarray, words: np.ndarray, vocabulary: float) -> np.ndarray:
    """-log p of each word by counts of it, of its pair, of what is before and of all words."""
    single = (word + BETA) / (words + BETA * max(vocabulary, 1))
    return -np.log((pair + ALPHA * single) / (before + ALPHA))


def _pack(counts: np.ndarray) -> bytes:
    """A byte a count; those of 255 and more follow in full."""
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, so that high bytes, mostly zero, take no room."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T), 1)


def _values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as steps, which are smaller."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data), dtype=np.uint64)


_PARTS = ["bucket", "chunk", "keys", "target", "ground", "codes", "sizes", "ids"]


def _gathered(batches, most: int):
    """(ids, word hashes, words of each row, flags of each row) of chunks of rows."""
    held, n = [], 0
    for batch in batches:
        raw, at, _ = kernel.string_buffers(batch.column(1))
        flags = np.stack([np.asarray(batch.column(i)) for i in (2, 3, 4)]) if batch.num_rows else np.zeros((3, 0), bool)
        for a, b in kernel.slices(at):
            words = kernel.Words(raw, at[a : b + 1], kernel.alnum_words())
            held.append((batch.column(0).slice(a, b - a), words.hash, np.diff(words.at), flags[:, a:b]))
            n += len(words.hash)
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def scores(docs: DataFrame, models: Models, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, target_loss, background_loss, score) for each row: mean losses a word in nats
    and their difference, lower for texts more like the target.

    A document is scored by models that leave its own counts out.  Words are those of
    kernel.alnum_words(); without any, all is 0: so it is for null and empty texts.  A text
    may be of any length.  Repeated rows are scored each, by models that have the others;
    rows without an id are scored by models that have no id to leave out; an empty table
    gives an empty result; other columns, whatever their names, are not read."""
    attach(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    yes, no = F.lit(True), F.lit(False)
    if docs is models.docs and (id_col, text_col) == models.columns:
        rows = models.marked.select(F.col("__id"), "__text", "__in", yes.alias("counted"), yes.alias("scored"))
    else:
        counted = models.marked.select(F.lit(None).cast(kind).alias("__id"), "__text", "__in", yes.alias("counted"), no.alias("scored"))
        rows = counted.union(docs.select(id_col, text_col, no, no, yes))
    bits = max(LEAST_BITS, (models.size // BUCKET_BYTES).bit_length())
    edges = np.array([i << (64 - bits) for i in range(1 << bits)], np.uint64)
    totals, starts, vocabulary, chunk_words = models.totals, models.texts, models.vocabulary, CHUNK_WORDS

    def send(batches):
        part = TaskContext.get().partitionId()
        for seq, held in enumerate(_gathered(batches, chunk_words)):
            ids, hashes, n, flags = (([h[i] for h in held]) for i in range(4))
            ids, hashes, n, flags = pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(n), np.concatenate(flags, 1)
            pairs = _pairs(hashes, np.append(0, np.cumsum(n)))
            keys = np.unique(np.concatenate([hashes, pairs]))

            def count(chosen, n=n, hashes=hashes, pairs=pairs, keys=keys):
                out = np.zeros(len(keys), np.int64)
                if chosen.any():
                    words = slice(None) if chosen.all() else np.repeat(chosen, n)
                    found, times = np.unique(np.concatenate([hashes[words], pairs[words]]), return_counts=True)
                    out[np.searchsorted(keys, found)] = times
                return out

            target, ground = count(flags[0] & flags[1]), count(flags[1])
            # Named by what it holds, so that a chunk of a task that ran again never meets answers to another.
            seed = (int(keys.sum(dtype=np.uint64)) + (part << 32) + seq) & ((1 << 64) - 1)
            with np.errstate(over="ignore"):
                chunk = int(kernel.mix(np.array([seed], np.uint64))[0] >> np.uint64(1)) if flags[2].any() else None
            cut = np.append(np.searchsorted(keys, edges), len(keys))
            full = np.flatnonzero(np.diff(cut)).tolist()
            many = [(cut[i], cut[i + 1]) for i in full]
            nothing = pa.nulls(len(full), pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([_steps(keys[a:b]) for a, b in many], pa.binary()),
                pa.array([_pack(target[a:b]) for a, b in many], pa.binary()), pa.array([_pack(ground[a:b]) for a, b in many], pa.binary()), nothing, nothing, pa.nulls(len(full), pa.list_(ids.type)),
            ], _PARTS)
            if chunk is not None:
                words, codes, times = np.unique(hashes, return_inverse=True, return_counts=True)
                rank = np.argsort(-times)  # frequent words first: small codes
                place = np.empty_like(rank)
                place[rank] = np.arange(len(rank))
                nothing = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk % len(edges)], pa.int32()), pa.array([chunk], pa.int64()), pa.array([words[rank].tobytes()], pa.binary()), nothing, nothing,
                    pa.array([_planes(place[codes])], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                ], _PARTS)

    def answer(table):
        body = pc.is_valid(table["codes"])
        asked = table.filter(pc.invert(body))
        keys = [_keys(k) for k in asked["keys"].to_pylist()]
        at = np.append(0, np.cumsum([len(k) for k in keys], dtype=np.int64))
        _, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
        said = []
        for name in ("target", "ground"):
            counts = np.concatenate([np.zeros(0, np.int64), *(_unpack(d, len(k)) for d, k in zip(asked[name].to_pylist(), keys, strict=True))])
            total = np.bincount(code, counts).astype(np.int64)[code] if len(code) else counts
            said.append(pa.array([_pack(total[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
        sizes = pa.array([np.int64(len(k)).tobytes() for k in keys], pa.binary())
        nothing = pa.nulls(len(keys), pa.binary())
        told = pa.table([asked["bucket"], asked["chunk"], nothing, *said, nothing, sizes, asked["ids"]], names=_PARTS)
        return pa.concat_tables([told.filter(pc.is_valid(told["chunk"])), table.select(_PARTS).filter(body)])

    def judge(table):
        body = pc.is_valid(table["codes"])
        own, told = table.filter(body), table.filter(pc.invert(body)).sort_by("bucket")
        if own.num_rows != 1:
            raise RuntimeError(f"{own.num_rows} texts of one chunk: the input changed while it was read")
        words, codes = np.frombuffer(own["keys"][0].as_py(), np.uint64), _values(own["codes"][0].as_py()).astype(np.int64)
        n = np.frombuffer(own["sizes"][0].as_py(), np.int64)
        at = np.append(0, np.cumsum(n))
        hashes = words[codes]
        pairs, pair_codes = np.unique(_pairs(hashes, at), return_inverse=True)
        keys = np.unique(np.concatenate([words, pairs]))
        many = [int(np.frombuffer(s, np.int64)[0]) for s in told["sizes"].to_pylist()]
        if sum(many) != len(keys):
            raise RuntimeError(f"{sum(many)} answers to {len(keys)} words and pairs of a chunk: the input changed while it was read")
        word_at, pair_at = np.searchsorted(keys, words)[codes], np.searchsorted(keys, pairs)[pair_codes]
        row = np.repeat(np.arange(len(n)), n)
        first = at[:-1][n > 0]
        own_word, own_pair = _own(codes, row, len(words)), _own(pair_codes, row, len(pairs))

        def before(v, start):
            """Of the word before, or of the beginning of the text."""
            out = np.append(0, v[:-1])[: len(v)]
            out[first] = start
            return out

        def mean(counts, all_words, all_texts, less):
            word, pair = counts[word_at], counts[pair_at]
            context = before(word, all_texts)
            every = np.full(len(row), all_words)
            if less:  # what the row itself adds
                context = np.maximum(context - before(own_word, 1), 0)
                word, pair, every = np.maximum(word - own_word, 0), np.maximum(pair - own_pair, 0), np.maximum(every - n[row], 0)
            return pa.array(np.bincount(row, _loss(word, pair, context, every, vocabulary), len(n)) / np.maximum(n, 1))

        target, ground = (np.concatenate([np.zeros(0, np.int64), *(_unpack(d, k) for d, k in zip(told[name].to_pylist(), many, strict=True))]) for name in ("target", "ground"))
        return pa.table([own["ids"].combine_chunks().flatten(), pa.array(n), mean(target, totals[0], starts[0], True), mean(target, totals[0], starts[0], False), mean(ground, totals[1], starts[1], True)], names=["id", "n", "inside", "outside", "ground"])

    parts = f"bucket int, chunk bigint, keys binary, target binary, ground binary, codes binary, sizes binary, ids array<{kind}>"
    found = rows.mapInArrow(kernel.tidy(send), parts).groupBy("bucket").applyInArrow(answer, parts)
    found = found.groupBy("chunk").applyInArrow(judge, f"id {kind}, n bigint, inside double, outside double, ground double")
    member = target_ids.select(F.col(target_ids.columns[0]).alias("id")).distinct().withColumn("member", F.lit(True))
    found = found.join(member, "id", "left").withColumn("t", F.when(F.col("member"), F.col("inside")).otherwise(F.col("outside")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("t").alias("target_loss"), F.col("ground").alias("background_loss"), (F.col("t") - F.col("ground")).alias("score"))
