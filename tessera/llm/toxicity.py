"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled texts, as is everything else; there is none per
language.  Features are densities of lexicon words and word beginnings, of words that
are in the lexicon once letters replace look-alike symbols, closeness to words of the
second person, and rates of capitals, punctuation and symbols inside words.
"""

import functools
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import attach
from . import kernel
from .boosting import Boosted, isotonic
from .storage import few, local

#: Labelled texts that the model is fitted on at most, and their bytes; a seeded choice of the labelled rows.
MOST_LABELLED = 8_000
MOST_BYTES = 64 << 20
#: Words, and beginnings of words, that the lexicon holds at most.
LEXICON = 4096
#: Bytes of a word's beginning.
PREFIX = 5
#: Words between a lexicon word and one of the second person that count as close.
NEAR = 5
#: Words of the second person in some languages.
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch usted ustedes vosotros tus".split()
#: Symbols that stand for letters.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}


@functools.cache
def _second_person() -> np.ndarray:
    words = pa.array(SECOND_PERSON, pa.large_string())
    raw, at, _ = kernel.string_buffers(words)
    return np.sort(kernel.Words(raw, at, kernel.alnum_words()).hash)


@functools.cache
def _masked() -> tuple[np.ndarray, np.ndarray]:
    """(word bytes, byte values) that read look-alike symbols as letters."""
    table, values = kernel.alnum_words().copy(), kernel.byte_values().copy()
    for symbol, letter in LOOKS_LIKE.items():
        table[ord(symbol)], values[ord(symbol)] = True, values[ord(letter)]
    return table, values


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_CAPITAL, _LETTER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER[0x80:] = 1
_POINT, _SHOUT, _SYMBOL = _class(".,;:?!'\"-()"), _class("!"), _class("@$*#%&|+0123456789")


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    near = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[near] == h


def features(texts: pa.Array, lexicon: dict) -> np.ndarray:
    """A row of dense features for each text; a null text has those of an empty one."""
    raw, at, _ = kernel.string_buffers(texts)
    out = []
    for a, b in kernel.slices(at):
        words = kernel.Words(raw, at[a : b + 1], kernel.alnum_words(), prefix=PREFIX)
        n = np.diff(words.at)
        count = lambda flags, w=words: np.diff(np.append(0, np.cumsum(flags))[w.at])
        strong, mild = _member(words.hash, lexicon["strong"]), _member(words.hash, lexicon["mild"])
        begins = _member(words.head, lexicon["begins"]) & (words.end - words.start >= PREFIX)
        person = _member(words.hash, _second_person())
        row = np.repeat(np.arange(b - a), n)
        close = np.zeros(len(row), bool)
        for d in range(1, NEAR + 1):
            same = row[d:] == row[:-d]
            close[d:] |= person[:-d] & same
            close[:-d] |= person[d:] & same
        masked = kernel.Words(raw, at[a : b + 1], *_masked())
        hidden = np.diff(np.append(0, np.cumsum(_member(masked.hash, lexicon["strong"])))[masked.at]) - count(strong)
        data, edge = raw[at[a] : at[b]], at[a : b + 1] - at[a]
        rate = {}
        for name, table in (("capital", _CAPITAL), ("letter", _LETTER), ("point", _POINT), ("shout", _SHOUT), ("symbol", _SYMBOL)):
            rate[name] = np.diff(np.append(0, np.cumsum(table[data]))[edge]).astype(float)
        letter_at = _LETTER[data]
        glued = np.zeros(len(data), np.int64)
        glued[1:-1] = _SYMBOL[data[1:-1]] & letter_at[:-2] & letter_at[2:] if len(data) > 2 else 0
        glued = np.diff(np.append(0, np.cumsum(glued))[edge])
        chars = np.maximum(np.diff(edge), 1)
        per = np.maximum(n, 1)
        columns = [
            count(strong) / per, np.log1p(count(strong)), count(mild) / per, count(begins) / per, np.log1p(count(begins)), np.maximum(hidden, 0) / per,
            count(person) / per, count(strong & close) / per, count((strong | begins) & close),
            rate["capital"] / np.maximum(rate["letter"], 1), rate["point"] / chars, rate["shout"] / chars, rate["symbol"] / chars, glued / per, np.log1p(n),
        ]
        out.append(np.stack([np.asarray(c, float) for c in columns], 1))
    return np.concatenate(out) if out else np.zeros((0, 15))


def _learn_lexicon(word_sets: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> dict:
    """Words and beginnings whose texts are toxic far more often than others."""
    out = {}
    toxic, clean = max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
    for which, (least, names) in enumerate((((2.5, 1.0), ("strong", "mild")), ((2.5,), ("begins",)))):
        flat = np.concatenate([s[which] for s in word_sets]) if word_sets else np.zeros(0, np.uint64)
        hit = np.repeat(y, [len(s[which]) for s in word_sets]).astype(bool)
        known, code = np.unique(flat, return_inverse=True)
        p, n = np.bincount(code, hit, len(known)), np.bincount(code, ~hit, len(known))
        odds = np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
        high = np.inf
        for low, name in zip(least, names, strict=True):
            z = odds / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
            good = np.flatnonzero((p >= 3) & (odds >= low) & (odds < high) & (z >= (3 if low > 2 else 5)))
            good = good[np.argsort(-(p[good] * odds[good]), kind="stable")[:LEXICON]]
            out[name], high = np.sort(known[good]), low
    return out


def train(texts: list[str | None] | pa.Array, toxic: list[int], fold: list[int]) -> dict:
    """A model from labelled texts.  Of the ``fold`` numbers 0 to 3, the texts of 3 calibrate and
    never fit; features of the others come from lexicons that have not seen them."""
    y, fold = np.array(toxic, float), np.array(fold)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    raw, at, _ = kernel.string_buffers(column)
    sets = []
    for a, b in kernel.slices(at):
        w = kernel.Words(raw, at[a : b + 1], kernel.alnum_words(), prefix=PREFIX)
        long = w.end - w.start >= PREFIX
        for i, j in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
            sets.append((np.unique(w.hash[i:j]), np.unique(w.head[i:j][long[i:j]])))
    learn = lambda rows: _learn_lexicon([sets[i] for i in rows], y[rows])
    fit = np.flatnonzero(fold < 3)
    x, labels = [], []
    for k in range(3):
        own = np.flatnonzero(fold == k)
        x.append(features(column.take(pa.array(own)), learn(np.flatnonzero((fold < 3) & (fold != k)))))
        labels.append(y[own])
    trees = Boosted().fit(np.concatenate(x), np.concatenate(labels))
    lexicon = learn(fit)
    held = np.flatnonzero(fold == 3)
    knots = isotonic(trees.predict(features(column.take(pa.array(held)), lexicon)), y[held]) if len(held) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return {"lexicon": lexicon, "trees": vars(trees), "knots": knots}


def score(texts: pa.Array, model: dict) -> np.ndarray:
    """Calibrated chance that a text is toxic; a thousandth of the raw score orders the ties."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    trees = Boosted.__new__(Boosted)
    vars(trees).update(model["trees"])
    raw = trees.predict(features(texts, model["lexicon"])) if len(texts) else np.zeros(0)
    return np.clip(0.999 * np.interp(raw, *model["knots"]) + 0.001 * raw, 0, 1)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int) -> pa.Table:
    """(__id, __hash, __y, __text): labelled texts in a seeded order, as many as the bounds allow, but for
    those that are too long for what is left.  Labels without a document take no place.  Rows that repeat an id are one if their texts are equal, and else compete for a place each."""
    key = F.crc32(F.col(id_col).cast("string"))
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(key % 5 != 0)
    rows = rows.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("__y")).distinct()
    order = [F.xxhash64(F.lit(7), "__id"), "__id", "__y"]
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash"), F.col(text_col).alias("__text"))
    sized = texts.select("__id", "__hash", F.coalesce(F.octet_length("__text"), F.lit(0)).alias("size")).join(few(rows, "__id"), "__id")
    table = sized.select("__id", "__hash", "__y", "size").distinct().orderBy(*order, "__hash").limit(most).toArrow()
    fits, size = [], 0
    for one in table["size"].to_pylist():  # a text that does not fit is left out, and those after it are not
        fits.append(size + one <= most_bytes)
        size += one if fits[-1] else 0
    if table.num_rows and not any(fits):
        warnings.warn(f"no labelled text is of {most_bytes} bytes or less: nothing is learned", stacklevel=3)
    table = table.filter(pa.array(fits, pa.bool_())).drop(["size"])
    keys = local(docs.sparkSession, [tuple(r.values()) for r in table.to_pylist()], f"__id {docs.schema[id_col].dataType.simpleString()}, __hash bigint, __y int")
    found = texts.join(F.broadcast(keys), ["__id", "__hash"]).groupBy("__id", "__hash", "__y").agg(F.first("__text").alias("__text"))
    return found.select("__id", "__hash", "__y", "__text").toArrow().sort_by([(c, "ascending") for c in ("__id", "__hash", "__y")])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> dict:
    """Fits the model on a seeded choice of at most ``most`` labelled texts, of ``most_bytes`` in all,
    whose crc32(id as text) is not divisible by 5; the same rows give the same model.

    Null ids and labels are left out; null texts count as empty; rows that repeat a label are
    one; without labels, or with one kind only, scores are all the same; an empty table
    gives a model that finds nothing toxic."""
    attach(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_col, most, most_bytes)
    fold = [zlib.crc32(f"fold {i}".encode()) % 4 for i in sample["__id"].to_pylist()]
    return train(sample["__text"].cast(pa.large_string()).combine_chunks(), sample["__y"].to_pylist(), fold)


def toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row.  Null and empty texts are scored like any, and
    texts of any length whole; equal texts score alike; repeated rows are scored each; a row
    without an id is not held out; an empty table gives an empty result; other columns,
    whatever their names, are not read."""
    attach(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = score(batch.column(2), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col(id_col), held, F.col(text_col)).mapInArrow(kernel.tidy(run), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: dict, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows whose score is under ``most``, with all their columns, whatever their names; repeated
    rows, and rows without an id, are judged each.  An empty table stays empty."""
    attach(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            _, at, _ = kernel.string_buffers(batch.column(column))
            for a, b in kernel.slices(at, 4 * kernel.SLICE_BYTES):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(score(part.column(column), sent.value) < most))

    return docs.mapInArrow(kernel.tidy(run), docs.schema)
