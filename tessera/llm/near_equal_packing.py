"""Near-equal windows of token ids by multiway differencing (Karmarkar-Karp).

Documents are tokenised; every whole window of a long one is a sequence by itself, and what is
left of documents is dealt to windows by differencing: the two partial partitions that are least
balanced are merged, the larger sums of one with the smaller of the other, until one is left, the
windows of which hold nearly equal numbers of tokens.  Whenever one exceeds the capacity, the
number of windows rises; should that leave too much room, pieces are cut finer first.
"""

import functools
import heapq
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import attach
from . import kernel

#: Tokens of a sequence at most, and the id that ends each document.
LENGTH, END = 2048, 1
#: Tokens that are dealt at a time, but for whole windows and a single document's rest: from this to twice as many.
SHARD_TOKENS = 1 << 20
#: Bytes that are tokenised at a time, but for longer stretches without a space; words that are held with
#: their ids, and the longest of these.
PART_BYTES, MOST_WORDS, LONG_WORD = 1 << 20, 1 << 19, 64
#: What a tokenizer's file says of texts that are split at white space, and the pieces of its words.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Words of ASCII and of Latin letters, each of which has one lower-case form, and no marks to be joined; and
#: what the pattern above makes of them.
_PLAIN = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
_PIECES = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u017e]+")
#: What no ids hold: it stands between the ids of words.
_BREAK = b"\xff" * 4
#: Pieces of neighbours are dealt as one until they have so many tokens; none is cut finer.
LUMP = 32
_CUT = re.compile(rb"[ \t-\r]")


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], ways: int, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A partial partition of two: sums, falling, without those of zero at the end, and what they are sums
    of.  New sums are numbered on from ``pairs``, which is of the two that each was made of."""
    (x, p), (y, q) = a, b
    if len(x) + len(y) <= ways:
        sums, nodes = np.concatenate([x, y]), np.concatenate([p, q])
    else:
        over = len(x) + len(y) - ways
        keep = len(x) - over
        both = np.arange(len(pairs), len(pairs) + over)
        pairs.extend(zip(p[keep:].tolist(), q[::-1][:over].tolist(), strict=True))
        sums = np.concatenate([x[:keep], x[keep:] + y[::-1][:over], y[: len(y) - over]])
        nodes = np.concatenate([p[:keep], both, q[: len(y) - over]])
    order = np.argsort(-sums, kind="stable")
    sums, nodes = sums[order], nodes[order]
    return (sums - sums[-1] if len(sums) == ways else sums), nodes


def differencing(sizes: np.ndarray, ways: int) -> list[list[int]]:
    """Items of each of ``ways`` windows with nearly equal sums.  Equal spreads are merged in the order in
    which they came to be."""
    pairs: list[tuple[int, int]] = [(-1, -1)] * len(sizes)
    heap = [(-int(s), i, (np.array([s]), np.array([i]))) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = merge(a, b, ways, pairs)
        heapq.heappush(heap, (-int(both[0][0]), made, both))
        made += 1
    windows: list[list[int]] = []
    for node in heap[0][2][1].tolist() if heap else ():
        items, stack = [], [node]
        while stack:
            at = stack.pop()
            if at < len(sizes):
                items.append(at)
            else:
                stack.extend(pairs[at])
        windows.append(sorted(items))
    return windows


def _cut(pieces: list[tuple[int, int, int]], grain: int) -> list[tuple[int, int, int]]:
    return [(d, at, min(grain, start + n - at)) for d, start, n in pieces for at in range(start, start + n, grain)]


def _lumps(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = []
    size = LUMP
    for p in pieces:
        if size >= LUMP or p[2] >= LUMP:
            out.append([])
            size = 0
        out[-1].append(p)
        size += p[2]
    return out


def _joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces in order, those that meet as one."""
    out: list[tuple[int, int, int]] = []
    for d, start, n in sorted(pieces):
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] == start:
            out[-1] = (d, out[-1][1], out[-1][2] + n)
        else:
            out.append((d, start, n))
    return out


def _tail(pieces: list[tuple[int, int, int]], tokens: int) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int, int]]]]:
    """Pieces without their last ``tokens``, and those in sequences whose lengths are powers of two."""
    pieces, last, need = list(pieces), [], tokens
    while need:
        d, start, n = pieces.pop()
        take = min(n, need)
        last.append((d, start + n - take, take))
        if take < n:
            pieces.append((d, start, n - take))
        need -= take
    last.reverse()
    out = []
    for bit in reversed(range(tokens.bit_length())):
        need = tokens & 1 << bit
        if need:
            out.append([])
        while need:
            d, start, n = last[0]
            take = min(n, need)
            out[-1].append((d, start, take))
            last[0] = (d, start + take, n - take)
            if take == n:
                last.pop(0)
            need -= take
    return pieces, out


def windows(pieces: list[tuple[int, int, int]], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces of (document, start, tokens), each piece of fewer than ``length`` tokens.

    Windows are meant to be short of the capacity by a 256th, which differencing needs to meet it; what
    is left of a multiple of that are sequences of powers of two, which need no padding.  Whenever a
    window exceeds the capacity, their number rises, by as many as would hold the excess if all were as
    full; when that would leave more than a 64th empty, pieces, at first of a quarter of the
    capacity at most, are cut in halves instead, as long as they are of more than LUMP tokens."""
    total = sum(p[2] for p in pieces)
    full = max(1, length - length // 256)
    least = total // full
    pieces, out = _tail(pieces, total - least * full)
    ways, grain = least, max(1, length // 4)
    while pieces:
        lumps = _lumps(_cut(pieces, grain))
        sizes = np.array([sum(p[2] for p in lump) for lump in lumps], np.int64)
        parts = differencing(sizes, ways)
        most = max(int(sizes[w].sum()) for w in parts)
        if most <= length:
            return out + [_joined([p for i in w for p in lumps[i]]) for w in parts]
        ways = max(ways + 1, -(-ways * most // length))
        if grain > LUMP and 64 * (ways * length - least * full) > ways * length:
            ways, grain = least, grain // 2
    return out


class Latest:
    """The latest entries, ``most`` of them at a time, and as many old ones."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def turn(self) -> None:
        self.old, self.new = self.new, {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts.

    A tokenizer that changes and splits texts as RULES say takes white space out and never looks
    beyond it, so that a text's ids are those of its words, and, but for rare characters, a word's
    those of its pieces: both are encoded once, as long as they are among the latest ones.  Any
    other tokenizer encodes whole texts."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        rules = json.loads(data)
        self.tokenizer = Tokenizer.from_buffer(data)
        self.by_words = {k: rules[k] for k in RULES} == RULES and not any(_CUT.search(t["content"].encode()) for t in rules["added_tokens"])
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {c: "".join(p for p, _ in byte_level.pre_tokenize_str(chr(c))) for c in range(0xC0, 0x180)}
        self.words, self.pieces = Latest(MOST_WORDS), Latest(MOST_WORDS // 2)

    def _encoded(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pieces(self, text: str) -> list[bytes]:
        """The ids of each line of plain words."""
        flat = _PIECES.findall(text.lower())
        missing = set(flat).difference(self.pieces.new)
        if missing:
            if len(self.pieces.new) + len(missing) > self.pieces.most:
                self.pieces.turn()
                missing.update(flat)
            self.pieces.new.update({p: self.pieces.old.get(p) or self._piece(p) for p in missing})
        found = b"".join(map(self.pieces.new.__getitem__, flat)).split(_BREAK)
        for p in missing:
            if len(p) > LONG_WORD:
                del self.pieces.new[p]
        return found

    def _piece(self, piece: str) -> bytes:
        if piece == "\n":
            return _BREAK
        mapped = piece if piece.isascii() else piece.translate(self.mapped)
        return _packed([t.id for t in self.tokenizer.model.tokenize(mapped)])

    def _learn(self, missing: set[bytes], words: list[bytes]) -> None:
        """Puts the ``missing`` ones of ``words`` among the latest."""
        if len(self.words.new) + len(missing) > self.words.most:
            self.words.turn()
            missing.update(words)
        old = self.words.old
        known = {w: old[w] for w in missing if w in old}
        new = [w for w in missing if w not in known]
        text = b"\n".join(new).decode("utf-8", "replace")
        if new and _PLAIN.fullmatch(text) and "<|" not in text:
            known.update(zip(new, self._pieces(text), strict=True))
        else:
            texts = [w.decode("utf-8", "replace") for w in new]
            plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
            known |= {w: self._encoded(t) for w, t, p in zip(new, texts, plain, strict=True) if not p}
            if any(plain):
                kept = [w for w, p in zip(new, plain, strict=True) if p]
                known.update(zip(kept, self._pieces("\n".join(t for t, p in zip(texts, plain, strict=True) if p)), strict=True))
        self.words.new.update(known)

    def ids(self, text: bytes, end: int = END) -> np.ndarray:
        """The ids of a text, and ``end``."""
        last = end.to_bytes(4, "little")
        if not self.by_words:
            return np.frombuffer(self._encoded(text.decode("utf-8", "replace")) + last, "<u4")
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + PART_BYTES)
            stop = cut.start() if cut else len(text)
            words = text[at:stop].split()
            missing = set(words).difference(self.words.new)
            if missing:
                self._learn(missing, words)
            out.append(b"".join(map(self.words.new.__getitem__, words)))
            for w in missing:
                if len(w) > LONG_WORD:
                    del self.words.new[w]
            at = stop
        return np.frombuffer(b"".join([*out, last]), "<u4")


@functools.lru_cache(maxsize=1)
def _encoder(data: bytes) -> Encoder:
    return Encoder(data)


class _Out:
    """Rows on their way out: pieces of sequences, with running numbers."""

    def __init__(self, first: int):
        self.next, self.rows, self.names = first, [], []

    def add(self, pieces, docs) -> None:
        at = 0
        for d, start, n in pieces:
            name, ids, base, total = docs[d]
            self.rows.append((start, n, ids[start - base : start - base + n].tobytes(), total, self.next, at))
            self.names.append(name)
            at += n
        self.next += 1

    def batches(self, columns: list[str]):
        for a in range(0, len(self.rows), 512):
            part = list(zip(*self.rows[a : a + 512], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(self.names[a : a + 512]), *(pa.array(c, k) for c, k in zip(part, kinds, strict=True))], columns)
        self.rows, self.names = [], []


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): pieces of documents in sequences of at most
    ``length`` tokens; ``ids`` are little-endian unsigned 32-bit numbers.

    ``tokenizer`` is the path of a tokenizer's file, which the driver reads.  A document's ids are those of
    its whole text and ``end``, so a null or empty text has that one; each id lies in just one
    piece.  Repeated rows are packed each; a null id stays null; ties keep the order of rows; a
    document of any length goes on in more sequences; an empty table gives no rows; other
    columns, whatever their names, are not read.  Sequences are made within an input partition,
    and numbered by it, so that they depend on how rows are dealt, but not on retries."""
    attach(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encoder, out = _encoder(sent.value), _Out(TaskContext.get().partitionId() << 40)
        docs, size = [], 0

        def deal(docs):
            for sequence in windows([(d, base, len(ids)) for d, (_, ids, base, _) in enumerate(docs) if len(ids)], length):
                out.add(sequence, docs)

        for batch in batches:
            raw, edges, _ = kernel.string_buffers(batch.column(1))
            for i in range(batch.num_rows):
                ids = encoder.ids(raw[edges[i] : edges[i + 1]].tobytes(), end)
                doc = (batch.column(0).slice(i, 1), ids, 0, len(ids))
                whole = len(ids) // length * length
                for at in range(0, whole, length):
                    out.add([(0, at, length)], [doc])
                docs.append((doc[0], ids[whole:].copy(), whole, len(ids)))
                size += len(ids) - whole
                if whole:
                    yield from out.batches(columns)
                if size >= 2 * SHARD_TOKENS:
                    first = int(np.searchsorted(np.cumsum([len(d[1]) for d in docs]), SHARD_TOKENS)) + 1
                    deal(docs[:first])
                    docs = docs[first:]
                    size = sum(len(d[1]) for d in docs)
                    yield from out.batches(columns)
        deal(docs)
        yield from out.batches(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(id_col, text_col).mapInArrow(kernel.tidy(run), schema)


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, n_tokens, padded, input_ids, cu_seqlens): the ids of each sequence of packed(), zeros
    after the last up to ``padded``, which is ``length``, or n_tokens where that is a power of
    two; and 0 and the end of each piece."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    n = F.expr("cast(aggregate(p, 0L, (s, x) -> s + x.length) as int)")
    padded = F.when(F.expr("bit_count(n_tokens) = 1"), F.col("n_tokens")).otherwise(length)
    joined = F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))")
    ends = F.expr("transform(concat(array(named_struct('offset', 0L, 'ids', cast(null as binary), 'length', 0L)), p), x -> cast(x.offset + x.length as int))")
    whole = whole.withColumn("n_tokens", n).withColumn("padded", padded)
    return whole.select("sequence_id", "n_tokens", "padded", F.concat(joined, F.unhex(F.repeat(F.lit("00"), (F.col("padded") - F.col("n_tokens")) * 4))).alias("input_ids"), ends.alias("cu_seqlens"))
