"""Vectorised text kernel: words, word hashes and shingles over Arrow string buffers.

Everything works on UTF-8 bytes.  A separator table says which bytes end a word;
bytes of 0x80 and more always belong to words, so multi-byte characters stay
whole.  Bytes are hashed block by block, so that memory depends neither on how many rows
an Arrow batch has, nor on how long a text or a word is; only a text's words add up.
"""

import ctypes
import functools

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice, but for a single longer text, and bytes that are hashed at a time.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW63 = np.uint64((1 << 63) - 1)


@functools.cache
def space_words() -> np.ndarray:
    """Word bytes for ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


@functools.cache
def alnum_words() -> np.ndarray:
    """Word bytes for ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[0x80:] = True
    for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
        table[ord(first) : ord(last) + 1] = True
    return table


@functools.cache
def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z."""
    values = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    return values


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _power(base: np.uint64, exponent: int) -> np.uint64:
    return np.uint64(pow(int(base), exponent, 1 << 64))


def span_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the values from ``first`` to before ``last``, the same wherever they stand."""
    with np.errstate(over="ignore"):
        total, down = np.zeros(len(values) + 1, np.uint64), np.empty(len(values) + 1, np.uint64)
        down[len(values)] = _power(_INVERSE, len(values))
        for a in range(0, len(values), SLICE_BYTES):
            part = values[a : a + SLICE_BYTES]
            up, inverse = _powers(SLICE_BYTES)
            total[a + 1 : a + 1 + len(part)] = total[a] + np.cumsum(part * up[: len(part)], dtype=np.uint64) * _power(_BASE, a)
            down[a : a + len(part)] = inverse[: len(part)] * _power(_INVERSE, a)
        return mix((total[last] - total[first]) * down[first])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; nulls are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if null.any() and (np.diff(at)[null] > 0).any():
        return string_buffers(column.fill_null(""))[:2] + (null,)
    return raw, at, null


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """(first, last) row ranges of at most ``most`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _hash_block(buf, a, b, bounds, table, values, prefix, before, carry):
    """The words that begin or end in the bytes ``a`` to ``b`` of ``buf``: (starts, total before each, its
    hash's factor, heads, ends, total before each), whether the block ends inside a word, and the
    total up to its end.  ``before`` and ``carry`` are those of the block before."""
    more = min(b + prefix, len(buf))
    data = buf[a:more]
    inside = table[data]
    n = b - a
    up, down = _powers(SLICE_BYTES + 64)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    total = total * _power(_BASE, a) + carry
    word = inside[:n]
    left = np.empty(n, bool)
    left[0], left[1:] = before, word[:-1]
    cut = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b)] - a
    joined = left.copy()
    joined[cut] = False
    starts, ends = np.flatnonzero(word & ~joined), np.flatnonzero(left & ~(word & joined))
    heads = starts[:0]
    if prefix:
        stop = np.append(np.flatnonzero(~inside), len(data))
        upto = np.minimum(starts + prefix, stop[np.searchsorted(stop, starts)])
        marks = np.append(bounds[np.searchsorted(bounds, a, "right") :][: len(data) + 1] - a, len(data))
        upto = np.minimum(upto, marks[np.minimum(np.searchsorted(marks, starts, "right"), len(marks) - 1)])
        heads = total[upto]
    return starts + a, total[starts], down[starts] * _power(_INVERSE, a), heads, ends + a, total[ends], bool(word[-1]), total[n]


class Words:
    """Words of consecutive rows: ``hash``, ``start`` and ``end`` (bytes from the first row's
    begin), and ``at``, where ``at[i]:at[i + 1]`` are the words of row i.  ``head`` has
    the hash of each word's first ``prefix`` bytes, if asked for.  ``cuts`` are more bytes,
    ascending and from the first row's begin, at which words are cut."""

    __slots__ = ("at", "end", "hash", "head", "start")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, values: np.ndarray | None = None, prefix: int = 0, cuts: np.ndarray | None = None):
        values = byte_values() if values is None else values
        lo, hi = int(offsets[0]), int(offsets[-1])
        buf = raw[lo:hi]
        edges = np.asarray(offsets, np.int64) - lo
        bounds = edges if cuts is None else np.union1d(edges, cuts)
        parts, before, carry = [], False, np.uint64(0)
        with np.errstate(over="ignore"):
            for a in range(0, len(buf), SLICE_BYTES):
                *found, before, carry = _hash_block(buf, a, min(a + SLICE_BYTES, len(buf)), bounds, table, values, prefix, before, carry)
                parts.append(found)
            if before:
                none = np.zeros(0, np.uint64)
                parts.append([none.astype(np.int64), none, none, none, np.array([len(buf)]), np.array([carry], np.uint64)])
            kinds = (np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.uint64)
            self.start, begin, down, heads, self.end, total = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i in range(6))
            self.hash = mix((total - begin) * down)
            self.head = mix((heads - begin) * down) if prefix else begin[:0]
        self.at = np.searchsorted(self.start, edges, "left")


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width), np.uint64)
        for i in range(width):
            out = (out ^ h[i : i + n]) * _MIX1
            out ^= out >> np.uint64(29)
        return mix(out)


def shingle_sets(words: Words, width: int):
    """For each row the sorted distinct 63-bit hashes of its ``width``-word shingles; a row
    with fewer words has its whole sequence as the one shingle, a row without words none."""
    all_windows = windows(words.hash, width) & _LOW63
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(all_windows[a : b - width + 1])
        else:
            yield windows(words.hash[a:b], b - a)[: b > a] & _LOW63


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of numpy arrays."""
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(kind.to_pandas_dtype(), copy=False), kind))


def tidy(run):
    """``run`` for mapInArrow, after which a worker, which waits for its next task, gives back what memory
    it holds for later use."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied
