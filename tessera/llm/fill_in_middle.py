"""Fill-in-the-middle by bit-parallel marks over big integers.

A text's UTF-8 bytes become masks with one bit a byte: bytes.translate says which bytes are of a
class, and the digits that it gives are read as a binary number.  Shifts and boolean operations
of whole masks mark where units begin, bit_count gives how many there are, and the place of a
ranked one is found by halving the mask.  Masks are made block by block, so that a text of any
length needs little besides itself.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..shipping import attach
from . import kernel

#: The marks of a text's parts, and the white space of units.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of a mask.
BLOCK = 1 << 20

_SPACES = bytes(49 if b in SPACE else 48 for b in range(256))
_LEADS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def mask(data: bytes, table: bytes) -> int:
    """The number whose bit i says whether byte i is of the class that ``table`` gives as digits."""
    return int(data.translate(table)[::-1], 2) if data else 0


def select(bits: int, rank: int) -> int:
    """The place of the set bit that ``rank`` others, lower ones, precede."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        count = low.bit_count()
        if rank < count:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - count, at + half
    return at


class Units:
    """The units of a text: white space, then all up to the next; or white space at the end."""

    def __init__(self, data: bytes):
        self.data, self.begins, space = data, [], 0
        for a in range(0, len(data), BLOCK):
            block = data[a : a + BLOCK]
            spaces = mask(block, _SPACES)
            begins = spaces & ~(spaces << 1 | space)
            self.begins.append(begins if a else begins | 1)
            space = spaces >> (len(block) - 1)
        self.counts = [b.bit_count() for b in self.begins]
        self.n = sum(self.counts)

    def end(self, units: int) -> int:
        """The byte at which the first ``units`` units end."""
        if units >= self.n:
            return len(self.data)
        for i, count in enumerate(self.counts):
            if units < count:
                return i * BLOCK + select(self.begins[i], units)
            units -= count
        raise AssertionError(units)

    def chars(self, a: int, b: int) -> int:
        """Code points that begin in the bytes ``a`` to ``b``."""
        return sum(mask(self.data[i : min(i + BLOCK, b)], _LEADS).bit_count() for i in range(a, b, BLOCK))


def transform(data: bytes, key: str, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of a text.  ``key`` is hashed to
    what is drawn; ``rate`` of a hundred texts are transformed, and ``spm`` of a hundred of
    those begin with the suffix."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    first, second, drawn, order = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = Units(data)
    if not data or drawn % 100 >= rate or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, data
    a, b = (units.end(u) for u in sorted((first % (units.n + 1), second % (units.n + 1))))
    prefix, middle, suffix = PREFIX + data[:a], MIDDLE + data[a:b], SUFFIX + data[b:]
    form = "spm" if order % 100 < spm else "psm"
    return units.n, form, units.chars(0, a), units.chars(a, b), (suffix + prefix if form == "spm" else prefix + suffix) + middle


def rebuilt(output: bytes, form: str) -> bytes:
    """The text of an output.  Texts that hold a mark are plain, so the first ones are those put in; and
    no mark can arise where a part meets one, as none has a < but at its beginning."""
    if form == "plain":
        return output
    one, other = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    second, third = output.index(other), output.index(MIDDLE)
    parts = {one: output[3:second], other: output[second + 3 : third]}
    return parts[PREFIX] + output[third + 3 :] + parts[SUFFIX]


def _texts(column: pa.Array):
    raw, at, _ = kernel.string_buffers(column)
    view = memoryview(raw)
    return (bytes(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row, in one pass without a shuffle.

    ``n`` counts units; ``form`` is plain, psm or spm; ``output`` is the text with its parts marked and
    moved.  What is drawn depends on ``seed`` and the id alone, so reruns agree, and rows that
    repeat an id and a text come out alike.  A null text is empty, and empty texts are plain; a
    null id is drawn for as an empty one; texts that hold a mark are plain; a text may be of any
    length (a worker holds it and its output); an empty table gives no rows; other columns,
    whatever their names, are not read."""
    attach(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [transform(t, f"{seed}:{'' if i is None else i}", rate, spm) for i, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [pa.array(c, kind) for c, kind in zip(columns[:4], (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, _strings(list(columns[4]))], names)

    fields = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    schema = StructType([docs.schema[id_col], *fields])
    names = schema.names
    return docs.select(id_col, text_col).mapInArrow(kernel.tidy(run), schema)


def with_restored(done: DataFrame) -> DataFrame:
    """``restored``: the exact text of each output of fill_in_middle(), from it and its form alone."""
    schema = StructType([*done.schema.fields, StructField("restored", StringType())])
    output, form = done.columns.index("output"), done.columns.index("form")
    names = schema.names

    def run(batches):
        for batch in batches:
            texts = [rebuilt(t, f) for t, f in zip(_texts(batch.column(output)), batch.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _strings(texts)], names)

    return done.mapInArrow(kernel.tidy(run), schema)
