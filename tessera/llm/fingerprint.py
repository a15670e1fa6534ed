"""Homomorphic multiset fingerprints of documents.

A paragraph is a line that is not empty.  Its vector has two parts: EXACT lanes of 64 bits
from a cryptographic hash of the line, and LIKE lanes that sum +1 or -1 for every
three-word run inside the line.  A document's fingerprint is the sum of its
paragraphs' vectors, modulo 2**64 and 2**32.  So the order of paragraphs does not
matter, inserting or deleting a paragraph adds or subtracts its vector, and the
squared length of the difference of two fingerprints estimates how many runs the
documents do not share.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import attach
from . import kernel
from .storage import keep, local

EXACT, LIKE = 4, 256


def _runs(words: kernel.Words, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of each three-word run inside a line, and of each shorter line as one run."""
    n = len(words.hash)
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = line[1:] != line[:-1]
    size = np.diff(np.append(np.flatnonzero(first), n))
    out, where = [], []
    for width in (3, 2, 1):
        h = kernel.windows(words.hash, width)
        begins = at[: len(h)]
        fits = line[begins] == line[begins + width - 1]
        if width < 3:
            short = np.zeros(n, bool)
            short[np.flatnonzero(first)[size == width]] = True
            fits &= short[: len(h)]
        out.append(h[fits])
        where.append(begins[fits])
    h, where = np.concatenate(out), np.concatenate(where)
    order = np.argsort(where, kind="stable")
    return h[order], where[order]


def _lanes(h: np.ndarray) -> np.ndarray:
    """Sum over the runs of LIKE lanes of +1 and -1."""
    total = np.zeros(LIKE, np.int64)
    salts = np.arange(1, LIKE // 64 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(0, len(h), 4080):
        part = h[i : i + 4080]
        with np.errstate(over="ignore"):
            bits = np.unpackbits(kernel.mix(part[:, None] ^ salts[None, :]).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):
            total += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return 2 * total - len(h)


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(EXACT lanes, LIKE lanes) of each text; a null text is an empty one."""
    raw, at, _ = kernel.string_buffers(texts)
    n = len(texts)
    exact, like = np.zeros((n, EXACT), np.uint64), np.zeros((n, LIKE), np.uint32)
    for a, b in kernel.slices(at):
        words = kernel.Words(raw, at[a : b + 1], kernel.space_words())
        data = raw[at[a] : at[b]]
        newline = np.flatnonzero(data == 10)
        row = np.repeat(np.arange(b - a), np.diff(words.at))
        h, where = _runs(words, np.searchsorted(newline, words.start) + row)
        cuts = np.searchsorted(where, words.at)
        for r in range(b - a):
            like[a + r] = _lanes(h[cuts[r] : cuts[r + 1]]).astype(np.uint32)
            lines = [x for x in raw[at[a + r] : at[a + r + 1]].tobytes().split(b"\n") if x]
            if lines:
                digests = b"".join(hashlib.blake2b(x, digest_size=8 * EXACT).digest() for x in lines)
                exact[a + r] = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    return exact, like


def _bytes(exact: np.ndarray, like: np.ndarray) -> list[bytes]:
    """LIKE lanes with the sign as lowest bit, their low halves and then their high ones, which are
    mostly zero and compress well."""
    like = like << np.uint32(1) ^ np.where(like >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0))
    low, high = (like & np.uint32(0xFFFF)).astype("<u2"), (like >> np.uint32(16)).astype("<u2")
    return [e.astype("<u8").tobytes() + a.tobytes() + b.tobytes() for e, a, b in zip(exact, low, high, strict=True)]


def encode(exact: np.ndarray, like: np.ndarray) -> list[str]:
    """Fingerprints as text."""
    return [base64.b64encode(x).decode() for x in _bytes(exact, like)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    low, high = np.frombuffer(data, "<u2", 2 * LIKE, 8 * EXACT).reshape(2, LIKE).astype(np.uint32)
    like = low | high << np.uint32(16)
    return np.frombuffer(data, "<u8", EXACT), like >> np.uint32(1) ^ np.where(like & np.uint32(1), np.uint32(0xFFFFFFFF), np.uint32(0))


def fingerprint(text: str | None) -> str:
    return encode(*vectors(pa.array([text], pa.string())))[0]


def insert(into: str, paragraphs: str, times: int = 1) -> str:
    """The fingerprint ``into`` with the paragraphs of fingerprint ``paragraphs`` put in ``times``
    times; a negative number takes them out."""
    (e, v), (x, y) = decode(into), decode(paragraphs)
    with np.errstate(over="ignore"):
        return encode((e + x * np.uint64(times % (1 << 64)))[None], (v + y * np.uint32(times % (1 << 32)))[None])[0]


def likeness(exact_a, like_a, exact_b, like_b) -> np.ndarray:
    """Estimated share of three-word runs that two documents have in common, 0 to 1, by rows;
    1 if their fingerprints are equal.  Right up to 2**31 - 1 runs, and as many apart."""
    square = lambda v: (v.astype(np.int32).astype(float) ** 2).sum(1)
    with np.errstate(over="ignore"):
        apart, whole = square(like_a - like_b), square(like_a) + square(like_b)
    share = np.clip(1 - apart / np.maximum(whole, 1), 0, 1)
    return np.where((exact_a == exact_b).all(1) & (like_a == like_b).all(1), 1.0, np.where(whole > 0, share, 0.0))


_REPORT = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _report(texts: list[str], exact, like, nexts: list[str], next_exact, next_like) -> list[pa.Array]:
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts, strict=True)]
    new = vectors(pa.array(edited, pa.string()))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(_bytes(exact, like), pa.binary()),
        pa.array(_bytes(*new), pa.binary()),
        pa.array(likeness(exact, like, *new), pa.float64()),
        pa.array(likeness(exact, like, next_exact, next_like), pa.float64()),
    ]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for
    each row: the fingerprint of its text, of the text whose last half is replaced by the
    beginning of the next document, and their likeness.

    The next document is that of the next id, null ids first, rows of one id by their text;
    after the last comes the first.  Null texts are empty.  An empty table gives an
    empty result.  Texts are shuffled once, by ranges; only a range's first and last
    document wait for their neighbours."""
    attach(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    names = ["id", *[x.split()[0] for x in _REPORT.split(", ")], "kind", "part", "text"]

    def run(batches):
        part, last = TaskContext.get().partitionId(), None

        def end(kind, ids, text):
            return pa.RecordBatch.from_arrays([ids, *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())), pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())], names)

        for batch in batches:
            _, at, _ = kernel.string_buffers(batch.column(1))
            for a, b in kernel.slices(at):
                ids, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                exact, like = vectors(texts)
                texts = texts.to_pylist()
                if last is None:
                    yield end(1, ids.slice(0, 1), texts[0])
                else:
                    ids = pa.concat_arrays([last[0], ids])
                    texts, exact, like = [last[1], *texts], np.concatenate([last[2], exact]), np.concatenate([last[3], like])
                last = (ids.slice(len(ids) - 1, 1), texts[-1], exact[-1:], like[-1:])
                if len(texts) > 1:
                    n = len(texts) - 1
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(0, n), *_report(texts[:-1], exact[:-1], like[:-1], texts[1:], exact[1:], like[1:]), pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], names
                    )
        if last is not None:
            yield end(2, last[0], last[1])

    done = keep(rows.mapInArrow(kernel.tidy(run), f"id {kind}, {_REPORT}, kind int, part int, text string"), "fingerprints", "zstd")

    # The last document of a range is followed by the first of the next one.  Only the numbers of the
    # ranges that have rows are on the driver; texts meet in a join.
    parts = sorted(r["part"] for r in done.where("kind = 1").select("part").collect())
    following = local(docs.sparkSession, list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, __next int")
    lasts = done.where("kind = 2").select("id", "text", "part").join(F.broadcast(following), "part")
    ends = lasts.join(done.where("kind = 1").select(F.col("part").alias("__next"), F.col("text").alias("next")), "__next")

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text, following = batch.column(1).slice(i, 1), batch.column(2).slice(i, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *_report(text.to_pylist(), *vectors(text), following.to_pylist(), *vectors(following))], names[:7])

    ends = ends.select("id", "text", "next").mapInArrow(kernel.tidy(finish), f"id {kind}, {_REPORT}")
    found = done.where("kind = 0").select(names[:7]).union(ends)
    return found.withColumns({c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}).withColumnRenamed("id", id_col)
