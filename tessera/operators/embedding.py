"""Vectors of chunks: the text that stands for a chunk, an injected encoder, full and partial builds."""

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import attach
from .chunking import refreshed

#: Texts that the encoder is given at a time.
ENCODE_BATCH = 32


class Encoder(Protocol):
    """What turns texts into vectors: a model that each worker loads once, or a stub in tests."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def embedding_text() -> Column:
    """Name, chapter, article and title before the body, so that a short article is known by its place."""
    head = [F.coalesce(F.col(c), F.lit("")) for c in ("name", "chapter", "article", "article_title")]
    return F.concat(F.concat_ws(" ", *head), F.lit("\n"), F.coalesce("text", F.lit("")))


def embedded(chunks: DataFrame, load: Callable[[], Encoder], batch: int = ENCODE_BATCH) -> DataFrame:
    """(chunk_id, reg_id, source, category, embedding): unit vectors; zero vectors stay zero.

    ``load`` makes the encoder, once for each task.  Only the texts leave the JVM."""
    attach(chunks.sparkSession)
    rows = chunks.select("chunk_id", "reg_id", "source", "category", embedding_text().alias("t"))

    def run(batches):
        encode = load()
        for given in batches:
            for a in range(0, given.num_rows, batch):
                part = given.slice(a, batch)
                v = np.asarray(encode(part.column(4).to_pylist()), float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                edges = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.ListArray.from_arrays(edges, pa.array(v.ravel()))], ["chunk_id", "reg_id", "source", "category", "embedding"])

    return rows.mapInArrow(run, "chunk_id string, reg_id string, source string, category string, embedding array<double>")


def rebuilt(old: DataFrame | None, chunks: DataFrame, load: Callable[[], Encoder]) -> DataFrame:
    """All vectors anew, or with ``old``, those of the regulations of ``chunks`` in place of their old ones."""
    new = embedded(chunks, load)
    return new if old is None else refreshed(old, new)
