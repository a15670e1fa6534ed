"""A training corpus from raw documents, in stages that each write a table.

The subpackage llm has the operators; this module is their order.
"""

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixture, near_dedup, packing, toxicity
from tessera.llm.storage import delete, keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under one half.

    Null and empty texts are scored like any; texts of any length are read whole; equal texts, and so
    repeated rows, are judged alike; rows without an id are judged too, but nothing is learned from
    them; an empty table stays empty; all columns stay, whatever their names."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles with a Jaccard
    index of 0.8.

    Texts that are null or without words are in no group and stay; rows that repeat an id are one
    document, of which the row whose text has the least hash stays; rows without an id stay; texts
    may be of any length; an empty table stays empty; all columns stay, whatever their names."""
    return near_dedup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in one word of twenty or more.

    Texts that are null or without words are clean; each row is judged by itself, so that repeated rows
    go or stay together, with or without an id; texts may be of any length; an empty table stays
    empty, and with an empty benchmark all stays; all columns stay, whatever their names."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document, or an excerpt of it, is taken.

    A null source is a source like others, the last; texts that are null or without words have no words
    to take and go; repeated rows, and rows without an id, are rows like others; ties are settled
    by seeded hashes; texts may be of any length; an empty table stays empty; all columns stay,
    whatever their names."""
    return mixture.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids.

    Texts that are null or empty have no tokens and are in no row; repeated rows are packed each; a null
    id stays null in a row's list; a document longer than a row goes on in others; pieces of equal
    length keep the order of rows; an empty table gives none; other columns are not read."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The model, the sketches and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each to what the one before has written; a stage's table is deleted
    when the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = keep(stage(spark, docs, sf_dir), name)
        delete(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
