"""The batch pipeline: collected regulations to dated ones, chunks, an index, vectors and an evaluation."""

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, embedding, keyword
from .search import searched_text


def dated(regulations: DataFrame, law_text: str = "law_text", body: str = "body") -> DataFrame:
    """Regulations with their dates, kind and status: from the law page's header for those that
    have one, else from the text's history; the posting date stands in for a revision date."""
    law, history = text.law_header(law_text), text.revision_history(body)
    use_law = (F.coalesce("law_url", F.lit("")) != "") & (F.col("source") == "대학")
    rows = regulations.withColumn("__d", F.when(use_law, law).otherwise(history))
    posted = F.replace(F.coalesce("date", F.lit("")), F.lit("."), F.lit("-"))
    field = lambda c: F.coalesce(F.col(f"__d.{c}"), F.lit(""))
    rows = rows.withColumns({"enforce_date": field("enforce_date"), "revision_date": F.when(field("revision_date") == "", posted).otherwise(field("revision_date")), "revision_type": field("revision_type"), "rule_no": F.when(field("rule_no") == "", F.coalesce("rule_no", F.lit(""))).otherwise(field("rule_no"))})
    return rows.withColumn("status", text.status("name", "revision_type")).drop("__d")


class Step(NamedTuple):
    """What a step of a refresh did; ``ok`` is None where it was left out."""

    name: str
    ok: bool | None
    seconds: float
    error: str = ""


def summary(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """(name, ok, seconds, error) of a refresh's steps and of all together."""
    total = Step("total", not any(s.ok is False for s in steps), sum(s.seconds for s in steps))
    return spark.createDataFrame([*steps, total], "name string, ok boolean, seconds double, error string")


def recovered(spark: SparkSession, path: str) -> None:
    """Ends a replacement of the table at ``path`` that was broken off: the new rows are there if they had been
    written whole and the old ones had been moved away, else the old ones."""
    fs, at, new, old = _places(spark, path)
    if not fs.exists(at) and fs.exists(old):
        fs.rename(new if fs.exists(_place(spark, f"{path}.new/_SUCCESS")) else old, at)
    for rest in (new, old) if fs.exists(at) else ():
        fs.delete(rest, True)


def _place(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _places(spark: SparkSession, path: str):
    at = _place(spark, path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, _place(spark, f"{path}.new"), _place(spark, f"{path}.old")


def _replace(spark: SparkSession, table: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    """Puts ``table``, which may be read from ``path`` itself, in the place of what is there: it is written once,
    aside, and then moved, so that rows old or new are whole at any time (see recovered())."""
    fs, at, new, old = _places(spark, path)
    writer = table.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}.new")
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)
    return spark.read.parquet(path)


def refresh(spark: SparkSession, regulations: DataFrame, out: str, name: str | None = None, load: Callable | None = None, evaluate: Callable[[dict[str, str]], DataFrame] | None = None, enrich: bool = False, skip: tuple[str, ...] = ()) -> list[Step]:
    """Chunks, keyword index, vectors and an evaluation of ``regulations`` (with ``body``) as tables under
    ``out``: chunks, index, vectors, evaluation.  A step that fails is told and the next ones run.

    With ``name``, only regulations whose name has it are chunked and embedded again and the others'
    rows stay; the index, whose frequencies are of all chunks, is always whole.  ``load`` makes the
    encoder, without which there are no vectors; ``evaluate`` gets the tables' paths and returns a
    report; ``enrich`` dates the regulations first; ``skip`` names steps to leave out."""
    paths = {t: f"{out}/{t}" for t in ("chunks", "index", "vectors", "evaluation")}
    for t in ("chunks", "vectors"):
        recovered(spark, paths[t])
    held = {"regulations": regulations}
    steps = []

    def todo():
        rows = held["regulations"]
        return rows.where(F.col("name").contains(name)) if name else rows

    def run_enrich():
        held["regulations"] = dated(regulations)

    def run_chunks():
        chunks = chunking.chunk(todo())
        if name:
            chunks = chunking.refreshed(spark.read.parquet(paths["chunks"]), chunks)
        _replace(spark, chunks, paths["chunks"], "source")

    def run_index():
        keyword.write_index(keyword.build(spark.read.parquet(paths["chunks"]).select("chunk_id", searched_text().alias("text")), "chunk_id"), paths["index"])

    def run_vectors():
        chunks = spark.read.parquet(paths["chunks"])
        if name:
            chunks = chunks.join(todo().select(F.col("id").alias("reg_id")).distinct(), "reg_id", "left_semi")
        _replace(spark, embedding.rebuilt(spark.read.parquet(paths["vectors"]) if name else None, chunks, load), paths["vectors"])

    def run_evaluation():
        evaluate(paths).write.mode("overwrite").json(paths["evaluation"])

    wanted = [("enrich", run_enrich, enrich), ("chunks", run_chunks, True), ("index", run_index, True), ("vectors", run_vectors, load is not None), ("evaluation", run_evaluation, evaluate is not None)]
    for step, run, there in wanted:
        if not there or step in skip:
            steps.append(Step(step, None, 0.0))
            continue
        began = time.monotonic()
        try:
            run()
            steps.append(Step(step, True, time.monotonic() - began))
        except Exception as e:  # told, not raised: the steps after it may still do their work
            steps.append(Step(step, False, time.monotonic() - began, str(e).split("\n")[0]))
    return steps
