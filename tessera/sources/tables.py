"""Schemas, loaders and sinks of the engine's own tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators.chunking import body_of
from .files import write_file

_S = "{} string"
REGULATION = ", ".join(map(_S.format, "id source category name department contact rule_no date source_url law_url text_file".split())) + ", rulebook_page int, rulebook_page_end int, enforce_date string, revision_date string, revision_type string, status string"
CHUNK = ", ".join(map(_S.format, "chunk_id reg_id source category name article article_title chapter clause department contact source_url law_url text".split()))
ASK_LOG = "timestamp string, question string, chunk_ids array<string>, answer string, took_ms double, found boolean, used_llm boolean, status string, backend string"
FEEDBACK = "timestamp string, question string, vote string, answer_preview string, chunk_ids array<string>, comment string"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_log(spark: SparkSession, path: str, schema: str = ASK_LOG, days: int | None = None) -> DataFrame:
    """Daily JSONL logs: lines that are no JSON, and feedback files, are skipped; of ``days``, files
    named by an older day are, too."""
    lines = spark.read.text(path).withColumn("__file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).where(~F.col("__file").startswith("feedback-"))
    parsed = lines.select("__file", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r is not null and r._bad is null")
    rows = parsed.select("__file", "r.*").drop("_bad")
    if days is not None:
        day = F.try_to_timestamp(F.regexp_extract("__file", r"^(\d{4}-\d{2}-\d{2})\.", 1), F.lit("yyyy-MM-dd")).cast("date")
        rows = rows.where(day.isNull() | (day >= F.date_sub(F.current_date(), days)))
    return rows.drop("__file")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(text_file, body) of stored regulation texts."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.replace(F.input_file_name(), F.lit("\\"), F.lit("/")).alias("text_file"), body_of(F.col("value")).alias("body"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as a table partitioned by source."""
    chunks.write.mode("overwrite").partitionBy("source").parquet(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Appends answers to the log, untruncated."""
    entries.write.mode("append").json(path)


def feedback_entries(entries: DataFrame) -> DataFrame:
    """Feedback cut to its limits; votes other than up and down are refused."""
    n = C.FEEDBACK_LIMITS
    cut = lambda c: F.substring(c, 1, n[c])
    return entries.where(F.col("vote").isin("up", "down")).select("timestamp", cut("question").alias("question"), "vote", cut("answer_preview").alias("answer_preview"), F.slice("chunk_ids", 1, n["chunk_ids"]).alias("chunk_ids"), cut("comment").alias("comment"))


def contact_sheet(groups: DataFrame, source: str, department: str, contact: str, count: str, names: str) -> DataFrame:
    """The contacts in order of source and department, with empty columns for corrections."""
    columns = [F.col(c).alias(h) for c, h in zip((source, department, contact, count, names), C.CONTACT_HEAD, strict=False)]
    return groups.select(*columns, *(F.lit("").alias(h) for h in C.CONTACT_HEAD[5:])).orderBy(*C.CONTACT_HEAD[:3])


def write_contacts(groups: DataFrame, path: str) -> None:
    """The contact sheet, in its order, as one CSV file that spreadsheets read as UTF-8."""
    write_file(groups, path, "csv")


def write_markdown(rows: DataFrame, title: str, note: str, path: str) -> None:
    """A Markdown file: title, note, and the rows, in their order, as a table with its head."""
    head = [f"# {title}", "", note, "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines = rows.sparkSession.createDataFrame([(line, i - len(head)) for i, line in enumerate(head)], "line string, __at bigint")
    every = lines.union(markdown_table(rows).withColumn("__at", F.monotonically_increasing_id()))
    every.repartition(1).sortWithinPartitions("__at").drop("__at").write.mode("overwrite").text(path)


def markdown_table(rows: DataFrame) -> DataFrame:
    """(line): rows as lines of a Markdown table, without its two header lines."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |")).alias("line"))


def with_default_contact(rows: DataFrame, contacts: dict[str, str], default: str) -> DataFrame:
    """``contact`` by department; a missing department is the default one, and an unknown one has its contact."""
    known = F.create_map(*[F.lit(x) for kv in contacts.items() for x in kv])
    name = F.when(F.coalesce("department", F.lit("")) == "", default).otherwise(F.col("department"))
    return rows.withColumns({"department": name, "contact": F.coalesce(F.try_element_at(known, name), F.lit(contacts[default]))})


def write_report(report: DataFrame, path: str) -> None:
    """An evaluation's report as JSON lines, for Spark to read; write_file() makes a JSON array of it."""
    report.write.mode("overwrite").json(path)


def merge_sources(university: DataFrame, foundation: DataFrame) -> DataFrame:
    """Regulations of both collections; columns that one lacks are null."""
    return university.unionByName(foundation, allowMissingColumns=True)
