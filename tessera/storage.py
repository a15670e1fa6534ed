"""Tables that cut lineage: written to the folder that all executors share, and read again."""

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the context's checkpoint folder.  Only where both are
    unset: a temporary folder if driver and executors are one process, else a folder in the
    warehouse, unless that is on the disk of one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _context_folder(spark)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if found.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is on a local disk")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _context_folder(spark: SparkSession) -> str | None:
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return folder.get() if folder.isDefined() else None


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def keep(df: DataFrame, what: str, codec: str = "snappy", files: int | None = None) -> DataFrame:
    """``df`` as a stored table: later reads do not depend on executors that made it.  Of ``files``, as
    many at most are written."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{what}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def delete(*tables: DataFrame) -> None:
    """Deletes tables that keep() has stored and nothing needs any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
