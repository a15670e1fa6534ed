"""Prepares a session for Python workers: they can import this package, and get small batches."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH, _DEFAULT, _SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def attach(spark: SparkSession) -> None:
    """Ships the package once per application; workers need no copy of their own.  Where the size of
    Arrow batches is Spark's default, it becomes 4 MB: texts are large rows, and a worker
    and its task hold several batches at a time."""
    if spark.conf.get(_BATCH, None) == _DEFAULT:
        spark.conf.set(_BATCH, _SMALL)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessera-src-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
