"""Tables that cut lineage, as for the rest of the library, and scratch tables."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import delete, keep, shared_folder

__all__ = ["Scratch", "delete", "few", "is_few", "keep", "local", "shared_folder"]

#: Ids of so many bytes at most are broadcast, reckoned with so many bytes a row besides.
FEW_BYTES, ROW_BYTES = 8 << 20, 16


def few(ids: DataFrame, key: str | None = None) -> DataFrame:
    """A table of ids, to be broadcast if the bytes of its column ``key`` are few; else it meets rows in a
    shuffle.  The table is read for that."""
    return F.broadcast(ids) if is_few(ids, key) else ids


def is_few(ids: DataFrame, key: str | None = None) -> bool:
    """If the bytes of a table's ids are few; the table is read for that."""
    key = key or ids.columns[0]
    wide = F.coalesce(F.octet_length(key), F.lit(0)) if dict(ids.dtypes)[key] in ("string", "binary") else F.lit(8)
    size = ids.agg(F.sum(wide + ROW_BYTES)).first()[0] or 0
    return size <= FEW_BYTES


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows, sent as Arrow data: from a list, Spark would start Python workers
    of another kind on every executor, which then stay."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], kinds.names), StructType.fromDDL(schema))


class Scratch:
    """Stored tables of one computation; those that nothing needs any more are deleted."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        self.tables.append(keep(df, what))
        return self.tables[-1]

    def clear(self, *but: DataFrame) -> None:
        """Deletes all of its tables ``but`` these."""
        kept = [t for t in self.tables if any(t is b for b in but)]
        delete(*(t for t in self.tables if not any(t is b for b in but)))
        self.tables = kept
