"""Small inputs over all cores."""

from pyspark.sql import DataFrame

#: Bytes of a usual row group, the least that a task can read of a file.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it may be less than a row group for each: what
    is computed from it would else be the work of few tasks.  Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP else df
