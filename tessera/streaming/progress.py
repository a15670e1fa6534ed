"""The resume log as a stream: the last record of each id, with keyed state and a sink that batches overwrite."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import boards


def last_records(stream: DataFrame, key: str = "id", order: str = "line_no", kept_ms: int | None = None) -> DataFrame:
    """Each record of ``stream`` that is newer, by ``order`` (a whole number), than all of its ``key`` before it; of a
    batch only the newest one.  Late and repeated records give nothing.

    The state of a key is the number of its newest record.  With ``kept_ms`` it is dropped after so long
    without records; what then comes late is passed on, and current() still settles it by its number.
    Such a stream looks for what to drop as long as it runs, so it does not end by itself.  Records without
    a key or a number are left out."""

    def newest(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for rows in batches:
            top = rows.loc[[rows[order].idxmax()]]
            if best is None or top[order].iloc[0] >= best[order].iloc[0]:
                best = top
        if best is not None and (not state.exists or best[order].iloc[0] > state.get[0]):
            state.update((int(best[order].iloc[0]),))
            yield best
        if kept_ms:
            state.setTimeoutDuration(kept_ms)

    rows = stream.where(stream[key].isNotNull() & stream[order].isNotNull())
    return rows.groupBy(key).applyInPandasWithState(newest, rows.schema, "newest bigint", "update", GroupStateTimeout.ProcessingTimeTimeout if kept_ms else GroupStateTimeout.NoTimeout)


def write(records: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts writing ``records``, a folder for each batch, which the batch overwrites if it runs again; with ``once``,
    until what is there has been read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = records.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str, key: str = "id", order: str = "line_no") -> DataFrame:
    """The last record of each key, of all batches that are written."""
    return boards.last_records(spark.read.parquet(path).drop("batch"), key, order)
