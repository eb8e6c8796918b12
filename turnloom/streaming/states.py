"""Running queries with state of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The store that state of transformWithState needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


def append_available(rows: DataFrame, out: str) -> None:
    """Takes in all that has arrived and appends the rows to the table at `out`.

    Progress and state are kept beside it, so a later call, or one after a
    failure, goes on from there, and the table has each row once. The session's
    own choice of a store is left as it was.
    """
    conf = rows.sparkSession.conf
    before = conf.get(_SETTING, None)
    conf.set(_SETTING, STORE)  # a query keeps the settings that it was started with
    try:
        running = rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(_SETTING)
        else:
            conf.set(_SETTING, before)
    running.awaitTermination()
