"""A mistie table kept up to date from a stream of mistie files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from traceflow.operators.ties import oriented, upsert

SCHEMA = "line_a string, trc_a long, line_b string, trc_b long, x double, y double, zdiff double, phasediff double, ampdiff double, quality double"


def keep_current(stream: DataFrame, table: str, checkpoint: str, replace: bool = True) -> StreamingQuery:
    """Merge each micro-batch of ties into versions of the folder `table` (table/v=N); a batch that runs again writes its version again,
    so a lost driver repeats no row. With replace, of a crossing seen twice the newer row stays, else the older."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = oriented(batch)
        if n:
            old = spark.read.schema(new.schema).parquet(f"{table}/v={n - 1}")
            new = upsert(old, new, replace, ["zdiff", "phasediff", "ampdiff"])
        else:
            new = upsert(new.limit(0), new, replace, ["zdiff", "phasediff", "ampdiff"])
        new.write.mode("overwrite").parquet(f"{table}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
