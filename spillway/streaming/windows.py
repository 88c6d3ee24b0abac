"""Batch operators on streams.

traffic.totals, traffic.by_feed, traffic.dns_statistics and popularity.domain_count group by
the window itself and run on a stream as they are, once late rows have a bound: in append
mode an interval is given out when the watermark has passed its end, so the last one stays
open; ``run_to_end`` gives out that one too.  Other operators run on a stream's
micro-batches through ``run``'s sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Late rows wait as long as fragments do.
LATE = "30 seconds"


def on_stream(messages: DataFrame, operator: Callable[..., DataFrame], *args, late: str = LATE, **options) -> DataFrame:
    """The operator's rows on a stream with a watermark on ``ts``."""
    return operator(messages.withWatermark("ts", late), *args, **options)


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Hands each batch to ``sink``; without ``every`` all that is there is taken and the query ends."""
    w = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def run_to_end(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes intervals as they stand after each batch, the open ones too, to a folder for each batch; a repeated batch replaces its folder."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run(df, keep, checkpoint, "update", every)


def last_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each interval (and other keys) that ``run_to_end`` wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *(F.col("_last")[c].alias(c) for c in rest))
