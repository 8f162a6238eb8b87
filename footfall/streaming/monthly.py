"""Running monthly counts while the log arrives in pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from footfall.schema import NAME, TARGET_EVENT, TS


def stream_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a few files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_monthly(events: DataFrame, target: str = TARGET_EVENT) -> DataFrame:
    """Target events per month over everything seen so far.

    State holds one counter per month, so it does not grow with the log. Late
    pieces of the log simply add to their month.
    """
    month = F.trunc(F.to_date(F.col(TS).cast("timestamp")), "month")
    return events.where(F.col(NAME) == target).groupBy(month.alias("ds")).agg(F.count("*").alias("y"))


def run_monthly(
    counts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand the full table of counts to ``sink`` after every micro-batch, then stop
    once all present files are read. The checkpoint resumes after a failure."""
    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )


def monthly_to_table(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run to the end of the present files and return the counts as a table."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        # Each batch carries the full counts, so replacing the table is idempotent.
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    run_monthly(counts, sink, checkpoint).awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(path)
