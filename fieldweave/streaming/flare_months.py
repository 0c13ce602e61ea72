"""Monthly flare volumes from a stream of timestamped observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldweave.session import scratch_path
from fieldweave.sources.files import latest_rows


def monthly_volumes(events: DataFrame, ts: str = "ts", flare: str = "id", volume: str = "bcm", late: str = "40 days") -> DataFrame:
    """Volume per flare and calendar month; state of a month is dropped once the watermark has passed it."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(F.col(ts), "1 day").alias("_day"), F.col(flare).alias("id"))
        .agg(F.sum(volume).alias("bcm"), F.count(F.lit(1)).alias("n"))
        .select(F.col("_day.start").alias("day"), "id", "bcm", "n")
    )


def write_months(events: DataFrame, path: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """Run until the input is exhausted; each update appends the new totals of the days it touched."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    return (
        monthly_volumes(events, **columns)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """Current volume per flare and month: the latest total of each day, added up by month."""
    days = latest_rows(spark.read.parquet(f"{path}/b=*"), ["day", "id"], "batch")
    return days.groupBy(F.date_trunc("month", "day").alias("month"), "id").agg(F.sum("bcm").alias("bcm"), F.sum("n").alias("n"))


def months_of_stream(events: DataFrame, **columns: str) -> DataFrame:
    """Drain the stream into the shared folder and read the result back."""
    spark = events.sparkSession
    path = scratch_path(spark, "months")
    query = write_months(events, path, scratch_path(spark, "months-state"), **columns)
    query.awaitTermination()
    return read_months(spark, path)
