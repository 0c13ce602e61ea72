"""Queries that run a stream over the test tables until its input is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.catalog.base import num, query, rounded
from fieldweave.catalog.composite import UPLOAD_CONFIG, upload_rows
from fieldweave.session import scratch_path
from fieldweave.streaming.flare_months import months_of_stream
from fieldweave.streaming.ingest_stream import UploadStore, ingest_stream


@query(
    "STR1_ingest_stream",
    f"""SELECT p_brand AS country, count(*) AS n_rows, round(sum(p_retailprice / {num(0.158987294928)}), 2) AS oil_prod FROM part WHERE p_partkey % 13 <> 0 GROUP BY p_brand""",
)
def _(fx):
    inbox = scratch_path(fx.spark, "inbox")
    upload_rows(fx).repartition(4).write.option("sep", ";").csv(inbox, header=True)
    store = UploadStore(fx.spark, scratch_path(fx.spark, "store"))
    ingest_stream(fx.spark, f"{inbox}/*.csv", store, UPLOAD_CONFIG, "2024-01-01", scratch_path(fx.spark, "inbox-state")).awaitTermination()
    return store.fields().groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), rounded(F.sum("oil_prod"), 2).alias("oil_prod"))


@query(
    "STR2_flare_month_stream",
    "SELECT user_id AS id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, round(sum(value), 4) AS bcm, count(*) AS n FROM events GROUP BY 1, 2",
)
def _(fx):
    batch = fx.table("events")
    events = fx.spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(fx.folder)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = months_of_stream(events, ts="ts", flare="user_id", volume="value")
    return out.select("id", F.col("month").cast("timestamp_ntz").alias("month"), rounded("bcm", 4).alias("bcm"), F.col("n").cast("bigint").alias("n"))
