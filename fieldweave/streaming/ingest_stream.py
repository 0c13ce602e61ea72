"""Uploads picked up from a folder, each once, with a status per file.

All new files of a trigger go through one Spark job: a file that cannot be used is a row with an error, not an
exception, so it stops neither the others nor the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldweave.functions import schema as G
from fieldweave.functions.text import file_kind
from fieldweave.operators.projection import align_types
from fieldweave.plans.ingest import EntryConfig, ingest
from fieldweave.session import freeze
from fieldweave.sources import csv_records as R
from fieldweave.sources.files import latest_rows

PENDING, PROCESSING, COMPLETED, FAILED = "PENDING", "PROCESSING", "COMPLETED", "FAILED"
STATUS_SCHEMA = "path string, data_entry_id bigint, md5 string, status string, error_message string, n_rows bigint, n_rejected bigint, attempt bigint"
ROW_SCHEMA = T.StructType(
    [
        T.StructField("data_entry_id", T.LongType()),
        T.StructField("field_code", T.StringType()),
        T.StructField("effective_start_date", T.TimestampType()),
        *G.target_schema().fields,
    ]
)
REJECT_SCHEMA = "data_entry_id bigint, line_no bigint, faults string"
IDENTITY_SCHEMA = "field_code string, name string, country string"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


class UploadStore:
    """Tables of processed uploads below one folder: status, identities and field rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str | T.StructType) -> DataFrame:
        path = f"{self.folder}/{name}"
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as error:  # the table is created by its first write
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def write(self, df: DataFrame, name: str, part: str) -> None:
        """One folder per batch: repeating an interrupted batch replaces what it left."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/part={part}")

    def status(self) -> DataFrame:
        return latest_rows(self._read("status", STATUS_SCHEMA), ["path"], "attempt")

    def next_attempt(self) -> int:
        top = self._read("status", STATUS_SCHEMA).agg(F.max("attempt")).collect()[0][0]
        return 0 if top is None else top + 1

    def identities(self, without: str | None = None) -> DataFrame:
        """Known identities, leaving out what the batch ``without`` wrote before it was interrupted."""
        known = self._read("identities", IDENTITY_SCHEMA)
        if without is not None and "part" in known.columns:
            known = known.where(F.col("part") != without)
        return known.drop("part")

    def fields(self) -> DataFrame:
        """Rows of completed entries."""
        done = self.status().where(F.col("status") == COMPLETED).select("data_entry_id")
        return self._read("fields", ROW_SCHEMA).join(done, "data_entry_id", "left_semi")

    def rejects(self) -> DataFrame:
        """Rows of completed entries that could not be converted, with the columns at fault."""
        done = self.status().where(F.col("status") == COMPLETED).select("data_entry_id")
        return self._read("rejects", REJECT_SCHEMA).join(done, "data_entry_id", "left_semi")


def process_files(store: UploadStore, files: DataFrame, config: Mapping[str, Any], as_of: str, part: str | None = None) -> None:
    """Ingest the given files (``path, content``) together and record each one's status and number of rejected rows.

    All tables are written below the name ``part`` (default: a new one), so a batch that is repeated under its name
    after a failure leaves nothing twice.
    Fields in quotes may hold line breaks. Only the widest header's number of columns and a counter come to the driver.
    """
    parsed = EntryConfig.parse(config)
    attempt = store.next_attempt()
    part = f"once-{attempt}" if part is None else part
    sources = [s for s, _ in parsed.mappings]
    name = R.charset(parsed.encoding)
    raw = F.col("content").cast("string") if name == "UTF-8" else F.decode("content", name)
    readable = F.is_valid_utf8(raw)
    texts = files.select("path", F.md5("content").alias("md5"), readable.alias("readable"))
    lines = freeze(R.text_lines(files.where(readable), "path", raw), "upload-lines")
    headers, body = R.records(lines, R.line_blocks(lines, parsed.delimiter), parsed.delimiter, parsed.header_row, numbered=True)
    width = R.header_width(headers, parsed.delimiter)
    names = R.header_names(headers, width, parsed.delimiter).withColumnsRenamed({"_file": "path", "names": "header"})
    headed = texts.join(names, "path", "left")
    missing = F.array_except(F.array(*[F.lit(s) for s in sources]), F.col("header"))
    kind = file_kind(F.element_at(F.split("path", "/"), -1))
    error = (
        F.when(kind.isNull() | (kind != "csv"), F.concat(F.lit("Unsupported file extension: "), F.coalesce(kind, F.lit("none"))))
        .when(~F.col("readable"), F.lit(f"Processing error: not {parsed.encoding}"))
        .when(F.col("header").isNull(), F.lit("Processing error: no header line"))
        .when(F.size(missing) > 0, F.concat(F.lit("Missing source attributes in data: "), F.array_join(missing, ", ")))
    )
    entry = F.conv(F.substring("md5", 1, 15), 16, 10).cast("bigint")
    states = freeze(headed.select("path", "md5", entry.alias("data_entry_id"), error.alias("error_message")), "states")
    started = states.select("path", "data_entry_id", "md5", F.lit(PROCESSING).alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("n_rejected"), F.lit(attempt).cast("bigint").alias("attempt"))
    store.write(started, "status", f"{part}-started")

    good = states.where("error_message is null").select("path", "data_entry_id")
    rows = body.withColumnRenamed("_file", "path").join(headed.select("path", "header").join(good, "path"), "path")
    cells = rows.select("data_entry_id", "header", "line_no", R.cells(F.col("record"), width, parsed.delimiter).alias("cells"))
    named = cells.select(
        "data_entry_id", "line_no", *[F.get("cells", (F.array_position("header", s) - 1).cast("int")).alias(s) for s in sources]
    )
    named = freeze(named, "upload")
    created, data, rejects = ingest(named, parsed, as_of, F.col("_id_data_entry_id"), store.identities(part), ["data_entry_id", "line_no"], "stream")
    data = freeze(align_types(data, ROW_SCHEMA), "rows")
    rejects = rejects.select(F.col("_id_data_entry_id").alias("data_entry_id"), F.col("_id_line_no").cast("bigint").alias("line_no"), "faults")
    rejects = freeze(rejects, "rejects")
    store.write(data, "fields", part)
    store.write(rejects, "rejects", part)
    store.write(created, "identities", part)
    counts = data.groupBy("data_entry_id").agg(F.count(F.lit(1)).alias("n_rows"))
    refused = rejects.groupBy("data_entry_id").agg(F.count(F.lit(1)).alias("n_rejected"))
    finished = states.join(counts, "data_entry_id", "left").join(refused, "data_entry_id", "left").select(
        "path", "data_entry_id", "md5",
        F.when(F.col("error_message").isNull(), COMPLETED).otherwise(FAILED).alias("status"),
        "error_message",
        F.when(F.col("error_message").isNull(), F.coalesce("n_rows", F.lit(0))).alias("n_rows"),
        F.when(F.col("error_message").isNull(), F.coalesce("n_rejected", F.lit(0))).alias("n_rejected"),
        F.lit(attempt + 1).cast("bigint").alias("attempt"),
    )
    store.write(finished, "status", f"{part}-finished")


def ingest_stream(
    spark: SparkSession, inbox: str, store: UploadStore, config: Mapping[str, Any], as_of: str, checkpoint: str
) -> StreamingQuery:
    """Watch a folder and ingest each new file once; content that was completed before is not taken again."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(inbox)

    def run(batch: DataFrame, batch_id: int) -> None:
        first = batch.withColumn("_md5", F.md5("content")).groupBy("_md5").agg(F.min("path").alias("path"))
        # stored first: a repeated batch replaces the status rows it left
        done = freeze(store.status().where(F.col("status") == COMPLETED).select(F.col("md5").alias("_md5")), "done")
        process_files(store, batch.join(first.join(done, "_md5", "left_anti"), "path", "left_semi"), config, as_of, f"batch-{batch_id}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def retry_failed(store: UploadStore, inbox: str, config: Mapping[str, Any], as_of: str) -> None:
    """Try the failed files of the inbox again."""
    failed = store.status().where(F.col("status") == FAILED).select("path")
    files = store.spark.read.format("binaryFile").load(inbox)
    files = files.join(failed, "path", "left_semi")
    first = files.groupBy(F.md5("content").alias("_md5")).agg(F.min("path").alias("path"))
    process_files(store, files.join(first, "path", "left_semi"), config, as_of)
