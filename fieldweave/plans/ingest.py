"""Configured upload -> typed field rows, identities and rejects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.functions import schema as G
from fieldweave.functions import units as U
from fieldweave.operators.access import get_or_create
from fieldweave.session import freeze
from fieldweave.sources.files import scan_csv_config


class ConfigError(ValueError):
    """The upload's configuration cannot be used."""


@dataclass(frozen=True)
class EntryConfig:
    """The parts of an upload configuration that processing needs."""

    attributes: Mapping[str, tuple[str, str | None]]  # name -> (type, units)
    mappings: Sequence[tuple[str, str]]  # (source attribute, target attribute)
    delimiter: str = ","
    encoding: str = "utf-8"
    header_row: int = 0

    @staticmethod
    def parse(config: Mapping[str, Any]) -> "EntryConfig":
        errors: list[str] = []
        meta = config.get("data_metadata")
        if not isinstance(meta, Mapping):
            raise ConfigError("data_metadata: Field required")
        for key in ("name", "type", "version", "attributes"):
            if key not in meta:
                errors.append(f"data_metadata -> {key}: Field required")
        if meta.get("type") not in (None, "csv", "shapefile"):
            errors.append("data_metadata -> type: must be csv or shapefile")
        attributes: dict[str, tuple[str, str | None]] = {}
        for i, item in enumerate(meta.get("attributes") or []):
            kind = item.get("type")
            if "name" not in item or kind not in U.SPARK_TYPES:
                errors.append(f"data_metadata -> attributes -> {i}: needs a name and a known type")
            else:
                attributes[item["name"]] = (kind, item.get("units"))
        if not isinstance(config.get("mappings"), Sequence):
            errors.append("mappings: Field required")
        pairs = []
        for i, item in enumerate(config.get("mappings") or []):
            if "source_attribute" not in item or "target_attribute" not in item:
                errors.append(f"mappings -> {i}: needs source_attribute and target_attribute")
            else:
                pairs.append((item["source_attribute"], item["target_attribute"]))
        for side, names in (("source", [s for s, _ in pairs]), ("target", [t for _, t in pairs])):
            repeated = sorted({n for n in names if names.count(n) > 1})
            errors += [f"mappings: {side} attribute '{n}' is mapped twice" for n in repeated]
        csv = ((config.get("file_specific") or {}).get("csv")) or {}
        header_row = csv.get("header_row", 0) or 0
        if header_row < 0:
            errors.append("file_specific -> csv -> header_row: must not be negative")
        if errors:
            raise ConfigError("; ".join(errors))
        return EntryConfig(attributes, pairs, csv.get("delimiter") or ",", csv.get("encoding") or "utf-8", header_row)


def mapping_errors(mappings: DataFrame, attributes: DataFrame) -> DataFrame:
    """Mapping rows whose target is no known attribute, with a message each."""
    bad = mappings.join(attributes, mappings["target_attribute"] == attributes["attribute"], "left_anti")
    text = F.concat(F.lit("Target attribute '"), F.col("target_attribute"), F.lit("' is not a valid attribute"))
    return bad.where(F.col("target_attribute") != "").withColumn("error", text)


def check_mappings(config: EntryConfig) -> list[str]:
    valid = set(G.attribute_names())
    return [f"Target attribute '{t}' is not a valid attribute" for _, t in config.mappings if t and t not in valid]


def profile_dataset(df: DataFrame, mapped: Sequence[str]) -> DataFrame:
    """Row count, column count and the mapped columns that the data lacks."""
    missing = [c for c in mapped if c not in df.columns]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(", ".join(missing)).alias("missing_columns")
    )


def converted_columns(config: EntryConfig, have: Sequence[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Per target: its typed, unit-converted column and a flag for a value that could not be converted."""
    values: dict[str, Column] = {}
    failed: dict[str, Column] = {}
    for source, target in config.mappings:
        if source not in have:
            continue
        if source not in config.attributes:
            raise ConfigError(f"attribute '{source}' is mapped but not described")
        kind, units = config.attributes[source]
        raw = F.col(f"`{source}`")
        try:
            value = U.convert(raw, units, G.attribute_units(target), kind, G.attribute_kind(target))
        except ValueError as error:
            raise ConfigError(str(error)) from error
        allowed = G.ALLOWED.get(target)
        if allowed:
            value = F.when(value.isin(*allowed), value)
        values[target] = value
        failed[target] = U.cast_failed(raw, value)
    return values, failed


# The words that a field of an uploaded text file may hold for a missing value.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]


def present(value: Column) -> Column:
    """The text, null where it is a word for a missing value."""
    return F.when(~value.isin(*MISSING_WORDS), value)


def ingest(
    df: DataFrame,
    config: Mapping[str, Any] | EntryConfig,
    as_of: str,
    entry_id: int | Column,
    identities: DataFrame,
    row_id: Sequence[str],
    batch: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(new identities, field rows, rejects)`` of one upload read as text columns.

    ``row_id`` names the columns identifying an input row. Rows with a value that cannot be converted are
    rejected with the columns at fault; a missing name stays missing. Several uploads can go together: their
    rows then carry the entry (``entry_id`` as a column of ``row_id``, prefixed ``_id_``) and share ``batch``.
    """
    parsed = config if isinstance(config, EntryConfig) else EntryConfig.parse(config)
    problems = check_mappings(parsed)
    missing = [s for s, _ in parsed.mappings if s not in df.columns]
    if missing:
        problems.append(f"Missing source attributes in data: {', '.join(missing)}")
    if not parsed.mappings:
        problems.append("No mappings found in config")
    if problems:
        raise ConfigError(", ".join(problems))
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)} - set(row_id)
    df = df.withColumns({s: present(F.col(f"`{s}`")) for s in parsed.attributes if s in text})
    values, failed = converted_columns(parsed, df.columns)
    faults = F.array_compact(F.array(*[F.when(flag, F.lit(t)) for t, flag in failed.items()]))
    marked = df.select(
        *[F.col(c).alias(f"_id_{c}") for c in row_id], *[v.alias(t) for t, v in values.items()], faults.alias("_faults")
    )
    for c in ("name", "country"):
        if c not in values:
            marked = marked.withColumn(c, F.lit(None).cast("string"))
    ids = [f"_id_{c}" for c in row_id]
    rejects = marked.where(F.size("_faults") > 0).select(*ids, F.array_join("_faults", ", ").alias("faults"))
    good = marked.where(F.size("_faults") == 0).drop("_faults")
    rows, created = get_or_create(good, identities, ids, batch or f"entry-{entry_id}")
    data = rows.withColumns({"data_entry_id": entry_id if isinstance(entry_id, Column) else F.lit(entry_id), "effective_start_date": F.lit(as_of).cast("timestamp")})
    return created, data, rejects


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of each file's bytes; equal contents are listed once, under their first path."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))
    return files.groupBy("md5").agg(F.min("path").alias("path"), F.min("length").alias("length"), F.count(F.lit(1)).alias("n_files"))


def processed_counts(data: DataFrame) -> DataFrame:
    return data.groupBy("data_entry_id").agg(F.count(F.lit(1)).alias("n_rows"))


def entry_status(entries: DataFrame, data: DataFrame, entry_id: int) -> DataFrame:
    """Status, error and produced rows of one entry; no row at all for an unknown id."""
    one = entries.where(F.col("data_entry_id") == entry_id)
    counts = processed_counts(data.where(F.col("data_entry_id") == entry_id))
    return one.join(counts, "data_entry_id", "left").select(
        "data_entry_id", "status", "error_message", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def ingest_file(
    spark: SparkSession, path: str, config: Mapping[str, Any], as_of: str, entry_id: int, identities: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`ingest` of a CSV file; a row is identified by its content and its number among equal rows' file."""
    parsed = EntryConfig.parse(config)
    raw = scan_csv_config(spark, path, None, parsed.delimiter, parsed.encoding, parsed.header_row)
    stored = freeze(raw.withColumn("_row", F.monotonically_increasing_id()), "upload")
    return ingest(stored, parsed, as_of, entry_id, identities, ["_row"])
