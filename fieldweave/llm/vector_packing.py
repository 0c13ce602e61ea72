"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group with a demand vector; each group goes where the dot product of its demand with the
residual capacity is highest. Groups that hold more than a small share of all bytes are split by rows first, so copies
that make up a third of the table spread over the shards.

No task sees all groups: a hash deals them to chunks, each chunk packs its own into as many bundles as there are
shards, and bundles of many chunks are packed again in the same way, level by level, until one set is left; what one
chunk leaves uneven the next level evens out. A level hands on ``shards`` bundles per chunk whatever the chunk holds.

Law: ``bytes``. Sizes (UTF-8 bytes plus 16) of the shards come out near equal; how near is bounded by the largest
group that cannot be split. Null texts are empty texts. Repeated rows, ids and null ids are rows like any other.
An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import col
from fieldweave.session import freeze

SHARDS = 40
ROW_BYTES = 16
CHUNK_GROUPS = 4096
#: A group above total / (shards * SPLIT) is split: at most shards * SPLIT groups can be, which bounds their list.
SPLIT = 64
FAN_IN = 128  # chunks whose bundles are packed together at the next level
WEIGHTS = (4.0, 1.0, 1.0)
ROWS_PER_SLOT_BLOCK = 50_000


def pack(demand: np.ndarray, bins: int, weights: Sequence[float] = WEIGHTS, turn: int = 0) -> np.ndarray:
    """Bin of each row of ``demand`` (one column per resource): largest first, each where the dot product with the
    residual capacity is highest; ties go to the first bin counted from ``turn``."""
    total = demand.sum(axis=0)
    scaled = demand * bins / np.where(total > 0, total, 1.0)  # a bin's capacity is 1 in every resource
    weighted = scaled * np.asarray(weights)
    residual = np.ones((bins, demand.shape[1]))
    at = np.empty(len(demand), np.int64)
    for i in np.argsort(-weighted.max(axis=1), kind="stable"):
        k = int((residual @ weighted[i]).argmax())
        residual[k] -= scaled[i]
        at[i] = k
    return (at + turn) % bins


def _packed(entities: DataFrame, bins: int, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``chunk`` and ``bundle`` of every entity, packed within its chunk."""
    fields = {f.name: f for f in entities.schema.fields}
    schema = ", ".join([f"{k} {fields[k].dataType.simpleString()}" for k in keys] + ["chunk bigint", "bundle int", "bytes double", "tokens double", "rows double"])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(keys), kind="stable")
        demand = frame[["bytes", "tokens", "rows"]].to_numpy(float)
        return frame.assign(bundle=pack(demand, bins, turn=int(frame["chunk"].iloc[0])).astype(np.int32))[[*keys, "chunk", "bundle", "bytes", "tokens", "rows"]]

    return entities.groupBy("chunk").applyInPandas(one, schema)


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(x).cast("double").alias(x) for x in ("bytes", "tokens", "rows")])


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", chunk_groups: int = CHUNK_GROUPS, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` (gapless from 0 in each
    shard) and ``grown_shard`` (null under this law)."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(
        col(doc_id).alias("doc_id"), (F.octet_length(body).cast("bigint") + ROW_BYTES).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.regexp_count(body, F.lit("[^\\x20\\x09-\\x0D]+")).alias("n"), F.md5(body.cast("binary")).alias("key"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = freeze(rows, "rows")
    measure = [F.sum("size").alias("bytes"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = rows.groupBy("key").agg(*measure)
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("g"), F.coalesce(F.max("rows"), F.lit(0)).alias("most")).first()
    limit = max(1, int(total["b"]) // (shards * SPLIT))
    large = groups.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select(F.col("key").alias("_large"), F.least(F.ceil(F.col("bytes") / limit), F.col("rows")).alias("_splits"))
    split = rows.join(F.broadcast(large), F.col("key") == F.col("_large"), "left")
    # rows of a large group are numbered and dealt to its parts in turn: parts differ by one row at most
    dealt_rows = _numbered(split.where(F.col("_splits").isNotNull()), ["key"], max(1, -(-int(total["most"]) // ROWS_PER_SLOT_BLOCK)))
    dealt_rows = dealt_rows.withColumn("part", F.pmod(F.col("number"), F.col("_splits")).cast("int")).drop("number")
    split = split.where(F.col("_splits").isNull()).withColumn("part", F.lit(0)).unionByName(dealt_rows).drop("_large", "_splits")
    split = freeze(split, "split")
    pieces = split.groupBy("key", "part").agg(*measure)
    chunks = max(1, -(-(int(total["g"]) + shards * SPLIT) // chunk_groups))
    dealt = _sums(pieces, "key", "part").withColumn("chunk", F.pmod(F.xxhash64("key", "part"), F.lit(chunks)))
    placed = freeze(_packed(dealt, shards, ["key", "part"]), "pieces")
    place = placed.select("chunk", "bundle").distinct().select("chunk", "bundle", F.col("chunk").alias("_c"), F.col("bundle").alias("_b"))
    bundles = _sums(placed, "chunk", "bundle")
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        level = bundles.withColumnsRenamed({"chunk": "of_chunk", "bundle": "of_bundle"}).withColumn("chunk", F.floor(F.col("of_chunk") / fan_in).cast("bigint"))
        level = freeze(_packed(level, shards, ["of_chunk", "of_bundle"]), "bundles")
        up = level.select(F.col("of_chunk").alias("_c"), F.col("of_bundle").alias("_b"), F.col("chunk").alias("_c2"), F.col("bundle").alias("_b2"))
        place = place.join(up, ["_c", "_b"]).select("chunk", "bundle", F.col("_c2").alias("_c"), F.col("_b2").alias("_b"))
        bundles = _sums(level, "chunk", "bundle")
    shard_of = placed.select("key", "part", "chunk", "bundle").join(place.select("chunk", "bundle", F.col("_b").alias("shard")), ["chunk", "bundle"]).select("key", "part", "shard")
    placed_rows = freeze(split.join(shard_of, ["key", "part"]).select("doc_id", "size", "text_crc32", "shard", "_row"), "placed")
    numbered = _slots(placed_rows, shards)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """``number`` from 0 without gaps among the rows of equal ``keys``: counted in ``blocks`` blocks by a hash of the stored
    row number (a recomputed task numbers its rows the same way) and added up."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    sizes = rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "block").orderBy("_row")
    numbered = rows.withColumn("_n", F.row_number().over(inside)).join(offsets, [*keys, "block"])
    return numbered.withColumn("number", F.col("offset") + F.col("_n") - 1).drop("block", "offset", "_n")


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    blocks = max(1, -(-rows.count() // (shards * ROWS_PER_SLOT_BLOCK)))
    return _numbered(rows, ["shard"], blocks).withColumnRenamed("number", "slot")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Writes ``docs`` (unique ids) in one folder per shard: files of at most ``ROWS_PER_SLOT_BLOCK`` consecutive slots, in
    slot order, so that no task holds a whole shard."""
    tagged = docs.join(assigned.select(col("doc_id").alias("_id"), "shard", "slot"), col(doc_id) == F.col("_id")).drop("_id")
    block = F.floor(F.col("slot") / ROWS_PER_SLOT_BLOCK)
    tagged.repartition("shard", block).sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
