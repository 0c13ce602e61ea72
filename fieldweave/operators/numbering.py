"""Global order at scale: consecutive numbers and running sums without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.session import scratch_path

_PART_BITS = 33  # monotonically_increasing_id: partition number above, position in the partition below


def _all(df: DataFrame) -> list[Column]:
    """The columns by quoted name: source columns may carry dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def _ordered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, each with its partition ``_part`` and position ``_pos``.

    Written once to the shared folder: range boundaries come from a sample, so the layout must be fixed
    before its partition sizes are used.
    """
    spark = df.sparkSession
    order = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    mark = F.monotonically_increasing_id()
    frame = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", mark)
    path = scratch_path(spark, "ordered")
    frame.write.parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    return stored.select(
        *_all(df),
        F.shiftright("_mark", _PART_BITS).alias("_part"),
        F.col("_mark").bitwiseAND(F.lit((1 << _PART_BITS) - 1)).alias("_pos"),
    )


def number_rows(df: DataFrame, order: Sequence[str | Column], out: str = "n", start: int = 0) -> DataFrame:
    """``start, start+1, ...`` in the order given (made unique by the caller)."""
    rows = _ordered(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition: the window below runs over at most the number of partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.join(F.broadcast(offsets), "_part")
    return numbered.select(*_all(df), (F.col("_offset") + F.col("_pos") + F.lit(start)).cast("bigint").alias(out))


def running_sum(df: DataFrame, order: Sequence[str | Column], value: str, out: str = "running") -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one."""
    rows = _ordered(df, order)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .select(*_all(df), out)
    )


def dense_renumber(df: DataFrame, id_col: str) -> DataFrame:
    """Surviving ids become 0..n-1 in id order."""
    new = number_rows(df.select(id_col).distinct(), [id_col], "_new")
    return df.join(new, id_col).withColumn(id_col, F.col("_new")).drop("_new")


def allocate_ids(unmatched: DataFrame, existing: DataFrame, id_col: str, seq: str) -> DataFrame:
    """``max(existing id) + 1, + 2, ...`` for the unmatched rows in row order."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(-1)))
    numbered = number_rows(unmatched, [seq], "_k", start=1)
    return numbered.withColumn(id_col, top.scalar() + F.col("_k")).drop("_k")
