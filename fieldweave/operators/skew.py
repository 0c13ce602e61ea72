"""Joins and totals that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.session import freeze

# Rows of one key that a single task may see; larger keys are split.
ROWS_PER_SPLIT = 200_000


def hot_splits(df: DataFrame, keys: Sequence[str], limit: int, out: str) -> DataFrame:
    """Keys with more than ``limit`` rows and the number of splits each one needs.

    At most ``rows / limit`` keys can qualify, which bounds the size of this table.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias(out))


def _split_of(ids: Sequence[str], splits: Column) -> Column:
    """Split number from the row's own id: a recomputed task lands its rows in the same place."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in ids]), splits.cast("bigint")).cast("int")


def _all_of(splits: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), splits - 1))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_splits(df: DataFrame, counted: DataFrame, keys: list[str], limit: int, out: str, null_safe: bool) -> DataFrame:
    """``df`` with the number of splits its key needs, from the row counts of ``counted``.

    The hot keys are few (see :func:`hot_splits`); whether they are broadcast is left to their measured size.
    """
    marks = {k: f"_k_{k}" for k in keys}
    hot = hot_splits(counted, keys, limit, out).withColumnsRenamed(marks)
    on = [F.col(k).eqNullSafe(F.col(m)) if null_safe else F.col(k) == F.col(m) for k, m in marks.items()]
    return df.join(hot, on, "left").drop(*marks.values()).withColumn(out, F.coalesce(out, F.lit(1)))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ids: Sequence[str],
    right_ids: Sequence[str] | None = None,
    how: str = "inner",
    condition: Column | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
    null_safe: bool = False,
    left_bound: int | None = None,
    right_bound: int | None = None,
    heavy: bool = False,
) -> DataFrame:
    """Equi-join on ``keys`` (plus ``condition``) in which hot keys are cut into blocks.

    ``left_bound`` / ``right_bound`` are known upper limits of the rows one key can have; where they already
    rule out a hot key the counting pass is left out. ``heavy`` marks a ``condition`` that costs far more than
    the bytes joined: the left side keeps its full number of partitions, which adaptive execution would
    otherwise merge by size.

    Hot left keys are split by ``left_ids`` and their right rows copied to each split; for inner joins hot
    right keys are split the same way, so a block is at most ``rows_per_split`` rows a side. The other
    columns of the two sides must have different names.
    """
    keys = list(keys)
    salts: list[str] = []
    if left_bound is None or left_bound > rows_per_split:
        counted = left
        left = _with_splits(left, counted, keys, rows_per_split, "_ls", null_safe)
        right = _with_splits(right, counted, keys, rows_per_split, "_ls", null_safe)
        left = left.withColumn("_lsalt", F.when(F.col("_ls") > 1, _split_of(left_ids, F.col("_ls"))).otherwise(0)).drop("_ls")
        salts.append("_lsalt")
    counted = right.drop("_ls")
    if right_ids is not None and how == "inner" and (right_bound is None or right_bound > rows_per_split):
        left = _with_splits(left, counted, keys, rows_per_split, "_rs", null_safe)
        right = _with_splits(right, counted, keys, rows_per_split, "_rs", null_safe)
        right = right.withColumn("_rsalt", F.when(F.col("_rs") > 1, _split_of(right_ids, F.col("_rs"))).otherwise(0)).drop("_rs")
        left = left.withColumn("_rsalt", _all_of(F.col("_rs"))).drop("_rs")
        salts.append("_rsalt")
    if "_lsalt" in salts:
        right = right.withColumn("_lsalt", _all_of(F.col("_ls"))).drop("_ls")
    if heavy:
        left = left.repartition(shuffle_partitions(left), *keys, *salts)
    renamed = {k: f"_r_{k}" for k in [*keys, *salts]}
    right = right.withColumnsRenamed(renamed)
    on = [F.col(k).eqNullSafe(F.col(r)) if null_safe else F.col(k) == F.col(r) for k, r in renamed.items()]
    if condition is not None:
        on.append(condition)
    return left.join(right, on, how).drop(*renamed.values(), *salts)


def with_group_totals(
    df: DataFrame, keys: Sequence[str], totals: Sequence[Column], row_ids: Sequence[str], rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Each row with totals of its group.

    Totals are pre-aggregated on the map side and joined back, one row per group, so a group is never
    gathered in one task as a window would do. The rows of a large group are split by ``row_ids`` and the
    group's totals copied to each split; the counts that tell which groups are large come with the totals,
    which are stored once.
    """
    keys = list(keys)
    marks = {k: f"_g_{k}" for k in keys}
    same = lambda names: [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    per_group = freeze(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *totals).withColumnsRenamed(marks), "totals")
    hot = per_group.where(F.col("_rows") > rows_per_split)
    if hot.isEmpty():
        return df.join(per_group.drop("_rows"), same(marks), "left").drop(*marks.values())
    splits = F.ceil(F.col("_rows") / F.lit(rows_per_split)).cast("int")
    hot_marks = {k: f"_h_{k}" for k in keys}
    hot = hot.select(*[F.col(marks[k]).alias(h) for k, h in hot_marks.items()], splits.alias("_ls"))
    left = df.join(hot, same(hot_marks), "left").drop(*hot_marks.values())
    left = left.withColumn("_lsalt", F.when(F.col("_ls") > 1, _split_of(row_ids, F.col("_ls"))).otherwise(0)).drop("_ls")
    right = per_group.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), splits - 1))).drop("_rows")
    return left.join(right, [*same(marks), F.col("_lsalt") == F.col("_rsalt")], "left").drop(*marks.values(), "_lsalt", "_rsalt")
