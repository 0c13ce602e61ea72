"""Aggregations that never gather one group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.numbering import running_sum

# Above this many rows a group's exact median is taken from a global sort instead of a per-group buffer.
MEDIAN_BUFFER_ROWS = 1_000_000


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], cast: str) -> DataFrame:
    """Long form ``keys, column, value`` of the non-null values."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns])
    long = df.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.column", "_i.value")
    return long.where(F.col("value").isNotNull())


def _spread(long: DataFrame, keys: Sequence[str], columns: Sequence[str], value: str) -> DataFrame:
    """Back to one column each; every (key, column) has one row here."""
    picks = [F.max(F.when(F.col("column") == c, F.col(value))).alias(c) for c in columns]
    return long.groupBy(*keys).agg(*picks)


def group_modes(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column (the smallest on ties), by two partial aggregations."""
    outs = []
    for cast, cols in _by_type(df, columns).items():
        long = melt(df, keys, cols, cast)
        counts = long.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("_n"))
        best = counts.groupBy(*keys, "column").agg(F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("_mode"))
        outs.append(_spread(best, keys, cols, "_mode"))
    return _join_all(outs, keys)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    quantiles: Mapping[str, float],
    buffer_rows: int = MEDIAN_BUFFER_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles; output ``<column><suffix>`` for each ``suffix: q``.

    Ordinary groups use the built-in percentile. Groups with more than ``buffer_rows`` rows are ranked by a
    distributed sort and read off at the wanted ranks; the list of those groups is at most
    rows / buffer_rows long.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > buffer_rows).select(*keys)
    plain = [F.percentile(c, F.lit(q)).alias(f"{c}{suffix}") for c in columns for suffix, q in quantiles.items()]
    if hot.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    on = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    marks = hot.withColumnsRenamed({k: f"_h_{k}" for k in keys})
    cold = df.join(marks, on, "left_anti").groupBy(*keys).agg(*plain)
    long = melt(df.join(marks, on, "left_semi"), keys, columns, "double")
    # one row per distinct value, with the ranks it covers: copies of a value cost nothing further on
    counts = long.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, [*keys, "column", "value"], "_n", "_upto")
    ranked = ranked.withColumns({"_from": F.col("_upto") - F.col("_n"), "_to": F.col("_upto") - 1})
    span = ranked.groupBy(*keys, "column").agg(F.min("_from").alias("_first"), F.max("_to").alias("_last"))
    span = span.withColumnsRenamed({k: f"_s_{k}" for k in [*keys, "column"]})
    back = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in [*keys, "column"]]
    placed = ranked.join(span, back)

    def read_off(column: str, q: float) -> Column:
        at = F.col("_first") + F.lit(q) * (F.col("_last") - F.col("_first"))
        low, high = F.floor(at), F.ceil(at)
        share = at - low
        covers = lambda rank: (F.col("_from") <= rank) & (rank <= F.col("_to"))
        part = F.when(covers(low), F.col("value") * (1 - share)).otherwise(F.lit(0.0))
        part = part + F.when(covers(high) & (high > low), F.col("value") * share).otherwise(F.lit(0.0))
        return F.sum(F.when((F.col("column") == column) & (covers(low) | covers(high)), part))

    reads = [read_off(c, q).alias(f"{c}{suffix}") for c in columns for suffix, q in quantiles.items()]
    return cold.unionByName(placed.groupBy(*keys).agg(*reads))


def group_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buffer_rows: int = MEDIAN_BUFFER_ROWS) -> DataFrame:
    return group_quantiles(df, keys, columns, {"": 0.5}, buffer_rows)


def _by_type(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    kinds = dict(df.dtypes)
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(kinds[c], []).append(c)
    return groups


def _join_all(frames: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    def full(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, list(keys), "full")

    return reduce(full, frames)


def first_rows(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """First row per key in ``seq`` order, as a partial aggregate (``min_by`` of the whole row)."""
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(seq)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def group_size_filter(df: DataFrame, keys: Sequence[str], keep: str) -> DataFrame:
    """Rows of groups of exactly one row (``single``) or of more (``shared``), by semi join."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.where(F.col("_n") == 1 if keep == "single" else F.col("_n") > 1)
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def count_having(df: DataFrame, key: str, source: str, listed: Sequence[str], at_least: int) -> DataFrame:
    rows = df.where(F.col(source).isin(*listed)).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.where(F.col("n_rows") >= at_least)


def time_weighted_means(df: DataFrame, key: str, period: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each column weighted by days of the month, over rows with a ``YYYY-MM`` period."""
    month = df.where(F.col(period).rlike(r"^\d{4}-\d{2}$"))
    days = F.dayofmonth(F.last_day(F.to_date(F.concat(F.col(period), F.lit("-01")))))
    sums = [F.coalesce(F.try_divide(F.sum(F.col(c) * days), F.sum(days)), F.lit(0.0)).alias(c) for c in columns]
    return month.groupBy(key).agg(*sums)


def weighted_average(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distribution_summary(df: DataFrame, category: str, number: str, limit: float, bins: int = 10) -> DataFrame:
    """Box-plot figures of ``number`` by category over all its values, and a histogram of ``bins`` bins over [0, limit].

    ``limit`` is the axis of the picture only: values below it count in bin -1, values above in bin ``bins``, and the
    figures are over all of them. Rows without a number have nothing to show.
    """
    width = limit / bins
    rows = df.where(F.col(number).isNotNull())
    inside = F.least(F.floor(F.col(number) / F.lit(width)), F.lit(bins - 1)).cast("int")
    bin_no = F.when(F.col(number) < 0, -1).when(F.col(number) > limit, bins).otherwise(inside)
    counts = rows.groupBy(category, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("bin_min"), F.max(number).alias("bin_max")
    )
    totals = counts.groupBy(category).agg(
        F.sum("n").alias("n_rows"), F.min("bin_min").alias("low"), F.max("bin_max").alias("high")
    )
    quartiles = group_quantiles(rows, [category], [number], {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    quartiles = quartiles.withColumnsRenamed({f"{number}_{q}": q for q in ("q1", "q2", "q3")})
    return counts.select(category, "bin", "n").join(totals, category).join(quartiles, category)


def non_null_cells(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of non-null cells over all other columns, in one pass."""
    cols = [c for c in df.columns if c not in keys]
    total = reduce(lambda a, b: a + b, [F.count(F.col(f"`{c}`")) for c in cols])
    return df.groupBy(*keys).agg(total.alias("n_cells"))


def product_sum(a: Column, b: Column) -> Column:
    return F.sum(a.try_cast("double") * b.try_cast("double"))


def overlap_count(matches: DataFrame, entity: str, source: str, first: str, second: str) -> DataFrame:
    """Distinct entities that have rows of both sources (a source is named by a part of its id)."""
    has = lambda text: F.max(F.when(F.col(source).contains(text), 1).otherwise(0))
    both = matches.groupBy(entity).agg(has(first).alias("_a"), has(second).alias("_b"))
    return both.where("_a = 1 and _b = 1").agg(F.count(F.lit(1)).alias("n_entities"))


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
