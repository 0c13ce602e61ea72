"""Schema mapping, ordering, renaming and simple row rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.functions import recode
from fieldweave.functions.schema import target_schema
from fieldweave.operators.numbering import number_rows

ColumnFn = Callable[..., Column | dict[str, Column]]
# target column -> (input columns, function of those columns)
OpTable = Mapping[str, tuple[Sequence[str], ColumnFn]]


def _missing(target: str) -> Column:
    """Null in the type the target schema declares (text for a name it does not know)."""
    kinds = {f.name: f.dataType for f in target_schema().fields}
    return F.lit(None).cast(kinds.get(target, T.StringType()))


def mapped_columns(df: DataFrame, ops: OpTable, targets: Sequence[str]) -> list[Column]:
    """One column per target: its function over the inputs, null where it is not configured or an input is absent.

    A function may return several named columns (multi-hot flags); those go by their own names.
    """
    have = set(df.columns)
    made: dict[str, Column] = {}
    for target, (inputs, fn) in ops.items():
        if set(inputs) <= have:
            out = fn(*[F.col(f"`{c}`") for c in inputs])
            made.update(out if isinstance(out, dict) else {target: out})
        else:
            made.setdefault(target, _missing(target))
    names = list(dict.fromkeys([*targets, *made]))
    return [made.get(n, _missing(n)).alias(n) for n in names]


def map_schema(df: DataFrame, ops: OpTable, targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *mapped_columns(df, ops, targets))


def identity_ops(columns: Sequence[str]) -> dict[str, tuple[list[str], ColumnFn]]:
    """Every column mapped to itself (sources that already use the target names)."""
    return {c: ([c], lambda value: value) for c in columns}


def reorder_front(df: DataFrame, front: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in [*front, *[c for c in df.columns if c not in front]]])


def add_source_identity(df: DataFrame, name: str, time: str) -> DataFrame:
    return df.withColumns({"source_id": F.lit(f"{name}{time}"), "source_name": F.lit(name)})


def row_counter_id(df: DataFrame, order: Sequence[str], out: str = "field_id", start: int = 0) -> DataFrame:
    return number_rows(df, order, out, start)


def recode_targets(df: DataFrame, as_of_year: int, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *recode.target_columns(df.columns, as_of_year))


def filter_recode(df: DataFrame, column: str, codes: Mapping[str, str]) -> DataFrame:
    """Rows whose value is a key of ``codes``, with the value translated."""
    out = F.lit(None).cast("string")
    for old, new in codes.items():
        out = F.when(F.col(column) == old, F.lit(new)).otherwise(out)
    return df.where(F.col(column).isin(*codes)).withColumn(column, out)


def null_outside(value: Column, low: float | None = None, high: float | None = None) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(None)).otherwise(value)


def out_of_range(rules: Mapping[str, tuple[float, float]]) -> Column:
    """Array of the columns whose non-null value lies outside its closed range."""
    checks = [F.when(~F.col(c).between(low, high), F.lit(c)) for c, (low, high) in rules.items()]
    return F.array_compact(F.array(*checks))


def range_violations(df: DataFrame, rules: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Number of violations per ruled column, in one pass."""
    counts = [F.count(F.when(~F.col(c).between(low, high), 1)).alias(c) for c, (low, high) in rules.items()]
    return df.agg(*counts)


def range_rejects(df: DataFrame, rules: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumn("violations", out_of_range(rules)).where(F.size("violations") > 0)


def page(df: DataFrame, skip: int = 0, limit: int = 10, order_by: str | Sequence[str] = "id") -> DataFrame:
    """One page of a listing in key order."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*order).offset(skip).limit(limit)


def page_with_total(df: DataFrame, skip: int = 0, limit: int = 100, order_by: str | Sequence[str] = "id") -> DataFrame:
    total = df.agg(F.count(F.lit(1)))
    return page(df, skip, limit, order_by).withColumn("total", total.scalar())


def align_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` that ``df`` has, in its types; missing ones are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata or None) for f in schema]
    )
