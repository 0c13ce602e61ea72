"""Golden records: one row per entity from the rows of its sources, by a rule per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.aggregates import first_rows, group_medians, group_modes

# rule name -> aggregate expression of (column, as_of_year); users may add their own
AggregateRule = Callable[[Column, int], Column]
_RULES: dict[str, AggregateRule] = {
    "average": lambda c, year: F.avg(c),
    "avg_age": lambda c, year: (F.lit(year) - F.avg(c)).cast("int"),
}
_MEDIANS = {"median": False, "median int": True, "average int": True}  # "average int" is a median by definition
_MODE = "most frequent"


def register_merge_rule(name: str, rule: AggregateRule) -> None:
    _RULES[name] = rule


def merge_by_rules(df: DataFrame, key: str, rules: Mapping[str, str], as_of_year: int) -> DataFrame:
    """Apply ``{column: rule}`` to the non-null values per key.

    Means are one partial aggregation; modes and medians take paths that do not hold a group in one task. A
    rule nobody registered returns the sorted list of values as it is.
    """
    by = {c: r for c, r in rules.items() if r in _RULES}
    medians = {c: r for c, r in rules.items() if r in _MEDIANS}
    modes = [c for c, r in rules.items() if r == _MODE]
    lists = [c for c in rules if c not in by and c not in medians and c not in modes]
    simple = [_RULES[r](F.col(c), as_of_year).alias(c) for c, r in by.items()]
    simple += [F.when(F.count(c) > 0, F.array_sort(F.collect_list(c))).alias(c) for c in lists]
    out = df.groupBy(key).agg(*simple) if simple else df.select(key).distinct()
    if medians:
        numbers = df.select(key, *[F.col(c).cast("double").alias(c) for c in medians])
        found = group_medians(numbers, [key], list(medians))
        whole = [F.col(c).cast("int").alias(c) if _MEDIANS[r] else F.col(c) for c, r in medians.items()]
        out = out.join(found.select(key, *whole), key, "left")
    if modes:
        out = out.join(group_modes(df, [key], modes), key, "left")
    return out.select(key, *rules)


def lookup_first(matches: DataFrame, sources: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Match rows with their first source row by ``(source_id, field_id)``; matches without one are dropped."""
    first = first_rows(sources.select("source_id", "field_id", "seq", *columns), ["source_id", "field_id"], "seq").drop("seq")
    return matches.join(first, ["source_id", "field_id"])


def best_name(matches: DataFrame) -> DataFrame:
    """Name of the row with the highest score, the earliest on ties."""
    return matches.groupBy("entity_id").agg(F.max_by("name", F.struct(F.col("score"), -F.col("seq"))).alias("name"))


def sources_used(matches: DataFrame) -> DataFrame:
    """Distinct source ids joined by commas; the list is as long as the number of sources."""
    distinct = matches.select("entity_id", "source_id").distinct()
    return distinct.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("source_id")), ", ").alias("sources_used"))


def lineage_rows(looked_up: DataFrame, columns: Sequence[str], key: str = "entity_id") -> DataFrame:
    """Which (source, field) contributed to which column, one row each."""
    items = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return looked_up.select(key, F.explode(F.array_compact(items)).alias("column"), "source_name", "field_id")


def lineage_map(looked_up: DataFrame, columns: Sequence[str], key: str = "entity_id") -> DataFrame:
    """Lineage as one JSON text per entity; its size is that of the entity's own contributions."""
    per_column = (
        lineage_rows(looked_up, columns, key)
        .groupBy(key, "column")
        .agg(F.array_sort(F.collect_list(F.struct("source_name", "field_id"))).alias("used"))
    )
    entries = per_column.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("column", "used"))).alias("_e"))
    return entries.select(key, F.to_json(F.map_from_entries("_e")).alias("lineage"))
