"""How the sources cover each other and the golden records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.aggregates import group_size_filter, value_counts


def entity_sources(matches: DataFrame) -> DataFrame:
    """Distinct (entity, source): at most one row per source for an entity, however many rows it has."""
    return matches.select("entity_id", "source_name").distinct()


def source_pairs(matches: DataFrame) -> DataFrame:
    """Per ordered pair of sources: entities of the first that the second has, and has not.

    Each entity first becomes one row with the set of its sources, which is no longer than the list of
    sources; pairs are then read off that set.
    """
    sets = entity_sources(matches).groupBy("entity_id").agg(F.collect_set("source_name").alias("_set"))
    names = matches.select("source_name").distinct().agg(F.collect_set("source_name")).scalar()
    rows = sets.withColumn("_all", names).withColumn("source", F.explode("_set")).withColumn("other", F.explode("_all"))
    rows = rows.where("source <> other")
    both = F.array_contains(F.col("_set"), F.col("other")).cast("int")
    return rows.groupBy("source", "other").agg(F.sum(both).alias("matched"), F.sum(1 - both).alias("unmatched"))


def single_source_entities(matches: DataFrame) -> DataFrame:
    """Match rows that found no partner at all."""
    return group_size_filter(matches, ["entity_id"], "single")


def unmatched_breakdown(matches: DataFrame, details: DataFrame, category: str) -> DataFrame:
    """Categories of the records without a partner, per source."""
    alone = single_source_entities(matches).select("source_id", "source_name", "field_id")
    rows = details.select("source_id", "field_id", category).join(alone, ["source_id", "field_id"])
    return rows.groupBy("source_name", category).agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column)


def richness_by_source(sources: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null cells over ``columns`` per source, in one pass."""
    total = sum((F.count(F.col(c)) for c in columns[1:]), F.count(F.col(columns[0])))
    return sources.groupBy("source_id").agg(total.alias("n_cells"))


def richness_by_version(versions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null cells over ``columns`` of the golden records of each version."""
    total = sum((F.count(F.col(c)) for c in columns[1:]), F.count(F.col(columns[0])))
    return versions.groupBy("version").agg(total.alias("n_cells"))
