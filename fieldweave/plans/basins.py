"""Basin averages and the carbon-intensity supply curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.quantities import basin_class, gor_class
from fieldweave.functions.text import rename_suffix, strip_suffix
from fieldweave.operators.aggregates import group_modes, weighted_average
from fieldweave.operators.cover import dissolve_parts
from fieldweave.operators.numbering import running_sum
from fieldweave.operators.spatial_join import shape_union_join
from fieldweave.session import freeze

SHORES = ("_Mar", "_Terra")
SHORE_NAMES = {"_Mar": "_Offshore", "_Terra": "_Onshore"}


def named_basins(basins: DataFrame, suffix_mode: str) -> DataFrame:
    """Parts of the basin shapes by plain name (``strip``: both halves together) or by renamed half (``rename``)."""
    if suffix_mode == "strip":
        name = strip_suffix(F.col("name"), SHORES)
    elif suffix_mode == "rename":
        name = rename_suffix(F.col("name"), SHORE_NAMES)
    else:
        raise ValueError("suffix_mode is 'strip' or 'rename'")
    return dissolve_parts(basins.select(name.alias("basin_name"), "outer_shape"), "basin_name", "outer_shape")


def fields_in_basins(results: DataFrame, fields: DataFrame, basins: DataFrame, flares: DataFrame, suffix_mode: str, bucket_deg: float = 1.0) -> DataFrame:
    """Model results with their field's attributes, basin and flaring ratio.

    A field belongs to a basin if the union of the basin's parts contains it, wherever the parts meet.
    ``results``: ``name, production, ci``; ``fields``: ``entity_id, name, gor, offshore, shape``;
    ``flares``: ``entity_id, for_value``.
    """
    merged = results.join(fields.select("entity_id", "name", "gor", "offshore"), "name", "left")
    placed = shape_union_join(fields, named_basins(basins, suffix_mode), "entity_id", "basin_name", bucket_deg=bucket_deg)
    return merged.join(placed, "entity_id", "left").join(flares.select("entity_id", "for_value"), "entity_id", "left")


def basin_averages(placed: DataFrame) -> DataFrame:
    """Per basin: production-weighted intensity, mean flaring ratio, production, majority shore flag."""
    known = placed.where(F.col("basin_name").isNotNull())
    stats = known.groupBy("basin_name").agg(
        weighted_average(F.col("ci"), F.col("production")).alias("weighted_ci"),
        F.coalesce(F.avg("for_value"), F.lit(0.0)).alias("average_for"),
        F.sum("production").alias("total_production"),
    )
    shore = group_modes(known, ["basin_name"], ["offshore"]).withColumnRenamed("offshore", "offshore_status")
    return stats.join(shore, "basin_name", "left")


def basin_report(results: DataFrame, fields: DataFrame, basins: DataFrame, flares: DataFrame, suffix_mode: str = "strip", bucket_deg: float = 1.0) -> DataFrame:
    return basin_averages(freeze(fields_in_basins(results, fields, basins, flares, suffix_mode, bucket_deg), "placed"))


def impact_curve(rows: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Fields in order of intensity: impact, gas class, basin class, share of production and its running start.

    ``rows``: ``id, production, ci, gor, basin_name``.
    """
    total = rows.agg(F.sum("production")).scalar()
    shaped = rows.withColumns(
        {
            "average_ci": rows.agg(weighted_average(F.col("ci"), F.col("production"))).scalar(),
            "impact": F.col("production") * F.col("ci"),
            "gor_class": gor_class(F.col("gor")),
            "basin_class": basin_class(F.col("basin_name")),
            "width": F.try_divide(F.col("production"), total),
        }
    )
    curve = running_sum(shaped, ["ci", id_col], "width", "_upto")
    return curve.withColumn("start_x", F.col("_upto") - F.col("width")).drop("_upto")


def top_impacts(curve: DataFrame, k: int = 3, id_col: str = "entity_id") -> DataFrame:
    return curve.orderBy(F.desc("impact"), id_col).limit(k)
