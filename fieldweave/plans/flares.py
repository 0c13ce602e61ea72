"""Satellite flare volumes attributed to fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.quantities import SCF_PER_BCM
from fieldweave.functions.text import month_number
from fieldweave.operators.skew import with_group_totals
from fieldweave.operators.spatial_join import point_shape_pairs
from fieldweave.session import freeze

DAYS = 365


def filter_country_year(flares: DataFrame, country: str, year: int) -> DataFrame:
    return flares.where((F.col("country") == country) & (F.col("year") == year))


def flare_rollup(flares: DataFrame, seq: str = "month", keys: Sequence[str] = ("id",)) -> DataFrame:
    """One row per flare, or per flare and year: first position, mean temperature, total volume."""
    return flares.groupBy(*keys).agg(
        F.min_by("lon", F.col(seq)).alias("lon"),
        F.min_by("lat", F.col(seq)).alias("lat"),
        F.avg("t_mean").alias("avg_temp"),
        F.sum("bcm").alias("bcm"),
    )


def share_of_group(rows: DataFrame, keys: list[str], value: str, row_ids: list[str], out: str = "weight") -> DataFrame:
    """Share of ``value`` within groups of several rows, 1 in groups of one; null where the total is 0.

    ``row_ids`` tell the rows of a group apart.
    """
    totals = [F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_total")]
    rows = with_group_totals(rows, keys, totals, row_ids)
    weight = F.when(F.col("_n") > 1, F.try_divide(F.col(value), F.col("_total"))).otherwise(F.lit(1.0))
    return rows.withColumn(out, weight).drop("_n", "_total")


def renormalize(rows: DataFrame, keys: list[str], row_ids: list[str], weight: str = "weight") -> DataFrame:
    rows = with_group_totals(rows, keys, [F.sum(weight).alias("_total")], row_ids)
    return rows.withColumn(weight, F.try_divide(F.col(weight), F.col("_total"))).drop("_total")


def located(flares: DataFrame, fields: DataFrame, buffer_deg: float) -> DataFrame:
    """``lon, lat, field_id, oil_prod, interior``: fields around each distinct position, the buffer only for positions
    inside none.

    Whatever depends on the position alone is worked out here once, however many flares share it; one join finds the
    fields that hold a position and those near it. ``flares`` should be stored, it is read more than once.
    """
    places = freeze(flares.select("lon", "lat").where("lon is not null and lat is not null").distinct(), "places")
    targets = fields.select("field_id", "oil_prod", "shape").where("shape is not null")
    keep = ["lon", "lat", "field_id", "oil_prod", "interior"]
    around = point_shape_pairs(places, targets, ["lon", "lat"], distance=buffer_deg).select(*keep)
    around = freeze(around, "around")
    inside = around.where("interior")
    near = around.where("NOT interior").join(inside.select("lon", "lat").distinct(), ["lon", "lat"], "left_anti")
    return inside.unionByName(near)


def production_or_one(oil: Column) -> Column:
    return F.when(oil > 0, oil).otherwise(F.lit(1.0))


def attribute_flares(
    flares: DataFrame, fields: DataFrame, buffer_deg: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """Flaring-to-oil ratio per field, and the match rates.

    ``flares``: ``id, lon, lat, bcm`` (one row per id); ``fields``: ``field_id, oil_prod, shape`` and
    optionally ``for_value``, which fields without flares keep. Overlaps are shared by production.
    """
    flares = freeze(flares.select("id", "lon", "lat", "bcm"), "flares")
    pairs = located(flares, fields, buffer_deg)
    at_place = flares.where("id is not null").groupBy("lon", "lat").agg(F.sum("bcm").alias("bcm"))
    weighted = share_of_group(pairs, ["lon", "lat"], "oil_prod", ["field_id"]).join(at_place, ["lon", "lat"])
    volumes = weighted.groupBy("field_id").agg(F.coalesce(F.sum(F.col("bcm") * F.col("weight")), F.lit(0.0)).alias("flare_bcm"))
    old = F.col("for_value") if "for_value" in fields.columns else F.lit(None).cast("double")
    ratio = F.col("flare_bcm") * F.lit(SCF_PER_BCM) / (production_or_one(F.col("oil_prod")) * F.lit(DAYS))
    out = fields.withColumn("for_value", old).join(volumes, "field_id", "left")
    out = out.withColumn("for_value", F.coalesce(ratio, F.col("for_value")))

    inside = pairs.where("interior").select("lon", "lat").distinct()
    initial = at_place.join(inside, ["lon", "lat"], "left_semi").agg(F.sum("bcm")).scalar()
    back = F.sum(production_or_one(F.col("oil_prod")) * F.col("for_value")) * F.lit(DAYS) / F.lit(SCF_PER_BCM)
    final = out.agg(back).scalar()
    total = flares.agg(F.sum("bcm").alias("total"))
    rate = lambda volume: F.when(F.col("total") != 0, F.coalesce(volume, F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0))
    rates = total.select(rate(initial).alias("initial_rate"), rate(final).alias("final_rate"))
    rates = rates.withColumn("unmatched_rate", F.lit(1.0) - F.col("final_rate"))
    return out, rates


def months_of(fields: DataFrame) -> DataFrame:
    """Every field for the months 1..12."""
    return fields.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def _monthly(flares: DataFrame, fields: DataFrame, buffer_deg: float) -> tuple[DataFrame, DataFrame]:
    """The flares of each month with their position and volume, and the weights of the fields around each position, which
    add up to one.

    A flare counts where it was in the month. A flare that was inside a field in any month is not looked for around fields
    in the others, so such rows are left out.
    """
    monthly = flares.groupBy("id", month_number(F.col("month")).alias("month"), "lon", "lat").agg(F.sum("bcm").alias("bcm"))
    monthly = freeze(monthly, "flares")
    pairs = located(monthly, fields, buffer_deg)
    place = ["lon", "lat"]
    weights = renormalize(share_of_group(pairs, place, "oil_prod", ["field_id"]), place, ["field_id"])
    # a position has interior fields or near ones, never both
    kinds = pairs.select(*place, "interior").distinct()
    rows = monthly.join(kinds, place)
    ever = rows.where("interior").select("id").distinct()
    rows = rows.where("interior").unionByName(rows.where("not interior").join(ever, "id", "left_anti"))
    rows = rows.where("id is not null and month is not null").select("id", "month", *place, "bcm")
    return rows, weights.select(*place, "field_id", "oil_prod", "interior", "weight")


def monthly_weights(flares: DataFrame, fields: DataFrame, buffer_deg: float = 0.05) -> DataFrame:
    """``id, month, field_id, bcm, weight`` with weights adding up to one per flare and month.

    A flare counts where it was in the month; each distinct position is joined to shapes, and its weights worked out, once.
    """
    rows, weights = _monthly(flares, fields, buffer_deg)
    return rows.join(weights, ["lon", "lat"]).select(*rows.columns, "field_id", "oil_prod", "interior", "weight")


def attribute_flares_monthly(flares: DataFrame, fields: DataFrame, buffer_deg: float = 0.05) -> DataFrame:
    """Flare volume per field and month, zero where there is none.

    Volumes are summed per position and month before they meet the fields around the position.
    """
    rows, weights = _monthly(flares, fields, buffer_deg)
    at_place = rows.groupBy("lon", "lat", "month").agg(F.sum("bcm").alias("bcm"))
    shared = at_place.join(weights, ["lon", "lat"])
    volumes = shared.groupBy("field_id", "month").agg(F.sum(F.col("bcm") * F.col("weight")).alias("_volume"))
    grid = months_of(fields.select("field_id", "name"))
    return grid.join(volumes, ["field_id", "month"], "left").select(
        "field_id", "name", "month", F.coalesce("_volume", F.lit(0.0)).alias("flare_volume")
    )
