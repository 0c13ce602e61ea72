"""Flares that share positions and fields that share outlines: work and storage follow the distinct ones."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import shapes as S
from fieldweave.operators.spatial_join import point_shape_join, point_shape_pairs
from fieldweave.plans import flares
from fieldweave.session import scratch_path

N_POINTS, N_FIELDS = 3000, 400


def crowd(spark):
    """3,000 points at three positions (one null), 400 fields with two outlines."""
    k = F.col("id") % 3
    points = spark.range(N_POINTS).select("id", F.when(k < 2, k * 5.0 + 0.5).alias("lon"), F.lit(0.5).alias("lat"))
    half = F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.48)
    fields = spark.range(N_FIELDS).select(F.col("id").alias("field_id"), (F.col("id") + 1.0).alias("oil_prod"), S.rectangle(F.lit(0.5), F.lit(0.5), half).alias("shape"))
    return points, fields


def stored_rows(spark, run):
    """Rows of all tables that ``run`` stores."""
    root = os.path.dirname(scratch_path(spark, "x"))
    before = set(glob.glob(f"{root}/*"))
    run()
    return sum(spark.read.parquet(p).count() for p in set(glob.glob(f"{root}/*")) - before if glob.glob(f"{p}/*.parquet"))


def test_shared_places_and_outlines_join_as_single_ones(spark):
    points, fields = crowd(spark)
    inner = point_shape_join(points, fields, "id").select("id", "field_id")
    here = [i for i in range(N_POINTS) if i % 3 == 0]
    assert inner.count() == len(here) * N_FIELDS == inner.distinct().count()
    left = point_shape_join(points, fields, "id", "left", distance=0.01, rows_per_split=50)
    assert left.count() == len(here) * N_FIELDS + N_POINTS - len(here)
    assert {r["id"] for r in left.where("field_id is null").select("id").collect()} == set(range(N_POINTS)) - set(here)
    alone = point_shape_join(points, fields, "id", "left_anti")
    assert alone.columns == points.columns and {r["id"] for r in alone.collect()} == set(range(N_POINTS)) - set(here)
    with pytest.raises(ValueError):
        point_shape_join(points, fields, "id", "right")


def test_split_positions_lose_and_repeat_nothing(spark):
    points, fields = crowd(spark)
    pairs = point_shape_pairs(points, fields, "id", distance=0.01, rows_per_split=30).select("id", "field_id", "interior")
    assert pairs.count() == pairs.distinct().count() == 1000 * N_FIELDS and pairs.where("interior").count() == 1000 * N_FIELDS


def test_a_shared_position_is_not_stored_per_flare(spark):
    """Annual and monthly attribution store a row per position and field around it, not per flare and field."""
    points, fields = crowd(spark)
    fl = points.withColumn("bcm", F.lit(0.5))
    got = {}

    def annual():
        out, rates = flares.attribute_flares(fl, fields.withColumn("name", F.lit("f")))
        got["annual"] = {r["field_id"]: r["flare_bcm"] for r in out.collect()}
        got["rates"] = rates.collect()[0]

    def monthly():
        out = flares.attribute_flares_monthly(fl.withColumn("month", F.lit(3)), fields.withColumn("name", F.lit("f")))
        got["monthly"] = {r["field_id"]: r["flare_volume"] for r in out.where("month = 3").collect()}

    for run in (annual, monthly):
        assert stored_rows(spark, run) < 2 * N_POINTS + 4 * N_FIELDS
    total = N_FIELDS * (N_FIELDS + 1) / 2
    for name in ("annual", "monthly"):
        assert got[name] == {i: pytest.approx(500.0 * (i + 1) / total) for i in range(N_FIELDS)}
    assert got["rates"]["initial_rate"] == pytest.approx(1 / 3)


def test_a_left_join_does_not_store_pairs(spark):
    points, fields = crowd(spark)
    assert stored_rows(spark, lambda: point_shape_join(points, fields, "id", "left").count()) < N_POINTS + N_FIELDS
    narrow = point_shape_join(points.select("lon", "lat").distinct(), fields.groupBy("shape").agg(F.count(F.lit(1)).alias("n")), ["lon", "lat"])
    assert narrow.agg(F.sum("n")).first()[0] == N_FIELDS
