"""Queries of readers and writers: data of the test tables goes out and comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.catalog.base import num, query, rounded, sql_cells
from fieldweave.catalog.cell import EDGE, _COVER, _H
from fieldweave.functions import shapes as S
from fieldweave.functions.cells import cell_of_point
from fieldweave.operators import cover as V
from fieldweave.operators.access import append_new
from fieldweave.session import scratch_path
from fieldweave.sources import files as IO

_FIELD_SCHEMA = "field_id bigint, name string, country string, oil_prod double, gor double"
_FIELD_SQL = "SELECT field_id, name, country, oil_prod, gor FROM fx_field"


def _fields(fx):
    return fx.field.select("field_id", "name", "country", "oil_prod", "gor")


@query("SRC1_scan_csv", _FIELD_SQL)
def _(fx):
    path = scratch_path(fx.spark, "csv")
    IO.write_csv(_fields(fx), path)
    return IO.scan_csv(fx.spark, path, _FIELD_SCHEMA)


@query("SRC2_scan_csv_config", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def _(fx):
    """Files with two title lines above the header."""
    path = scratch_path(fx.spark, "csv-config")
    rows = fx.table("customer").select(F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("line"), (F.col("c_custkey") % 8).alias("part"))
    head = F.array(F.lit("title"), F.lit("made by"), F.lit("c_custkey;c_name;c_mktsegment"))
    titles = rows.select("part").distinct().select("part", F.posexplode(head).alias("no", "line"))
    body = rows.select("part", F.lit(9).alias("no"), "line")
    both = titles.unionByName(body).repartition("part").sortWithinPartitions("part", "no")
    both.select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)
    out = IO.scan_csv_config(fx.spark, path + "/part=*", ["c_custkey", "c_name", "c_mktsegment"], ";", "utf-8", 2)
    return out.select("c_custkey", "c_name", "c_mktsegment")


@query("SRC3_scan_projected", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(fx):
    return IO.scan_projected(fx.spark, f"{fx.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query(
    "SRC4_scan_geojson",
    "SELECT CAST(field_id AS VARCHAR) AS field_id, name, 5 AS n_vertices, round(lon - half, 6) AS x0, round(lat + half, 6) AS y1 FROM fx_field",
)
def _(fx):
    path = scratch_path(fx.spark, "geojson")
    IO.write_lines(IO.shape_features(fx.field_shape, "shape", ["field_id", "name"]), path)
    box = S.bounds(F.col("shape"))
    rows = IO.scan_geojson(fx.spark, path, ["field_id", "name"], layout="lines")
    return rows.select(
        "field_id", "name", F.size(S.vertices(F.col("shape"))).alias("n_vertices"), rounded(box["xmin"]).alias("x0"), rounded(box["ymax"]).alias("y1")
    )


@query(
    "SRC5_scan_transposed",
    """SELECT 'f' || n_nationkey AS field_id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region,
      CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS VARCHAR) AS n_customers FROM nation""",
)
def _(fx):
    """A sheet with a column per nation; how many there are is fixed by the nation table."""
    counts = fx.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("string").alias("n_customers"))
    nations = fx.table("nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    wide = nations.select(
        F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("col"), F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("string").alias("region"), F.coalesce("n_customers", F.lit("0")).alias("n_customers"),
    )
    sheet = wide.unpivot(["col"], ["name", "region", "n_customers"], "attribute", "v").groupBy("attribute").pivot("col", [f"f{i}" for i in range(25)]).agg(F.max("v"))
    return IO.scan_transposed(sheet, "attribute", ["name", "region", "n_customers"])


@query(
    "SRC5_scan_result_rows",
    """SELECT CAST(n_nationkey + 1 AS INTEGER) AS position, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region,
      CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS VARCHAR) AS n_suppliers FROM nation""",
)
def _(fx):
    """A result sheet with a column per nation whose rows are known by their numbers only."""
    counts = fx.table("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("string").alias("193"))
    nations = fx.table("nation").join(counts, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    wide = nations.select(
        F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("col"), F.col("n_name").alias("21"),
        F.col("n_regionkey").cast("string").alias("24"), F.coalesce("193", F.lit("0")).alias("193"),
    )
    long = wide.unpivot(["col"], ["21", "24", "193"], "row", "v").withColumn("row", F.col("row").cast("int"))
    sheet = long.groupBy("row").pivot("col", [f"f{i}" for i in range(25)]).agg(F.max("v"))
    return IO.scan_result_rows(sheet, {21: "name", 24: "region", 193: "n_suppliers"}, out_id="position")


@query("SNK1_write_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(fx):
    path = scratch_path(fx.spark, "flat")
    IO.write_csv(fx.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return IO.scan_csv(fx.spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query(
    "SNK2_write_geojson_cells",
    f"""WITH {_COVER} SELECT CAST(field_id AS DOUBLE) AS id, count(*) AS n_cells, round(max(r * {_H} + {num(EDGE)}), 6) AS y_max FROM cov GROUP BY field_id""",
)
def _(fx):
    path = scratch_path(fx.spark, "cells")
    cells = V.cover(fx.field_shape, "field_id", "shape", EDGE).withColumnRenamed("field_id", "id")
    IO.write_lines(IO.cell_features(cells, "cell", ["id"], EDGE), path)
    back = IO.scan_geojson(fx.spark, path, ["id"], layout="lines")
    top = S.bounds(F.col("shape"))["ymax"]
    return back.groupBy(F.col("id").cast("double").alias("id")).agg(F.count(F.lit(1)).alias("n_cells"), rounded(F.max(top)).alias("y_max"))


@query("SNK3_write_geojson_points", "SELECT DISTINCT CAST(id AS VARCHAR) AS id, lon AS x, lat AS y FROM fx_flare")
def _(fx):
    path = scratch_path(fx.spark, "points")
    IO.write_lines(IO.point_features(fx.flare.select("id", "lon", "lat").distinct(), "lon", "lat", ["id"]), path)
    back = IO.scan_geojson(fx.spark, path, ["id"], layout="lines")
    v = F.get(S.vertices(F.col("shape")), F.lit(0))
    return back.select("id", v["x"].alias("x"), v["y"].alias("y"))


@query("SNK4_write_keyed", f"WITH {sql_cells('c', 'fx_source', edge=0.2)} SELECT DISTINCT field_id AS id, q, r FROM c")
def _(fx):
    path = scratch_path(fx.spark, "keyed")
    cells = fx.source.select(F.col("field_id").alias("id"), cell_of_point(F.col("lon"), F.col("lat"), 0.2).alias("cell")).select("id", "cell.q", "cell.r")
    IO.write_keyed(cells, path, ["id", "q", "r"])
    return fx.spark.read.schema(cells.schema).parquet(path)


@query(
    "SNK5_append_ignore_existing",
    """SELECT c_custkey, c_name, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, c_name, 'new' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0""",
)
def _(fx):
    path = scratch_path(fx.spark, "target")
    rows = fx.table("customer").select("c_custkey", "c_name")
    rows.where("c_custkey % 2 = 0").withColumn("origin", F.lit("old")).write.parquet(path)
    incoming = rows.where("c_custkey % 3 = 0").withColumn("origin", F.lit("new"))
    IO.append_ignore_existing(fx.spark, path, incoming, ["c_custkey"])
    return fx.spark.read.schema(incoming.schema).parquet(path)


@query(
    "SNK5_append_new_rows",
    "SELECT o_custkey AS c_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0",
)
def _(fx):
    target = fx.table("customer").where("c_custkey % 2 = 0").select("c_custkey")
    return append_new(target, fx.table("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    "SNK6_quality_gate_split",
    """SELECT source_id, data_score >= 4.4e0 AS merged, count(*) AS n FROM fx_source GROUP BY 1, 2""",
)
def _(fx):
    path = scratch_path(fx.spark, "aside")
    good, aside = IO.quality_gate_split(fx.source, "data_score", 4.4)
    aside.select("value").write.text(path)
    kept = fx.spark.read.text(path).select(F.get_json_object("value", "$.source_id").alias("source_id"))
    rows = good.select("source_id", F.lit(True).alias("merged")).unionByName(kept.withColumn("merged", F.lit(False)))
    return rows.groupBy("source_id", "merged").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SNK7_write_geojson_shapes",
    "SELECT country, count(*) AS n_shapes, round(min(lon - half), 6) AS x0 FROM fx_field GROUP BY country",
)
def _(fx):
    path = scratch_path(fx.spark, "shapes")
    IO.write_lines(IO.shape_features(fx.field_shape, "shape", ["country"]), path)
    back = IO.scan_geojson(fx.spark, path, ["country"], layout="lines")
    return back.groupBy("country").agg(F.count(F.lit(1)).alias("n_shapes"), rounded(F.min(S.bounds(F.col("shape"))["xmin"])).alias("x0"))


