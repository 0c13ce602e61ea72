"""Queries of the projections, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.catalog.base import query, rounded
from fieldweave.functions import quantities as Q
from fieldweave.functions import recode as R
from fieldweave.functions import text as X
from fieldweave.operators import projection as P
from fieldweave.plans.flares import filter_country_year
from fieldweave.plans.matching import order_sources
from fieldweave.plans.model_inputs import filter_producing

_OPS = {
    "name": (["name"], X.normalize_name),
    "oil_prod": (["oil_prod"], Q.barrels_from_thousands),
    "wor": (["wells", "oil_prod"], Q.water_oil_ratio),
    "depth": (["no_such_column"], Q.feet_from_metres),
}
_TARGETS = ["name", "oil_prod", "wor", "depth", "api"]


@query(
    "PRJ1_map_schema",
    """SELECT source_id, field_id, lower(name) AS name, round(oil_prod * 1000, 4) AS oil_prod, round(wells / oil_prod, 9) AS wor,
      CAST(NULL AS DOUBLE) AS depth, CAST(NULL AS DOUBLE) AS api FROM fx_source""",
)
def _(fx):
    out = P.map_schema(fx.source, _OPS, _TARGETS, keep=["source_id", "field_id"])
    return out.select(
        "source_id", "field_id", "name", rounded("oil_prod", 4).alias("oil_prod"), rounded("wor", 9).alias("wor"),
        F.col("depth").cast("double").alias("depth"), F.col("api").cast("double").alias("api"),
    )


@query("PRJ2_reorder_front", "SELECT field_id, name, source_id, oil_prod, wells, kind FROM fx_source")
def _(fx):
    return P.reorder_front(fx.source.select("source_id", "oil_prod", "wells", "kind", "field_id", "name"), ["field_id", "name", "source_id"])


@query("PRJ3_add_source_identity", "SELECT p_partkey, 'part2024' AS source_id, 'part' AS source_name FROM part")
def _(fx):
    return P.add_source_identity(fx.table("part").select("p_partkey"), "part", "2024")


@query("PRJ4_row_counter_id", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS field_id FROM orders")
def _(fx):
    return P.row_counter_id(fx.table("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query(
    "PRJ5_rename_map",
    "SELECT id, lat AS latitude, lon AS longitude, round(t_mean, 6) AS avg_temp_k, round(bcm, 9) AS volume FROM fx_flare",
)
def _(fx):
    rows = fx.flare.withColumnsRenamed({"lat": "latitude", "lon": "longitude", "t_mean": "avg_temp_k", "bcm": "volume"})
    return rows.select("id", "latitude", "longitude", rounded("avg_temp_k").alias("avg_temp_k"), rounded("volume", 9).alias("volume"))


_V3 = """SELECT p_partkey, p_name AS name, p_size % 4 AS gas, p_size % 3 AS co2, p_size % 5 AS upg, p_size % 9 AS path, 1900 + p_size AS start_year,
  p_size % 2 AS m1, p_partkey % 2 AS m2, CAST(p_size % 3 = 0 AS INT) AS r1, CAST(p_size % 3 = 1 AS INT) AS r2, CAST(p_size % 7 = 2 AS INT) AS r3,
  CAST(p_size % 5 = 0 AS INT) AS i1, CAST(p_size % 5 = 1 AS INT) AS i2, CAST(p_size % 5 = 2 AS INT) AS i3 FROM part"""


@query(
    "PRJ6_target_recode",
    f"""SELECT p_partkey, name, CASE gas WHEN 1 THEN 'NG' WHEN 2 THEN 'N2' WHEN 3 THEN 'CO2' END AS flood_gas_type,
      CASE co2 WHEN 1 THEN 'Natural subsurface reservoir' WHEN 2 THEN 'Anthropogenic' END AS co2_source,
      CASE upg WHEN 0 THEN 'None' WHEN 1 THEN 'Delayed coking' WHEN 2 THEN 'Hydroconversion' WHEN 3 THEN 'Combined' END AS upgrader_type,
      CASE path WHEN 1 THEN 'None' WHEN 2 THEN 'Minimal' WHEN 3 THEN 'Acid Gas' WHEN 4 THEN 'Wet Gas' WHEN 5 THEN 'Acid Wet Gas'
        WHEN 6 THEN 'Sour Gas Reinjection' WHEN 7 THEN 'CO2-EOR Membrane' WHEN 8 THEN 'CO2-EOR Ryan Holmes' END AS gas_processing_path,
      CAST(2024 - start_year AS BIGINT) AS age,
      CASE WHEN m1 = 1 AND m2 = 1 THEN 'Integrated with both' WHEN m1 = 1 THEN 'Integrated with upgrader'
        WHEN m2 = 1 THEN 'Integrated with diluent' ELSE 'None' END AS oil_sands_mine_type,
      CASE WHEN r1 = 1 THEN 'Low carbon' WHEN r2 = 1 THEN 'Med carbon' WHEN r3 = 1 THEN 'High carbon' END AS ecosystem_richness,
      CASE WHEN i1 = 1 THEN 'Low' WHEN i2 = 1 THEN 'Med' WHEN i3 = 1 THEN 'High' END AS field_development_intensity FROM ({_V3})""",
)
def _(fx):
    old = {
        "name": "Field name", "gas": R.FLOOD_GAS, "co2": R.CO2_SOURCE, "upg": R.UPGRADER, "path": R.GAS_PATH, "start_year": R.START_YEAR,
        **dict(zip(("m1", "m2"), R.MINE_FLAGS)), **dict(zip(("r1", "r2", "r3"), R.RICHNESS_FLAGS)), **dict(zip(("i1", "i2", "i3"), R.INTENSITY_FLAGS)),
    }
    rows = fx.spark.sql(_V3.replace("FROM part", "FROM {part}"), part=fx.table("part")).withColumnsRenamed(old)
    return P.recode_targets(rows, 2024, keep=["p_partkey"]).withColumn("age", F.col("age").cast("bigint"))


@query("FLT1_filter_country_year", "SELECT id, month, round(bcm, 9) AS bcm FROM fx_flare WHERE country = 'ASIA' AND year = 1998")
def _(fx):
    rows = filter_country_year(fx.flare, "ASIA", 1998)
    return rows.select("id", F.col("month").cast("bigint").alias("month"), rounded("bcm", 9).alias("bcm"))


@query("FLT2_filter_producing", "SELECT field_id, name, oil_prod FROM fx_field WHERE function_unit = 'oil' AND oil_prod > 0")
def _(fx):
    return filter_producing(fx.field.withColumnRenamed("function_unit", "functional_unit")).select("field_id", "name", "oil_prod")


@query(
    "FLT3_filter_isin_recode",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'oil' ELSE 'gas' END AS unit FROM orders WHERE o_orderstatus IN ('O', 'F')",
)
def _(fx):
    rows = fx.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("unit"))
    return P.filter_recode(rows, "unit", {"O": "oil", "F": "gas"})


@query(
    "FLT4_filter_regex_period",
    """SELECT field_id, p AS period, round(oil, 2) AS oil FROM (SELECT *, CASE WHEN field_id % 4 = 0 THEN 'Total' ELSE period END AS p FROM fx_movement)
    WHERE regexp_matches(p, '^[0-9]{4}-[0-9]{2}$')""",
)
def _(fx):
    period = F.when(F.col("field_id") % 4 == 0, "Total").otherwise(F.col("period"))
    rows = fx.movement.withColumn("period", period).where(F.col("period").rlike(r"^\d{4}-\d{2}$"))
    return rows.select("field_id", "period", rounded("oil", 2).alias("oil"))


@query("FLT5_drop_empty_geometry", "SELECT field_id, name FROM fx_field WHERE field_id % 6 <> 0")
def _(fx):
    rows = fx.field_shape.withColumn("shape", F.when(F.col("field_id") % 6 != 0, F.col("shape")))
    return rows.where(F.col("shape").isNotNull()).select("field_id", "name")


@query("FLT6_drop_null_name", "SELECT source_id, field_id, name FROM fx_source WHERE name IS NOT NULL")
def _(fx):
    return fx.source.where(F.col("name").isNotNull()).select("source_id", "field_id", "name")


@query(
    "FLT7_null_out_of_range",
    """SELECT source_id, field_id, CASE WHEN wells - 10 < 1 THEN NULL ELSE wells - 10 END AS wells,
      CASE WHEN oil_prod / 20 < 3 OR oil_prod / 20 > 88 THEN NULL ELSE round(oil_prod / 20, 6) END AS api FROM fx_source""",
)
def _(fx):
    return fx.source.select(
        "source_id", "field_id",
        P.null_outside(F.col("wells") - 10, low=1).alias("wells"),
        rounded(P.null_outside(F.col("oil_prod") / 20, 3, 88)).alias("api"),
    )


@query(
    "FLT8_cap_by_column",
    """SELECT l_orderkey, l_linenumber, CASE WHEN f > g THEN g ELSE f END AS for_value
    FROM (SELECT *, l_quantity AS f, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax * 400 END AS g FROM lineitem)""",
)
def _(fx):
    limit = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") * 400)
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", Q.cap_by(F.col("l_quantity"), limit).alias("for_value"))


@query(
    "FLT9_validate_range",
    """SELECT l_orderkey, l_linenumber, concat_ws(', ', CASE WHEN l_quantity NOT BETWEEN 0 AND 45 THEN 'l_quantity' END,
      CASE WHEN l_tax NOT BETWEEN 0 AND 0.06e0 THEN 'l_tax' END) AS violations FROM lineitem
    WHERE l_quantity NOT BETWEEN 0 AND 45 OR l_tax NOT BETWEEN 0 AND 0.06e0""",
)
def _(fx):
    rules = {"l_quantity": (0, 45), "l_tax": (0, 0.06)}
    bad = P.range_rejects(fx.table("lineitem"), rules)
    return bad.select("l_orderkey", "l_linenumber", F.array_join("violations", ", ").alias("violations"))


@query(
    "FLT9_range_violations",
    """SELECT count(*) FILTER (l_quantity NOT BETWEEN 0 AND 45) AS l_quantity, count(*) FILTER (l_tax NOT BETWEEN 0 AND 0.06e0) AS l_tax FROM lineitem""",
)
def _(fx):
    return P.range_violations(fx.table("lineitem"), {"l_quantity": (0, 45), "l_tax": (0, 0.06)})


@query("FLT10_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100")
def _(fx):
    return P.page(fx.table("orders").select("o_orderkey", "o_custkey"), 100, 10, "o_orderkey")


@query(
    "FLT11_page_with_total",
    "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 20",
)
def _(fx):
    return P.page_with_total(fx.table("customer").select("c_custkey", "c_name"), 20, 100, "c_custkey")


@query(
    "SRT1_order_sources",
    """SELECT source_id, data_score, row_number() OVER (ORDER BY data_score DESC) - 1 AS rank FROM (SELECT DISTINCT source_id, data_score FROM fx_source)""",
)
def _(fx):
    metadata = fx.source.select("source_id", "data_score").distinct()
    ranks = F.array(*[F.lit(s) for s in order_sources(metadata)])
    return metadata.withColumn("rank", (F.array_position(ranks, F.col("source_id")) - 1).cast("bigint"))


@query("SRT2_top_k", "SELECT field_id, name, oil_prod FROM fx_field ORDER BY coalesce(oil_prod, 0) DESC, field_id LIMIT 20")
def _(fx):
    rows = fx.field.select("field_id", "name", "oil_prod")
    return rows.orderBy(F.desc(F.coalesce("oil_prod", F.lit(0.0))), "field_id").limit(20)


@query(
    "SRT3_sort_total",
    "SELECT country, round(sum(oil_prod), 2) AS total_production FROM fx_field GROUP BY country ORDER BY total_production DESC, country",
)
def _(fx):
    totals = fx.field.groupBy("country").agg(rounded(F.sum("oil_prod"), 2).alias("total_production"))
    return totals.orderBy(F.desc("total_production"), "country")


@query(
    "SET1_union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS kind FROM customer
    UNION ALL SELECT p_partkey, p_name, NULL, p_type FROM part""",
)
def _(fx):
    c = fx.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    p = fx.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return c.unionByName(p, allowMissingColumns=True)


@query(
    "SET2_append_matches",
    """SELECT field_id, source_id, name FROM fx_source WHERE source_id <> 'c2021' UNION ALL SELECT field_id, source_id, name FROM fx_source WHERE source_id = 'c2021'""",
)
def _(fx):
    rows = fx.source.select("field_id", "source_id", "name")
    return rows.where("source_id <> 'c2021'").unionByName(rows.where("source_id = 'c2021'"))


@query("SET3_union_ids", "SELECT field_id FROM fx_source WHERE source_id = 'a2024' UNION SELECT field_id FROM fx_source WHERE source_id = 'b2022'")
def _(fx):
    ids = fx.source.select("source_id", "field_id")
    return ids.where("source_id = 'a2024'").select("field_id").union(ids.where("source_id = 'b2022'").select("field_id")).distinct()


_A, _B = "SELECT field_id FROM fx_source WHERE source_id = 'a2024'", "SELECT field_id FROM fx_source WHERE source_id = 'b2022'"


@query("SET4_except_ids", f"{_A} EXCEPT {_B}")
def _(fx):
    ids = fx.source.select("source_id", "field_id")
    return ids.where("source_id = 'a2024'").select("field_id").subtract(ids.where("source_id = 'b2022'").select("field_id"))


@query("SET4_intersect_ids", f"{_A} INTERSECT {_B}")
def _(fx):
    ids = fx.source.select("source_id", "field_id")
    return ids.where("source_id = 'a2024'").select("field_id").intersect(ids.where("source_id = 'b2022'").select("field_id"))


