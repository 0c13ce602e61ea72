"""Queries of the scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.catalog.base import query, rounded, sql_cells, sql_decay, sql_ratio, sql_steps
from fieldweave.functions import cells as C
from fieldweave.functions import quantities as Q
from fieldweave.functions import shapes as S
from fieldweave.functions import similarity as N
from fieldweave.functions import text as X
from fieldweave.functions import units as U

# lineitem as a stand-in for monthly well measurements: quantities as volumes, some of them missing or zero
_MEASURES = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS gas,
       CASE WHEN l_linenumber % 4 = 0 THEN 0e0 WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_extendedprice END AS oil,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 100 END AS co2,
       CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_tax * 100 END AS n2
FROM lineitem
"""


def _measures(fx):
    return fx.spark.sql(_MEASURES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=fx.table("lineitem"))


@query(
    "SCL1_normalize_name",
    """SELECT doc_id, md5(replace(replace(replace(strip_accents(lower(text)), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')) AS name_md5
    FROM documents""",
)
def _(fx):
    return fx.table("documents").select("doc_id", F.md5(X.normalize_name(F.col("text"))).alias("name_md5"))


@query(
    "SCL2_unit_from_text",
    """SELECT p_partkey, CASE lower(word) WHEN 'oil' THEN 'oil' WHEN 'gas' THEN 'gas' END AS unit,
      CASE strip_accents(lower(palavra)) WHEN 'oleo' THEN 'oil' WHEN 'gas' THEN 'gas' END AS unit_pt
    FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Oil' WHEN 1 THEN 'GAS' ELSE p_type END AS word,
      CASE p_size % 3 WHEN 0 THEN 'ÓLEO' WHEN 1 THEN 'Gás' ELSE p_type END AS palavra FROM part)""",
)
def _(fx):
    k = F.col("p_size") % 3
    rows = fx.table("part").select(
        "p_partkey",
        F.when(k == 0, "Oil").when(k == 1, "GAS").otherwise(F.col("p_type")).alias("word"),
        F.when(k == 0, "ÓLEO").when(k == 1, "Gás").otherwise(F.col("p_type")).alias("palavra"),
    )
    return rows.select(
        "p_partkey",
        X.unit_from_text(F.col("word")).alias("unit"),
        X.unit_from_text(F.col("palavra"), X.UNIT_WORDS_PT).alias("unit_pt"),
    )


@query(
    "SCL3_offshore_flag",
    """SELECT p_partkey, CASE lower(w) WHEN 'onshore' THEN 0 WHEN 'offshore' THEN 1 END AS shore,
      CASE lower(v) WHEN 'earth' THEN 0 WHEN 'sea' THEN 1 END AS location
    FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Onshore' WHEN 1 THEN 'OFFSHORE' ELSE p_type END AS w,
      CASE p_size % 3 WHEN 0 THEN 'Earth' WHEN 1 THEN 'SEA' ELSE p_type END AS v FROM part)""",
)
def _(fx):
    k = F.col("p_size") % 3
    shore = F.when(k == 0, "Onshore").when(k == 1, "OFFSHORE").otherwise(F.col("p_type"))
    where = F.when(k == 0, "Earth").when(k == 1, "SEA").otherwise(F.col("p_type"))
    return fx.table("part").select(
        "p_partkey", X.offshore_flag(shore).alias("shore"), X.offshore_flag(where, X.LOCATION_WORDS).alias("location")
    )


@query(
    "SCL4_multi_hot_methods",
    """WITH w AS (SELECT p_partkey, ',' || lower(replace(concat_ws(',', a, b), ' ', '')) || ',' AS t FROM (
      SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Artificial lift' WHEN 1 THEN 'CO2 flooding, Water drive' WHEN 2 THEN p_type END AS a,
        CASE p_partkey % 4 WHEN 0 THEN 'Steam flooding' WHEN 1 THEN 'Nitrogen flooding' WHEN 2 THEN 'Water injection' END AS b FROM part))
    SELECT p_partkey, CAST(contains(t, ',artificiallift,') AS INTEGER) AS downhole_pump,
      CAST(contains(t, ',co2flooding,') OR contains(t, ',nitrogenflooding,') AS INTEGER) AS gas_flooding,
      CAST(contains(t, ',waterdrive,') AS INTEGER) AS water_flooding, CAST(contains(t, ',steamflooding,') AS INTEGER) AS steam_flooding,
      CAST(contains(t, ',waterinjection,') AS INTEGER) AS water_reinjection FROM w""",
)
def _(fx):
    a = F.when(F.col("p_size") % 4 == 0, "Artificial lift").when(F.col("p_size") % 4 == 1, "CO2 flooding, Water drive").when(F.col("p_size") % 4 == 2, F.col("p_type"))
    b = F.when(F.col("p_partkey") % 4 == 0, "Steam flooding").when(F.col("p_partkey") % 4 == 1, "Nitrogen flooding").when(F.col("p_partkey") % 4 == 2, "Water injection")
    flags = X.multi_hot_methods([a, b])
    return fx.table("part").select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query(
    "SCL5_positive_flag",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN co2 IS NULL THEN NULL WHEN co2 > 0 THEN 1 ELSE 0 END AS co2_flag,
      CASE WHEN co2 > 0 OR n2 > 0 THEN 1 WHEN co2 IS NULL AND n2 IS NULL THEN NULL ELSE 0 END AS gas_flag FROM ({_MEASURES})""",
)
def _(fx):
    co2, n2 = F.col("co2"), F.col("n2")
    return _measures(fx).select("l_orderkey", "l_linenumber", Q.positive_flag(co2).alias("co2_flag"), Q.positive_flag2(co2, n2).alias("gas_flag"))


@query(
    "SCL6_unit_factors",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * 3.28084e0, 6) AS feet, round(l_extendedprice * 1000, 2) AS barrels,
      round(l_quantity * 0.0001e0, 6) AS percent FROM lineitem""",
)
def _(fx):
    q = F.col("l_quantity")
    return fx.table("lineitem").select(
        "l_orderkey", "l_linenumber",
        rounded(Q.feet_from_metres(q)).alias("feet"),
        rounded(Q.barrels_from_thousands(F.col("l_extendedprice")), 2).alias("barrels"),
        rounded(Q.percent_from_ppm(q)).alias("percent"),
    )


@query("SCL7_ceil_count", "SELECT o_orderkey, CAST(ceil(o_totalprice / 1000) AS BIGINT) AS wells FROM orders")
def _(fx):
    return fx.table("orders").select("o_orderkey", Q.ceil_count(F.col("o_totalprice") / 1000).alias("wells"))


_RATIOS = {
    "gor": "gas * 6000 / nullif(oil, 0)",
    "wor": "gas / nullif(oil, 0)",
    "wir": "gas * 6.28981e0 / nullif(oil, 0)",
    "glir": "gas * 1000 * 35.31466657e0 / nullif(oil, 0)",
    "sor": "gas * 8.14e0 / nullif(oil, 0)",
    "pcw": "co2 / nullif(gas, 0)",
}


@query(
    "SCL8_ratios",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _RATIOS.items()) + f" FROM ({_MEASURES})",
)
def _(fx):
    gas, oil, co2 = F.col("gas"), F.col("oil"), F.col("co2")
    ratios = {
        "gor": Q.gas_oil_ratio(gas, oil),
        "wor": Q.water_oil_ratio(gas, oil),
        "wir": Q.water_injection_ratio(gas, oil),
        "glir": Q.gas_lift_ratio(gas, oil),
        "sor": Q.steam_oil_ratio(gas, oil),
        "pcw": Q.reinjected_water_fraction(co2, gas),
    }
    return _measures(fx).select("l_orderkey", "l_linenumber", *[rounded(c).alias(n) for n, c in ratios.items()])


@query(
    "SCL9_ratio_gfir",
    f"""SELECT l_orderkey, l_linenumber, round((coalesce(gas, 0) + coalesce(co2, 0) + coalesce(n2, 0)) * 1000 * 35.31466657e0 / nullif(oil, 0), 6) AS gfir
    FROM ({_MEASURES})""",
)
def _(fx):
    out = Q.gas_flood_ratio([F.col("gas"), F.col("co2"), F.col("n2")], F.col("oil"))
    return _measures(fx).select("l_orderkey", "l_linenumber", rounded(out).alias("gfir"))


@query(
    "SCL10_dominant_gas_code",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN m <= 0 THEN NULL WHEN g = m THEN 1 WHEN n = m THEN 2 ELSE 3 END AS code FROM (
      SELECT *, greatest(g, n, c) AS m FROM (SELECT l_orderkey, l_linenumber, coalesce(gas, 0e0) AS g, coalesce(n2, 0e0) AS n, coalesce(co2, 0e0) AS c
      FROM ({_MEASURES})))""",
)
def _(fx):
    return _measures(fx).select("l_orderkey", "l_linenumber", Q.dominant_gas_code(F.col("gas"), F.col("n2"), F.col("co2")).alias("code"))


@query(
    "SCL11_remaining_gas_fraction",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN t > 0 THEN l_quantity / t END, 6) AS fraction FROM (
      SELECT *, l_extendedprice * 0.1647e0 + l_quantity - l_discount * 1e5 - l_tax * 1e4 - l_quantity AS t FROM lineitem)""",
)
def _(fx):
    q = F.col("l_quantity")
    out = Q.remaining_gas_fraction(q, F.col("l_extendedprice"), q, F.col("l_discount") * 1e5, F.col("l_tax") * 1e4, q)
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", rounded(out).alias("fraction"))


@query(
    "SCL12_years",
    """SELECT o_orderkey, substr(strftime(o_orderdate, '%d-%m-%Y'), 7, 4) AS year_text, year(o_orderdate) AS start_year,
      2024 - year(o_orderdate) AS age FROM orders""",
)
def _(fx):
    day = F.date_format("o_orderdate", "dd-MM-yyyy")
    start = F.year("o_orderdate")
    return fx.table("orders").select(
        "o_orderkey", X.year_from_text(day).alias("year_text"), start.cast("bigint").alias("start_year"),
        Q.age_from_year(start, 2024).cast("bigint").alias("age"),
    )


@query(
    "SCL13_cast_typed",
    """SELECT event_id, TRY_CAST(raw AS DOUBLE) AS as_number, CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS BIGINT) AS as_integer,
      lower(flag) IN ('true', 'yes', 'y', '1') AS as_boolean, TRY_CAST(day AS DATE) AS as_date, ts AS as_datetime,
      (TRY_CAST(raw AS DOUBLE) IS NULL) AS rejected
    FROM (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS raw,
      CASE event_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '1' END AS flag,
      CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events)""",
)
def _(fx):
    k = F.col("event_id")
    rows = fx.table("events").select(
        "event_id",
        F.when(k % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("raw"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise("1").alias("flag"),
        F.when(k % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("moment"),
    )
    number = U.cast_typed(F.col("raw"), "number")
    return rows.select(
        "event_id",
        number.alias("as_number"),
        U.cast_typed(F.col("raw"), "integer").alias("as_integer"),
        U.cast_typed(F.col("flag"), "boolean").alias("as_boolean"),
        U.cast_typed(F.col("day"), "date").alias("as_date"),
        U.cast_typed(F.col("moment"), "datetime").cast("timestamp_ntz").alias("as_datetime"),
        U.cast_failed(F.col("raw"), number).alias("rejected"),
    )


@query(
    "SCL14_convert_units",
    """SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 0.158987294928e0
        WHEN 1 THEN l_quantity * 0.3048e0 WHEN 2 THEN (l_quantity + 459.67e0) * 5e0 / 9e0 - 273.15e0 END, 6) AS converted,
      l_linenumber % 4 <> 3 AS unit_ok, round(l_quantity / 0.3048e0, 6) AS depth_ft FROM lineitem""",
)
def _(fx):
    k = F.col("l_linenumber") % 4
    rows = fx.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(k == 0, "bbl").when(k == 1, "ft").when(k == 2, "degF").otherwise("psi").alias("from_unit"),
        F.when(k == 0, "m^3").when(k == 1, "m").when(k == 2, "degC").otherwise("m^3").alias("to_unit"),
    )
    done = U.convert_by_column(rows, "l_quantity", "from_unit", "to_unit")
    depth = U.convert(F.col("l_quantity"), "m", "ft")
    return done.select("l_orderkey", "l_linenumber", rounded("converted").alias("converted"), "unit_ok", rounded(depth).alias("depth_ft"))


@query(
    "SCL15_regex_strip_suffix",
    """SELECT p_partkey, regexp_replace(w, '(_Mar|_Terra)$', '') AS plain,
      regexp_replace(regexp_replace(w, '_Mar$', '_Offshore'), '_Terra$', '_Onshore') AS renamed
    FROM (SELECT p_partkey, p_brand || CASE p_size % 3 WHEN 0 THEN '_Mar' WHEN 1 THEN '_Terra' ELSE '' END AS w FROM part)""",
)
def _(fx):
    k = F.col("p_size") % 3
    w = F.concat("p_brand", F.when(k == 0, "_Mar").when(k == 1, "_Terra").otherwise(""))
    return fx.table("part").select(
        "p_partkey", X.strip_suffix(w, ("_Mar", "_Terra")).alias("plain"), X.rename_suffix(w, {"_Mar": "_Offshore", "_Terra": "_Onshore"}).alias("renamed")
    )


@query("SCL16_month_parse", "SELECT id, year, country, CAST(month AS INTEGER) AS month_no FROM fx_flare")
def _(fx):
    text = F.concat(F.lit("M"), F.col("month").cast("string"), F.lit("/x"))
    return fx.flare.select("id", F.col("year").cast("bigint").alias("year"), "country", X.month_number(text).alias("month_no"))


@query(
    "SCL17_bucketize",
    """SELECT field_id, CASE WHEN g <= 100 THEN 'red' WHEN g <= 500 THEN 'orange' WHEN g <= 1000 THEN 'yellow' WHEN g <= 5000 THEN 'lightgreen'
      WHEN g <= 10000 THEN 'seagreen' WHEN g > 10000 THEN 'darkgreen' ELSE '0' END AS gor_class,
      CASE WHEN country = 'NATION_1' THEN 'Santos' WHEN country = 'NATION_2' THEN 'Campos' ELSE 'Others' END AS basin_class
    FROM (SELECT *, CASE WHEN field_id % 9 = 0 THEN NULL ELSE gor * (field_id % 20) END AS g FROM fx_field)""",
)
def _(fx):
    g = F.when(F.col("field_id") % 9 == 0, F.lit(None)).otherwise(F.col("gor") * (F.col("field_id") % 20))
    basin = F.when(F.col("country") == "NATION_1", "Santos").when(F.col("country") == "NATION_2", "Campos").otherwise(F.col("country"))
    return fx.field.select("field_id", Q.gor_class(g).alias("gor_class"), Q.basin_class(basin).alias("basin_class"))


@query(
    "SCL18_coerce_numeric",
    """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0e0) AS amount FROM events""",
)
def _(fx):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return fx.table("events").select("event_id", X.coerce_number(raw, 0.0).alias("amount"))


@query("SCL19_content_md5", "SELECT md5(text) AS md5, count(*) AS n_copies, min(doc_id) AS first_id FROM documents GROUP BY md5(text)")
def _(fx):
    docs = fx.table("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    return docs.groupBy("md5").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id"))


@query(
    "SCL20_source_score",
    "SELECT p_partkey, round(0.5e0 * (p_size % 6) + 0.3e0 * (p_partkey % 6) + 0.2e0 * (p_size % 5), 6) AS score FROM part",
)
def _(fx):
    score = Q.source_score(F.col("p_size") % 6, F.col("p_partkey") % 6, F.col("p_size") % 5)
    return fx.table("part").select("p_partkey", rounded(score).alias("score"))


_PAIRS = f"""WITH {sql_cells("src", "fx_source")},
pairs AS (SELECT x.field_id, x.source_id, x.name AS name1, y.name AS name2, {sql_ratio("x.name", "y.name")} AS ratio0,
  {sql_steps("x", "y")} AS steps FROM src x JOIN src y ON x.field_id = y.field_id AND x.source_id < y.source_id)"""


def _source_pairs(fx):
    """The records that different sources hold under one id."""
    x = fx.source_cell.select("field_id", "source_id", F.col("name").alias("name1"), F.col("cell").alias("cell1"))
    y = fx.source_cell.select("field_id", F.col("source_id").alias("_other"), F.col("name").alias("name2"), F.col("cell").alias("cell2"))
    return x.join(y, "field_id").where("source_id < _other")


@query("SCL21_similarity_ratio", f"{_PAIRS} SELECT field_id, source_id, name1, name2, coalesce(ratio0, 0) AS ratio FROM pairs")
def _(fx):
    return _source_pairs(fx).select("field_id", "source_id", "name1", "name2", N.name_ratio(F.col("name1"), F.col("name2")).alias("ratio"))


@query("SCL21_similarity_blocks")
def _(fx):
    words = fx.table("part").select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand").alias("other"))
    return words.select("p_partkey", N.matching_blocks_ratio("p_name", "other").alias("ratio"))


@query("SCL22_geo_decay_score", f"{_PAIRS} SELECT field_id, source_id, name2, steps, round({sql_decay('steps')}, 6) AS geo FROM pairs")
def _(fx):
    steps = C.cell_distance(F.col("cell1"), F.col("cell2"))
    return _source_pairs(fx).select("field_id", "source_id", "name2", steps.alias("steps"), rounded(N.geo_decay_score(steps)).alias("geo"))


@query(
    "SCL23_match_score",
    f"{_PAIRS} SELECT field_id, source_id, name2, round(0.7e0 * coalesce(ratio0, 0) + 0.3e0 * ({sql_decay('steps')}), 6) AS score FROM pairs",
)
def _(fx):
    steps = C.cell_distance(F.col("cell1"), F.col("cell2"))
    score = N.match_score(N.name_ratio(F.col("name1"), F.col("name2")), N.geo_decay_score(steps))
    return _source_pairs(fx).select("field_id", "source_id", "name2", rounded(score).alias("score"))


@query(
    "SCL24_drop_z",
    """SELECT field_id, 5 AS n_vertices, round(lon - half, 6) AS x0, round(lat - half, 6) AS y0 FROM fx_field""",
)
def _(fx):
    lift = F.transform(F.col("shape"), lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), F.lit(9.0).alias("z")))))
    flat = fx.field_shape.select("field_id", S.drop_z(lift).alias("shape"))
    box = S.bounds(F.col("shape"))
    return flat.select("field_id", F.size(S.vertices(F.col("shape"))).alias("n_vertices"), rounded(box["xmin"]).alias("x0"), rounded(box["ymin"]).alias("y0"))


@query(
    "SCL26_file_kind",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'geojson' WHEN 2 THEN 'other' WHEN 3 THEN 'zip' END AS kind FROM part""",
)
def _(fx):
    k = F.col("p_size") % 5
    ext = F.when(k == 0, ".CSV").when(k == 1, ".GeoJSON").when(k == 2, ".dat").when(k == 3, ".tar.zip").otherwise("")
    return fx.table("part").select("p_partkey", X.file_kind(F.concat(F.replace("p_name", F.lit("."), F.lit("_")), ext)).alias("kind"))


