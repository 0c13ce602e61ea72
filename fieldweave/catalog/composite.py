"""Queries of the end-to-end steps and of the user-extensible registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.catalog.aggregate import AS_OF, RULES, SQL_FLARES, SQL_LOOKUP, _MODE, fields_with_old_ratio, flares_2000
from fieldweave.catalog.base import SQL_MATCHES, _sql_match_step, num, query, rounded, sql_cells, sql_ratio
from fieldweave.catalog.cell import EDGE, _BANDS
from fieldweave.fixtures import SOURCE_ORDER
from fieldweave.functions import quantities as Q
from fieldweave.operators import cover as V
from fieldweave.operators import merging as M
from fieldweave.operators.projection import map_schema
from fieldweave.plans import basins as B
from fieldweave.plans import coverage as K
from fieldweave.plans import estimate, flares, golden, ingest, matching, model_inputs, papers
from fieldweave.plans.standardize import OP_TABLES, SourceMeta, prepare_registry, standardize, standardize_all
from fieldweave.session import freeze, scratch_path

_RAW = """SELECT field_id, name AS "Field name", CASE WHEN kind LIKE '%E%' THEN 'Oil' ELSE 'Gas' END AS "Function u", wells - 5 AS "Water In 2",
  oil_prod / 7 AS "Gas In 2nd", CASE WHEN wells % 2 = 0 THEN 'Sea' ELSE 'Earth' END AS "Offshore", wells * 1.5e0 AS "no. Produc",
  wells * 100e0 AS "Field dept", oil_prod AS "Oil (bbl/d", wells * 2e0 AS "Natural Ga", lon, lat FROM fx_source WHERE source_id = 'a2024'"""


def _registry_rows(fx):
    return fx.source.where("source_id = 'a2024'").select(
        "field_id", "lon", "lat",
        F.col("name").alias("Field name"),
        F.when(F.col("kind").contains("E"), "Oil").otherwise("Gas").alias("Function u"),
        (F.col("wells") - 5).alias("Water In 2"),
        (F.col("oil_prod") / 7).alias("Gas In 2nd"),
        F.when(F.col("wells") % 2 == 0, "Sea").otherwise("Earth").alias("Offshore"),
        (F.col("wells") * 1.5).alias("no. Produc"),
        (F.col("wells") * 100.0).alias("Field dept"),
        F.col("oil_prod").alias("Oil (bbl/d"),
        (F.col("wells") * 2.0).alias("Natural Ga"),
    )


@query(
    "PIP1_standardize_source",
    f"""WITH raw AS ({_RAW}), {sql_cells("c", "raw")}
    SELECT field_id, lower("Field name") AS name, q, r, 'registry2024' AS source_id, lower("Function u") AS functional_unit,
      "Water In 2" > 0 AS water_reinjection, "Offshore" = 'Sea' AS offshore,
      CAST(ceil("no. Produc") AS BIGINT) AS num_prod_wells, round("Field dept" * 3.28084e0, 4) AS depth,
      round("Natural Ga" * 6000 / "Oil (bbl/d", 6) AS gor, round("Water In 2" * 6.28981e0 / "Oil (bbl/d", 9) AS wir FROM c""",
)
def _(fx):
    raw = _registry_rows(fx)
    targets = ["name", "functional_unit", "water_reinjection", "offshore", "num_prod_wells", "depth", "gor", "wir", "api"]
    out = standardize(raw, SourceMeta("registry", "2024"), OP_TABLES["registry"], targets, field_id="field_id")
    return out.select(
        "field_id", "name", "cell.q", "cell.r", "source_id", "functional_unit", "water_reinjection", "offshore", "num_prod_wells",
        rounded("depth", 4).alias("depth"), rounded("gor").alias("gor"), rounded("wir", 9).alias("wir"),
    )


_ALL_TARGETS = ["name", "functional_unit", "offshore", "oil_prod", "gor", "depth", "age", "num_prod_wells", "water_reinjection", "downhole_pump"]


@query(
    "PIP1_standardize_all",
    f"""WITH raw AS ({_RAW})
    SELECT 'registry2024' AS source_id, field_id, lower("Field name") AS name, lower("Function u") AS functional_unit, "Offshore" = 'Sea' AS offshore,
      round("Oil (bbl/d", 4) AS oil_prod, round("Natural Ga" * 6000 / "Oil (bbl/d", 6) AS gor, round("Field dept" * 3.28084e0, 4) AS depth,
      CAST(NULL AS DOUBLE) AS age, CAST(ceil("no. Produc") AS BIGINT) AS num_prod_wells, "Water In 2" > 0 AS water_reinjection, CAST(NULL AS BOOLEAN) AS downhole_pump FROM raw
    UNION ALL SELECT 'commercial2022', field_id, lower(name), CASE WHEN wells % 2 = 0 THEN 'oil' ELSE 'gas' END, wells % 3 = 0, round(oil_prod, 4), round(wells * 20e0, 6),
      round(wells * 100 * 3.28084e0, 4), 1950e0 + wells, CAST(wells AS BIGINT), wells % 5 = 0, wells % 5 <> 0 FROM fx_source WHERE source_id = 'b2022'
    UNION ALL SELECT 'paper2021', field_id, lower(name), CASE WHEN wells % 2 = 0 THEN 'oil' ELSE 'gas' END, NULL, round(oil_prod, 4), round(wells * 10e0, 6), NULL, NULL, NULL, NULL, NULL
      FROM fx_source WHERE source_id = 'c2021'
    UNION ALL SELECT 'features2020', field_id, lower(name), CASE WHEN offshore = 1 THEN 'oil' ELSE 'gas' END, offshore = 1, NULL, NULL, NULL, 1950e0 + field_id % 50, NULL, NULL, NULL FROM fx_field""",
)
def _(fx):
    unit = F.when(F.col("wells") % 2 == 0, "Oil").otherwise("Gas")
    commercial = fx.source.where("source_id = 'b2022'").select(
        "field_id", F.col("name").alias("field_name"), unit.alias("field_oil_"), F.when(F.col("wells") % 5 == 0, "Water injection").otherwise("Artificial Lift").alias("field_dr_1"),
        F.lit("Other").alias("field_dr_2"), F.lit(None).cast("string").alias("field_dr_3"), F.col("wells").cast("double").alias("prodw_cnt"), (F.col("wells") * 100.0).alias("f_depth_mt"),
        (F.col("wells") + 1950).alias("field_year"), (F.col("oil_prod") / 1000).alias("f_produc_2"), F.when(F.col("wells") % 3 == 0, "Offshore").otherwise("Onshore").alias("onshore_of"),
        (F.col("wells") * 20.0).cast("string").alias("f_gas_oil_"),
    )
    paper = fx.source.where("source_id = 'c2021'").select(
        "field_id", F.col("field_id").alias("Number"), F.col("name").alias("N_Fldname"), unit.alias("Product_Ty"), (F.col("wells") * 10).alias("SUM_GOR"), F.col("oil_prod").alias("SUM_OIL_PR")
    )
    at_sea = F.col("offshore") == 1
    features = fx.field.select(
        "field_id", F.concat(F.lit("F"), F.col("field_id")).alias("MD_Fkey"), F.col("name").alias("Facility_N"), F.when(at_sea, "Óleo").otherwise("Gás").alias("Commodity"),
        F.concat(F.lit("01/02/"), F.col("field_id") % 50 + 1950).alias("Installati"), F.when(at_sea, "Offshore").otherwise("Onshore").alias("Onshore_Of"),
    )
    inputs = [
        (_registry_rows(fx), SourceMeta("registry", "2024"), "registry"), (commercial, SourceMeta("commercial", "2022"), "commercial"),
        (paper, SourceMeta("paper", "2021"), "paper_inventory"), (features, SourceMeta("features", "2020"), "features"),
    ]
    out = standardize_all(inputs, _ALL_TARGETS, "field_id").withColumns({c: rounded(c, d) for c, d in (("oil_prod", 4), ("gor", 6), ("depth", 4))})
    return out.select("source_id", "field_id", *_ALL_TARGETS)


@query(
    "PIP2_prepare_registry",
    """WITH shapes AS (SELECT c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'oil' WHEN 'MACHINERY' THEN 'gas' END AS function_unit, c_custkey FROM customer),
    depth AS (SELECT o_custkey, avg(o_totalprice) AS depth FROM orders GROUP BY 1),
    reg AS (SELECT o_custkey, min(o_orderkey) AS api, arg_min(year(o_orderdate), o_orderkey) AS start_year FROM orders GROUP BY 1),
    mov AS (SELECT field_id, sum(oil * d) / sum(d) AS oil FROM (SELECT *, day(last_day(strptime(period || '-01', '%Y-%m-%d'))) AS d FROM fx_movement) GROUP BY 1)
    SELECT name, function_unit, round(depth, 6) AS depth, api, start_year, round(oil, 6) AS oil
    FROM shapes LEFT JOIN depth d ON d.o_custkey = c_custkey LEFT JOIN reg r ON r.o_custkey = c_custkey LEFT JOIN mov ON field_id = c_custkey
    WHERE function_unit IS NOT NULL""",
)
def _(fx):
    c = fx.table("customer").select("c_custkey", F.col("c_name").alias("name"))
    fluid = F.when(F.col("c_mktsegment") == "BUILDING", "ÓLEO").when(F.col("c_mktsegment") == "MACHINERY", "GÁS").otherwise("ÁGUA")
    shapes = fx.table("customer").select(F.col("c_name").alias("name"), fluid.alias("fluid"), F.col("c_custkey").alias("seq"))
    orders = fx.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    wells = orders.select("name", F.col("o_totalprice").alias("depth"))
    registered = orders.select(
        "name", F.col("o_orderkey").alias("api"), F.col("o_orderdate").alias("start"), F.lit("sea").alias("location"), F.col("o_orderkey").alias("seq")
    )
    moved = fx.movement.join(c, F.col("field_id") == F.col("c_custkey")).select("name", "period", "oil")
    out = prepare_registry(shapes, wells, registered, moved, ["oil"])
    return out.select(
        "name", "function_unit", rounded("depth", 6).alias("depth"), "api", F.col("start_year").cast("bigint").alias("start_year"), rounded("oil", 6).alias("oil")
    )


_MATCH_OUT = "entity_id, name, q, r, source_id, field_id, round(score, 6) AS score"


def _match_out(matches):
    return matches.select("entity_id", "name", "cell.q", "cell.r", "source_id", "field_id", rounded("score").alias("score"))


@query("PIP3_seed_match_table", f"{SQL_MATCHES} SELECT {_MATCH_OUT} FROM m1")
def _(fx):
    return _match_out(matching.seed_matches(fx.source_cell.where("source_id = 'a2024'")))


@query("PIP4_match_all_sources", f"{SQL_MATCHES} SELECT {_MATCH_OUT} FROM matches")
def _(fx):
    order = matching.order_sources(fx.source.select("source_id", "data_score").distinct())
    return _match_out(matching.match_all_sources(fx.source_cell, order))


@query(
    "PIP5_match_versions",
    f"""{SQL_MATCHES} SELECT 1 AS version, {_MATCH_OUT} FROM m1 UNION ALL SELECT 2, {_MATCH_OUT} FROM m2 UNION ALL SELECT 3, {_MATCH_OUT} FROM matches""",
)
def _(fx):
    versions = [matching.match_version(fx.matches, n).withColumn("version", F.lit(n)) for n in (1, 2, 3)]
    rows = versions[0].unionByName(versions[1]).unionByName(versions[2])
    return rows.select("version", "entity_id", "name", "cell.q", "cell.r", "source_id", "field_id", rounded("score").alias("score"))


def _sql_authoritative(matches: str, authority: str, others: list[str]) -> str:
    listed = ", ".join(f"'{o}'" for o in others)
    return f"""kept AS (SELECT * FROM {matches} WHERE entity_id IN (SELECT entity_id FROM {matches} WHERE source_id = '{authority}'
      UNION SELECT entity_id FROM {matches} WHERE source_id IN ({listed}) GROUP BY entity_id HAVING count(*) >= {(1 + len(others)) // 2 + 1}))
    SELECT dense_rank() OVER (ORDER BY entity_id) - 1 AS entity_id, name, q, r, source_id, field_id, round(score, 6) AS score FROM kept"""


@query("PIP6_filter_authoritative", f"{SQL_MATCHES}, {_sql_authoritative('matches', 'b2022', ['a2024', 'c2021'])}")
def _(fx):
    return _match_out(matching.filter_authoritative(fx.matches, "b2022", ["a2024", "c2021"]))


@query("PIP7_leave_one_out", f"{SQL_MATCHES}, {_sql_authoritative('m2', 'a2024', ['b2022'])}")
def _(fx):
    return _match_out(matching.leave_one_out(fx.source_cell, SOURCE_ORDER, "c2021", "a2024"))


_EACH = {"c2021": ("m2", ["b2022"]), "b2022": ("wb", ["c2021"]), "a2024": ("wa", ["b2022", "c2021"])}


@query(
    "PIP7_leave_each_out",
    f"""{SQL_MATCHES}, {_sql_match_step("wbc", "c2021", "m1", 2)}, wb AS (SELECT * FROM m1 UNION ALL SELECT * FROM wbc),
    w1 AS (SELECT row_number() OVER (ORDER BY field_id) - 1 AS entity_id, name, q, r, source_id, source_name, field_id,
      100e0 AS score, field_id AS seq FROM src WHERE source_id = 'b2022'),
    {_sql_match_step("wac", "c2021", "w1", 2)}, wa AS (SELECT * FROM w1 UNION ALL SELECT * FROM wac)
    {" UNION ALL ".join(f"SELECT '{w}' AS version, t.* FROM (WITH {_sql_authoritative(m, 'a2024', o)}) t" for w, (m, o) in _EACH.items())}""",
)
def _(fx):
    rows = matching.leave_each_out(fx.source_cell, SOURCE_ORDER, "a2024")
    return rows.select("version", "entity_id", "name", "cell.q", "cell.r", "source_id", "field_id", rounded("score").alias("score"))


@query(
    "PIP8_merge_entities",
    f"""{SQL_LOOKUP}, {_MODE},
    best AS (SELECT entity_id, name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, seq) AS rn FROM matches) WHERE rn = 1),
    used AS (SELECT entity_id, string_agg(DISTINCT source_id, ', ' ORDER BY source_id) AS sources_used FROM matches GROUP BY entity_id),
    vals AS (SELECT entity_id, avg(oil_prod) AS oil_prod, median(oil_mid) AS oil_mid, CAST(trunc(median(wells)) AS INTEGER) AS wells,
      CAST(trunc({AS_OF} - avg(age)) AS INTEGER) AS age FROM looked GROUP BY entity_id)
    SELECT b.entity_id, b.name, sources_used, round(oil_prod, 4) AS oil_prod, round(oil_mid, 4) AS oil_mid, wells, kind, age
    FROM best b JOIN used USING (entity_id) LEFT JOIN vals USING (entity_id) LEFT JOIN modes USING (entity_id)""",
)
def _(fx):
    rules = {c: RULES[c] for c in ("oil_prod", "oil_mid", "wells", "kind", "age")}
    rows = fx.source_cell.withColumns({"oil_mid": F.col("oil_prod"), "age": F.col("wells") + 1950})
    out = golden.merge_entities(fx.matches, rows, rules, AS_OF)
    return out.select(
        "entity_id", "name", "sources_used", rounded("oil_prod", 4).alias("oil_prod"), rounded("oil_mid", 4).alias("oil_mid"), "wells", "kind", "age"
    )


_VERSIONS = f"""{SQL_LOOKUP}, ranks AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(SOURCE_ORDER, 1))}) t(rank, source_id)),
    labels AS (SELECT rank AS version FROM ranks),
    vm AS (SELECT l.version, m.* FROM matches m JOIN ranks r USING (source_id) JOIN labels l ON l.version >= r.rank),
    vl AS (SELECT l.version, m.* FROM looked m JOIN ranks r USING (source_id) JOIN labels l ON l.version >= r.rank),
    best AS (SELECT version, entity_id, name FROM (SELECT *, row_number() OVER (PARTITION BY version, entity_id ORDER BY score DESC, seq) AS rn FROM vm) WHERE rn = 1),
    used AS (SELECT version, entity_id, string_agg(DISTINCT source_id, ', ' ORDER BY source_id) AS sources_used FROM vm GROUP BY version, entity_id),
    modes AS (SELECT version, entity_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY version, entity_id ORDER BY n DESC, kind) AS rn
      FROM (SELECT version, entity_id, kind, count(*) AS n FROM vl WHERE kind IS NOT NULL GROUP BY version, entity_id, kind)) WHERE rn = 1),
    vals AS (SELECT version, entity_id, avg(oil_prod) AS oil_prod, median(oil_mid) AS oil_mid, CAST(trunc(median(wells)) AS INTEGER) AS wells,
      CAST(trunc({AS_OF} - avg(age)) AS INTEGER) AS age FROM vl GROUP BY version, entity_id),
    golden AS (SELECT b.version, b.entity_id, b.name, sources_used, round(oil_prod, 4) AS oil_prod, round(oil_mid, 4) AS oil_mid, wells, kind, age
      FROM best b JOIN used USING (version, entity_id) LEFT JOIN vals USING (version, entity_id) LEFT JOIN modes USING (version, entity_id))"""


def _versions(fx):
    rules = {c: RULES[c] for c in ("oil_prod", "oil_mid", "wells", "kind", "age")}
    rows = fx.source_cell.withColumns({"oil_mid": F.col("oil_prod"), "age": F.col("wells") + 1950})
    return golden.merge_versions(golden.cumulative_versions(fx.matches, SOURCE_ORDER), rows, rules, AS_OF)


@query("PIP8_merge_versions", f"{_VERSIONS} SELECT * FROM golden")
def _(fx):
    return _versions(fx).select(
        "version", "entity_id", "name", "sources_used", rounded("oil_prod", 4).alias("oil_prod"), rounded("oil_mid", 4).alias("oil_mid"), "wells", "kind", "age"
    )


@query(
    "AGG14_richness_by_version",
    f"{_VERSIONS} SELECT version, count(name) + count(oil_prod) + count(wells) + count(kind) + count(age) AS n_cells FROM golden GROUP BY version",
)
def _(fx):
    return K.richness_by_version(_versions(fx), ["name", "oil_prod", "wells", "kind", "age"])


@query(
    "PIP9_attribute_flares",
    f"WITH {SQL_FLARES} SELECT field_id, name, round(flare_bcm, 9) AS flare_bcm, round(for_value, 4) AS for_value FROM ratios",
)
def _(fx):
    out, _ = flares.attribute_flares(flares_2000(fx), fields_with_old_ratio(fx))
    return out.select("field_id", "name", rounded("flare_bcm", 9).alias("flare_bcm"), rounded("for_value", 4).alias("for_value"))


@query(
    "PIP10_attribute_flares_monthly",
    f"""WITH {SQL_FLARES}, mon AS (SELECT id, month, sum(bcm) AS bcm FROM fx_flare WHERE year = 2000 GROUP BY id, month),
    w1 AS (SELECT m.id, m.month, m.bcm, l.field_id, CASE WHEN count(*) OVER w > 1 THEN l.oil_prod / nullif(sum(l.oil_prod) OVER w, 0) ELSE 1e0 END AS weight
      FROM mon m JOIN located l ON l.id = m.id WINDOW w AS (PARTITION BY m.id, m.month)),
    w2 AS (SELECT *, weight / nullif(sum(weight) OVER (PARTITION BY id, month), 0) AS share FROM w1),
    v AS (SELECT field_id, month, sum(bcm * share) AS volume FROM w2 GROUP BY field_id, month)
    SELECT f.field_id, f.name, CAST(m AS INTEGER) AS month, round(coalesce(volume, 0), 9) AS flare_volume
    FROM fx_field f CROSS JOIN range(1, 13) t(m) LEFT JOIN v ON v.field_id = f.field_id AND v.month = m""",
)
def _(fx):
    out = flares.attribute_flares_monthly(fx.flare.where("year = 2000"), fx.field_shape)
    return out.select("field_id", "name", "month", rounded("flare_volume", 9).alias("flare_volume"))


_MODEL = """SELECT source_id, field_id, oil_prod, CASE WHEN wells - 10 < 1 THEN NULL ELSE wells - 10 END AS num_prod_wells,
  CASE WHEN oil_prod / 20 < 3 OR oil_prod / 20 > 88 THEN NULL ELSE oil_prod / 20 END AS api,
  CASE WHEN wells * 3e0 > oil_prod / 10 THEN oil_prod / 10 ELSE wells * 3e0 END AS for_value, 'Brazil' AS country
  FROM fx_source WHERE kind LIKE '%E%' AND oil_prod > 0"""


def _model_rows(fx):
    return fx.source.select(
        "source_id", "field_id", "oil_prod",
        F.when(F.col("kind").contains("E"), "oil").otherwise("gas").alias("functional_unit"),
        (F.col("wells") - 10).alias("num_prod_wells"),
        (F.col("oil_prod") / 20).alias("api"),
        (F.col("wells") * 3.0).alias("for_value"),
        (F.col("oil_prod") / 10).alias("gor"),
    )


@query(
    "PIP11_prepare_model_inputs",
    f"SELECT source_id, field_id, round(oil_prod, 4) AS oil_prod, num_prod_wells, round(api, 6) AS api, round(for_value, 6) AS for_value, country FROM ({_MODEL})",
)
def _(fx):
    out = model_inputs.prepare_model_inputs(_model_rows(fx), "Brazil")
    return out.select(
        "source_id", "field_id", rounded("oil_prod", 4).alias("oil_prod"), "num_prod_wells", rounded("api").alias("api"), rounded("for_value").alias("for_value"), "country"
    )


@query(
    "PIP11_long_layout",
    f"""WITH m AS ({_MODEL}) SELECT source_id || '-' || field_id AS field, 'num_prod_wells' AS attribute, CAST(num_prod_wells AS VARCHAR) AS value FROM m
    UNION ALL SELECT source_id || '-' || field_id, 'country', country FROM m""",
)
def _(fx):
    out = model_inputs.prepare_model_inputs(_model_rows(fx), "Brazil")
    return model_inputs.long_layout(out.withColumn("field", F.concat_ws("-", "source_id", F.col("field_id").cast("string"))), "field", ["num_prod_wells", "country"])


def _results(fx):
    """Model results of every field: production and an intensity from the gas-oil ratio."""
    f = fx.field_shape.withColumn("name", F.concat_ws("-", "name", F.col("field_id").cast("string")))
    results = f.select("name", F.coalesce(F.abs("oil_prod"), F.lit(1.0)).alias("production"), (F.lit(2) + F.col("gor") / 40).alias("ci"))
    fields = f.select(F.col("field_id").alias("entity_id"), "name", "gor", "offshore", "shape")
    ratios = f.select(F.col("field_id").alias("entity_id"), F.when(F.col("field_id") % 4 != 0, F.col("gor") / 7).alias("for_value"))
    return results, fields, ratios


# whole basins: both halves of a region's band
_WHOLE = "SELECT r_name AS name, -30e0 + r_regionkey * 2e0 AS south, -60e0 AS west, 10 AS width FROM region"
_HALVES = f"SELECT *, 5 AS width FROM ({_BANDS})"


def _results_sql(bands: str) -> str:
    return f"""res AS (SELECT field_id AS entity_id, name || '-' || field_id AS name, coalesce(abs(oil_prod), 1e0) AS production, 2 + gor / 40 AS ci, gor, offshore,
  CASE WHEN field_id % 4 <> 0 THEN gor / 7 END AS for_value, lon, lat, half FROM fx_field),
bands AS ({bands}),
placed AS (SELECT res.*, b.name AS band FROM res LEFT JOIN bands b ON lon - half >= west AND lon + half <= west + width AND lat - half >= south AND lat + half <= south + 2)"""


def _sql_basins(bands: str, name: str) -> str:
    return f"""WITH {_results_sql(bands)}, n AS (SELECT *, {name} AS basin_name FROM placed WHERE band IS NOT NULL),
    o AS (SELECT basin_name, offshore FROM (SELECT basin_name, offshore, row_number() OVER (PARTITION BY basin_name ORDER BY count(*) DESC, offshore) AS rn
      FROM n GROUP BY 1, 2) WHERE rn = 1)
    SELECT basin_name, round(sum(ci * production) / sum(production), 6) AS weighted_ci, round(coalesce(avg(for_value), 0), 6) AS average_for,
      round(sum(production), 4) AS total_production, any_value(o.offshore) AS offshore_status FROM n JOIN o USING (basin_name) GROUP BY basin_name"""


def _basin_out(report):
    return report.select(
        "basin_name", rounded("weighted_ci").alias("weighted_ci"), rounded("average_for").alias("average_for"),
        rounded("total_production", 4).alias("total_production"), "offshore_status",
    )


@query("PIP12_basin_report", _sql_basins(_WHOLE, "band"))
def _(fx):
    results, fields, ratios = _results(fx)
    return _basin_out(B.basin_report(results, fields, fx.basin.select("name", "outer_shape"), ratios, "strip"))


@query("PIP12_basin_report_by_shore", _sql_basins(_HALVES, "replace(replace(band, '_Mar', '_Offshore'), '_Terra', '_Onshore')"))
def _(fx):
    results, fields, ratios = _results(fx)
    return _basin_out(B.basin_report(results, fields, fx.basin.select("name", "outer_shape"), ratios, "rename"))


_CURVE = f"""WITH {_results_sql(_WHOLE)}, curve AS (SELECT entity_id, name, production * ci AS impact, production / sum(production) OVER () AS width,
  (sum(production) OVER (ORDER BY ci, entity_id ROWS UNBOUNDED PRECEDING) - production) / sum(production) OVER () AS start_x,
  sum(ci * production) OVER () / sum(production) OVER () AS average_ci,
  CASE WHEN gor <= 100 THEN 'red' WHEN gor <= 500 THEN 'orange' WHEN gor <= 1000 THEN 'yellow' ELSE 'lightgreen' END AS gor_class, 'Others' AS basin_class FROM placed)"""


def _curve(fx):
    results, fields, ratios = _results(fx)
    rows = freeze(B.fields_in_basins(results, fields, fx.basin.select("name", "outer_shape"), ratios, "strip"), "placed")
    return B.impact_curve(rows)


@query(
    "PIP13_impact_curve",
    f"""{_CURVE} SELECT entity_id, name, round(impact, 4) AS impact, round(width, 9) AS width, round(start_x, 9) AS start_x, round(average_ci, 6) AS average_ci,
      gor_class, basin_class FROM curve""",
)
def _(fx):
    c = _curve(fx)
    return c.select(
        "entity_id", "name", rounded("impact", 4).alias("impact"), rounded("width", 9).alias("width"), (rounded("start_x", 9) + 0.0).alias("start_x"),
        rounded("average_ci").alias("average_ci"), "gor_class", "basin_class",
    )


@query("PIP13_top_impacts", f"{_CURVE} SELECT entity_id, name, round(impact, 4) AS impact FROM curve ORDER BY curve.impact DESC, entity_id LIMIT 3")
def _(fx):
    return B.top_impacts(_curve(fx)).select("entity_id", "name", rounded("impact", 4).alias("impact"))


UPLOAD_CONFIG = {
    "data_metadata": {
        "name": "parts", "type": "csv", "version": "1",
        "attributes": [
            {"name": "title", "type": "string"},
            {"name": "land", "type": "string"},
            {"name": "depth_m", "type": "number", "units": "m"},
            {"name": "oil", "type": "number", "units": "m^3/day"},
            {"name": "wells", "type": "number"},
            {"name": "at_sea", "type": "string"},
            {"name": "unit", "type": "string"},
        ],
    },
    "file_specific": {"csv": {"delimiter": ";", "encoding": "utf-8", "header_row": 0}},
    "mappings": [
        {"source_attribute": "title", "target_attribute": "name"},
        {"source_attribute": "land", "target_attribute": "country"},
        {"source_attribute": "depth_m", "target_attribute": "depth"},
        {"source_attribute": "oil", "target_attribute": "oil_prod"},
        {"source_attribute": "wells", "target_attribute": "num_prod_wells"},
        {"source_attribute": "at_sea", "target_attribute": "offshore"},
        {"source_attribute": "unit", "target_attribute": "functional_unit"},
    ],
}


def upload_rows(fx):
    """The upload as text columns: every 13th depth is unreadable."""
    return fx.table("part").select(
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("land"),
        F.when(F.col("p_partkey") % 13 == 0, "deep").otherwise((F.col("p_size") * 10).cast("string")).alias("depth_m"),
        F.col("p_retailprice").cast("string").alias("oil"),
        F.concat(F.col("p_size").cast("string"), F.lit(".7")).alias("wells"),
        F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no").alias("at_sea"),
        F.when(F.col("p_size") % 3 == 0, "gas").otherwise("oil").alias("unit"),
    )


@query(
    "PIP14_ingest_entry",
    f"""SELECT p_name AS name, p_brand AS country, round(p_size * 10 / 0.3048e0, 4) AS depth, round(p_retailprice / {num(0.158987294928)}, 4) AS oil_prod,
      CAST(p_size AS BIGINT) AS num_prod_wells, p_size % 2 = 0 AS offshore, CASE WHEN p_size % 3 = 0 THEN 'gas' ELSE 'oil' END AS functional_unit,
      count(*) OVER (PARTITION BY p_name, p_brand) AS n_sharing FROM part WHERE p_partkey % 13 <> 0""",
)
def _(fx):
    path = scratch_path(fx.spark, "upload")
    upload_rows(fx).write.option("sep", ";").csv(path, header=True)
    nobody = fx.spark.createDataFrame([], "field_code string, name string, country string")
    _, data, _ = ingest.ingest_file(fx.spark, path, UPLOAD_CONFIG, "2024-01-01", 1, nobody)
    sharing = data.groupBy("field_code").agg(F.count(F.lit(1)).alias("n_sharing"))
    return data.join(sharing, "field_code").select(
        "name", "country", rounded("depth", 4).alias("depth"), rounded("oil_prod", 4).alias("oil_prod"), "num_prod_wells", "offshore", "functional_unit", "n_sharing"
    )


@query("PIP14_ingest_rejects", "SELECT count(*) AS n, 'depth' AS faults FROM part WHERE p_partkey % 13 = 0")
def _(fx):
    nobody = fx.spark.createDataFrame([], "field_code string, name string, country string")
    rows = fx.table("part").select("p_partkey")
    raw = upload_rows(fx).withColumn("_row", F.monotonically_increasing_id())
    _, _, rejects = ingest.ingest(raw, UPLOAD_CONFIG, "2024-01-01", 1, nobody, ["_row"])
    del rows
    return rejects.groupBy("faults").agg(F.count(F.lit(1)).alias("n"))


@query(
    "PIP15_validate_mappings",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'p_color' ELSE 'p_mass' END AS target_attribute FROM part WHERE p_size % 3 < 2""",
)
def _(fx):
    targets = F.when(F.col("p_size") % 3 == 0, "p_color").when(F.col("p_size") % 3 == 1, "p_mass").otherwise("p_type")
    mappings = fx.table("part").select("p_partkey", targets.alias("target_attribute"))
    attributes = fx.spark.createDataFrame([(c,) for c in fx.table("part").columns], "attribute string")
    return ingest.mapping_errors(mappings, attributes).select("p_partkey", "target_attribute")


PAPER_COLUMNS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]  # the part types


def paper_sheet(fx):
    """A sheet of the part types: attribute names down, one column per type."""
    per = fx.table("part").groupBy("p_type").agg(
        F.min("p_name").alias("name"), F.avg("p_retailprice").cast("string").alias("oil_prod"), F.max("p_size").cast("string").alias("wells")
    )
    long = per.unpivot(["p_type"], ["name", "oil_prod", "wells"], "Field ID", "v")
    picks = [F.max(F.when(F.col("p_type") == k, F.col("v"))).alias(k) for k in PAPER_COLUMNS]
    return long.groupBy("Field ID").agg(*picks)


@query(
    "PIP16_ingest_papers",
    f"""WITH n AS (SELECT p_type, min(p_name) AS name FROM part GROUP BY p_type),
    k AS (SELECT name, row_number() OVER (ORDER BY field_id) - 1 AS id FROM fx_source WHERE source_id = 'a2024' AND name IS NOT NULL),
    p AS (SELECT n.p_type, n.name, k.id, {sql_ratio("n.name", "k.name")} AS s FROM n, k),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY s DESC, id) AS rn FROM p WHERE s >= 60) WHERE rn = 1)
    SELECT b.id AS entity_id, n.name, row_number() OVER (ORDER BY n.p_type) - 1 AS field_id, CAST(b.s AS DOUBLE) AS score FROM n JOIN b ON n.p_type = b.p_type""",
)
def _(fx):
    seeded = freeze(matching.seed_matches(fx.source_cell.where("source_id = 'a2024'")), "seed")
    paper = papers.read_paper(paper_sheet(fx), "Field ID", SourceMeta("paper", "2020"), ["name", "oil_prod", "wells"])
    out = papers.ingest_papers(seeded, [freeze(paper, "paper")], first_rank=1)
    return out.where("source_id = 'paper2020'").select("entity_id", "name", "field_id", "score")


@query(
    "PIP17_estimate_missing",
    f"""WITH {sql_cells("c", "(SELECT * EXCLUDE (field_id), source_id || '-' || field_id AS field_id FROM fx_source)", edge=0.2)}, s AS (SELECT unnest(generate_series(-2, 2)) AS i),
    per AS (SELECT q, r, sum(oil_prod) AS t, count(oil_prod) AS n FROM c GROUP BY q, r),
    near AS (SELECT c.field_id, sum(t) / nullif(sum(n), 0) AS v FROM c, s a, s b, per WHERE abs(a.i + b.i) <= 2 AND per.q = c.q + a.i AND per.r = c.r + b.i AND c.oil_prod IS NULL
      GROUP BY c.field_id),
    reg AS (SELECT kind, avg(oil_prod) AS v FROM c GROUP BY kind)
    SELECT c.field_id, round(coalesce(c.oil_prod, near.v, reg.v), 4) AS oil_prod,
      CASE WHEN c.oil_prod IS NOT NULL THEN 'data' WHEN near.v IS NOT NULL THEN 'neighbours' WHEN reg.v IS NOT NULL THEN 'region' END AS oil_prod_origin
    FROM c LEFT JOIN near ON near.field_id = c.field_id LEFT JOIN reg ON reg.kind = c.kind""",
)
def _(fx):
    from fieldweave.functions.cells import cell_of_point

    rows = fx.source.withColumn("field_id", F.concat_ws("-", "source_id", F.col("field_id").cast("string"))).withColumn("cell", cell_of_point(F.col("lon"), F.col("lat"), 0.2))
    out = estimate.estimate_missing(rows.select("field_id", "cell", "kind", "oil_prod"), "field_id", "cell", "kind", ["oil_prod"], 2)
    return out.select("field_id", rounded("oil_prod", 4).alias("oil_prod"), "oil_prod_origin")


@query(
    "PIP18_source_coverage_report",
    f"""{SQL_MATCHES}, es AS (SELECT DISTINCT entity_id, source_name FROM matches), n AS (SELECT DISTINCT source_name FROM matches),
    x AS (SELECT e.entity_id, e.source_name AS source, n.source_name AS other, o.entity_id IS NOT NULL AS hit FROM es e JOIN n ON n.source_name <> e.source_name
      LEFT JOIN es o ON o.entity_id = e.entity_id AND o.source_name = n.source_name)
    SELECT source, other, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS unmatched FROM x GROUP BY source, other""",
)
def _(fx):
    return K.source_pairs(fx.matches)


@query(
    "PIP18_unmatched_breakdown",
    f"""{SQL_MATCHES}, one AS (SELECT entity_id FROM matches GROUP BY entity_id HAVING count(*) = 1)
    SELECT m.source_name, s.kind, count(*) AS n FROM matches m JOIN one USING (entity_id) JOIN fx_source s ON s.source_id = m.source_id AND s.field_id = m.field_id
    GROUP BY m.source_name, s.kind""",
)
def _(fx):
    return K.unmatched_breakdown(fx.matches, fx.source, "kind")


@query("PIP18_richness_by_source", "SELECT source_id, count(name) + count(oil_prod) + count(wells) + count(kind) AS n_cells FROM fx_source GROUP BY source_id")
def _(fx):
    return K.richness_by_source(fx.source, ["name", "oil_prod", "wells", "kind"])


@query(
    "UDF1_column_op_registry",
    "SELECT source_id, field_id, upper(name) AS shout, round(oil_prod * 6000 / wells, 4) AS gor FROM fx_source",
)
def _(fx):
    ops = {"shout": (["name"], F.upper), "gor": (["oil_prod", "wells"], Q.gas_oil_ratio)}
    out = map_schema(fx.source, ops, ["shout", "gor"], keep=["source_id", "field_id"])
    return out.withColumn("gor", rounded("gor", 4))


@query("UDA1_merge_rule_registry", f"{SQL_LOOKUP} SELECT entity_id, round(max(oil_prod) - min(oil_prod), 4) AS oil_prod FROM looked GROUP BY entity_id")
def _(fx):
    from fieldweave.catalog.aggregate import looked_up

    M.register_merge_rule("spread", lambda c, year: F.max(c) - F.min(c))
    out = M.merge_by_rules(looked_up(fx), "entity_id", {"oil_prod": "spread"}, AS_OF)
    return out.withColumn("oil_prod", rounded("oil_prod", 4))


@query(
    "UDT1_table_functions",
    f"""WITH {sql_cells("c", "fx_field", edge=EDGE)}, s AS (SELECT unnest(generate_series(-1, 1)) AS i)
    SELECT c.field_id, c.q + a.i AS q, c.r + b.i AS r FROM c, s a, s b WHERE abs(a.i + b.i) <= 1""",
)
def _(fx):
    from fieldweave.functions.cells import cell_of_point

    cells = fx.field.select("field_id", cell_of_point(F.col("lon"), F.col("lat"), EDGE).alias("cell"))
    return V.ring(cells, "field_id", "cell", 1).select("field_id", "cell.q", "cell.r")


