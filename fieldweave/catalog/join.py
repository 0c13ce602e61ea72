"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.catalog.base import SQL_MATCHES, query, rounded, sql_ratio
from fieldweave.catalog.cell import _BANDS
from fieldweave.operators import access as A
from fieldweave.operators.matching import best_matches, best_matches_by_name
from fieldweave.operators.merging import lookup_first
from fieldweave.operators.spatial_join import point_shape_join, shape_shape_join
from fieldweave.plans.flares import flare_rollup, months_of
from fieldweave.plans.matching import seed_matches
from fieldweave.session import freeze


@query(
    "JON1_match_best",
    f"{SQL_MATCHES}, b AS (SELECT * FROM m2b_b) SELECT n.field_id, n.name, b.entity_id, round(b.sc, 6) AS score FROM b JOIN src n ON n.field_id = b.field_id AND n.source_id = 'b2022'",
)
def _(fx):
    known = freeze(seed_matches(fx.source_cell.where("source_id = 'a2024'")), "seed")
    new = fx.source_cell.where("source_id = 'b2022' and name is not null").select("field_id", "name", "cell")
    best = best_matches(known, new)
    return new.join(best, ["name", "cell"]).select("field_id", "name", F.col("matched_entity_id").alias("entity_id"), rounded("score").alias("score"))


# new names differ from known ones: cut, extended, blended or missing
_NEW_NAMES = """SELECT field_id, CASE field_id % 6 WHEN 0 THEN name WHEN 2 THEN substr(name, 2) ELSE name || ' ' || kind END AS name
  FROM fx_source WHERE source_id = 'c2021'"""


def _new_names(fx):
    k = F.col("field_id") % 6
    name = F.when(k == 0, F.col("name")).when(k == 2, F.substring("name", 2, 1000)).otherwise(F.concat_ws(" ", "name", "kind"))
    name = F.when(F.col("name").isNotNull(), name)
    return fx.source_cell.where("source_id = 'c2021'").withColumn("name", name)


@query(
    "JON2_match_best_name",
    f"""WITH n AS ({_NEW_NAMES}), k AS (SELECT name, min(field_id) AS seq FROM fx_source WHERE source_id = 'a2024' AND name IS NOT NULL GROUP BY name),
    d AS (SELECT DISTINCT name FROM n WHERE name IS NOT NULL),
    p AS (SELECT d.name, k.seq, {sql_ratio("d.name", "k.name")} AS s FROM d, k),
    b AS (SELECT name, seq, s FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, seq) AS rn FROM p WHERE s >= 60) WHERE rn = 1)
    SELECT n.field_id, n.name, b.seq AS known_field_id, CAST(b.s AS DOUBLE) AS score FROM n JOIN b ON n.name = b.name""",
)
def _(fx):
    known = fx.source_cell.where("source_id = 'a2024'").select(F.col("field_id").alias("entity_id"), "name", "cell", "seq")
    new = _new_names(fx).where("name is not null").select("field_id", "name")
    best = best_matches_by_name(known, new)
    return new.join(best, "name").select("field_id", "name", F.col("matched_entity_id").alias("known_field_id"), "score")


@query("JON2_match_best_name_blocks")
def _(fx):
    known = fx.source_cell.where("source_id = 'a2024'").select(F.col("field_id").alias("entity_id"), "name", "cell", "seq")
    new = _new_names(fx).where("name is not null").select("field_id", "name")
    best = best_matches_by_name(known, new, similarity="blocks")
    return new.join(best, "name").select("field_id", "name", F.col("matched_entity_id").alias("known_field_id"), "score")


_INSIDE = "abs(f.lon - g.lon) < g.half AND abs(f.lat - g.lat) < g.half"
_FLARES = "(SELECT id, min(lon) AS lon, min(lat) AS lat FROM fx_flare GROUP BY id)"


def _flares(fx):
    return flare_rollup(fx.flare).select("id", "lon", "lat")


def _targets(fx):
    return fx.field_shape.select("field_id", "shape")


@query("JON3_point_shape_left", f"SELECT f.id, g.field_id FROM {_FLARES} f LEFT JOIN fx_field g ON {_INSIDE}")
def _(fx):
    return point_shape_join(_flares(fx), _targets(fx), "id", "left").select("id", "field_id")


@query(
    "JON4_point_shape_buffered_remaining",
    f"""SELECT f.id, g.field_id FROM {_FLARES} f LEFT JOIN fx_field g
      ON sqrt(greatest(abs(f.lon - g.lon) - g.half, 0) ** 2 + greatest(abs(f.lat - g.lat) - g.half, 0) ** 2) < 0.05e0
    WHERE NOT EXISTS (SELECT 1 FROM fx_field g WHERE {_INSIDE})""",
)
def _(fx):
    rest = point_shape_join(_flares(fx), _targets(fx), "id", "left_anti")
    return point_shape_join(rest, _targets(fx), "id", "left", distance=0.05).select("id", "field_id")


@query(
    "JON5_shape_shape_left",
    f"""SELECT f.field_id, b.name AS basin FROM fx_field f LEFT JOIN ({_BANDS}) b ON f.lon - f.half >= b.west AND f.lon + f.half <= b.west + 5
      AND f.lat - f.half >= b.south AND f.lat + f.half <= b.south + 2""",
)
def _(fx):
    basins = fx.basin.select(F.col("name").alias("basin"), "outer_shape")
    return shape_shape_join(fx.field_shape, basins, "field_id", "left").select("field_id", "basin")


@query("JON6_left_equi", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def _(fx):
    c = fx.table("customer").where("c_custkey % 3 = 0")
    o = fx.table("orders").select("o_orderkey", "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "JON7_inner_equi",
    """SELECT n.n_name, a.n_customers, round(a.balance, 6) AS balance FROM nation n
    JOIN (SELECT c_nationkey, count(*) AS n_customers, avg(c_acctbal) AS balance FROM customer GROUP BY c_nationkey) a ON a.c_nationkey = n.n_nationkey""",
)
def _(fx):
    means = fx.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"), F.avg("c_acctbal").alias("balance"))
    rows = fx.table("nation").join(means, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("n_name", "n_customers", rounded("balance", 6).alias("balance"))


@query("JON8_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(fx):
    big = fx.table("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return fx.table("customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("JON9_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(fx):
    big = fx.table("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return fx.table("customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_anti")


@query(
    "JON10_lookup_first",
    f"""{SQL_MATCHES} SELECT m.entity_id, m.source_id, m.field_id, round(s.oil_prod, 4) AS oil_prod, s.wells, s.kind FROM matches m
    JOIN fx_source s ON s.source_id = m.source_id AND s.field_id = m.field_id WHERE m.field_id % 5 <> 0""",
)
def _(fx):
    # every row twice, the copy later and different: the first one counts; some records have no source row
    rows = fx.source_cell.where("field_id % 5 <> 0")
    later = rows.withColumns({"seq": F.col("seq") + (1 << 30), "oil_prod": F.col("oil_prod") * 2})
    out = lookup_first(fx.matches.drop("source_name"), rows.unionByName(later), ["oil_prod", "wells", "kind"])
    return out.select("entity_id", "source_id", "field_id", rounded("oil_prod", 4).alias("oil_prod"), "wells", "kind")


@query("JON11_cross_months", "SELECT field_id, name, CAST(m AS INTEGER) AS month FROM fx_field, range(1, 13) t(m)")
def _(fx):
    return months_of(fx.field.select("field_id", "name"))


# customers as users (some superusers), orders as access edges to nations as sources
_EDGES = "SELECT DISTINCT o_custkey AS user_id, o_orderkey % 25 AS source_id FROM orders"
_USERS = "SELECT c_custkey AS user_id, c_name AS name, c_custkey % 50 = 0 AS is_superuser FROM customer"


def _access(fx):
    edges = fx.table("orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 25).alias("source_id")).distinct()
    users = fx.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 50 == 0).alias("is_superuser"))
    sources = fx.table("nation").select(F.col("n_nationkey").cast("bigint").alias("source_id"), F.col("n_name").alias("source"))
    return users, edges, sources


@query(
    "JON12_access_check",
    f"""WITH u AS ({_USERS}), e AS ({_EDGES}), req AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey % 25 AS source_id FROM lineitem)
    SELECT r.user_id, r.source_id FROM req r JOIN u ON u.user_id = r.user_id
    WHERE u.is_superuser OR EXISTS (SELECT 1 FROM e WHERE e.user_id = r.user_id AND e.source_id = r.source_id)""",
)
def _(fx):
    users, edges, _ = _access(fx)
    requests = fx.table("lineitem").select(F.col("l_suppkey").alias("user_id"), (F.col("l_partkey") % 25).alias("source_id")).distinct()
    return A.has_access(requests, users, edges).select("user_id", "source_id")


@query(
    "JON12_sources_of_user",
    f"""WITH u AS ({_USERS}), e AS ({_EDGES})
    SELECT 7 AS user_id, CAST(n_nationkey AS BIGINT) AS source_id, n_name AS source FROM nation WHERE n_nationkey IN (SELECT source_id FROM e WHERE user_id = 7)
    UNION ALL SELECT 50, CAST(n_nationkey AS BIGINT), n_name FROM nation""",
)
def _(fx):
    users, edges, sources = _access(fx)
    seven = A.sources_of_user(7, users, edges, sources).select(F.lit(7).alias("user_id"), "source_id", "source")
    return seven.unionByName(A.sources_of_user(50, users, edges, sources).select(F.lit(50).alias("user_id"), "source_id", "source"))


@query(
    "JON12_users_of_source",
    f"WITH u AS ({_USERS}), e AS ({_EDGES}) SELECT user_id, name FROM u WHERE user_id IN (SELECT user_id FROM e WHERE source_id = 3)",
)
def _(fx):
    users, edges, _ = _access(fx)
    return A.users_of_source(edges, users, 3).select("user_id", "name")


@query(
    "JON13_get_or_create",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'C' || (o_custkey % 400) END AS name,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS country FROM orders),
    k AS (SELECT 'C' || (c_custkey % 200) AS name, 'O' AS country, min('K' || c_custkey) AS code FROM customer GROUP BY ALL)
    SELECT r.o_orderkey, r.name, r.country, k.code AS known_code,
      CASE WHEN r.name IS NULL OR r.country IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY r.name, r.country) END AS n_sharing
    FROM r LEFT JOIN k ON r.name = k.name AND r.country = k.country""",
)
def _(fx):
    rows = fx.table("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("C"), (F.col("o_custkey") % 400).cast("string"))).alias("name"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("country"),
    )
    known = fx.table("customer").select(
        F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("field_code"),
        F.concat(F.lit("C"), (F.col("c_custkey") % 200).cast("string")).alias("name"),
        F.lit("O").alias("country"),
    )
    coded, _ = A.get_or_create(rows, known, ["o_orderkey"], "test")
    sharing = coded.groupBy("field_code").agg(F.count(F.lit(1)).alias("n_sharing"))
    known_code = F.when(F.col("field_code").startswith("K"), F.col("field_code")).alias("known_code")
    return coded.join(sharing, "field_code").select("o_orderkey", "name", "country", known_code, "n_sharing")


@query(
    "JON14_result_field_join",
    """SELECT r.result_id, r.name, f.field_id, f.gor FROM (SELECT p_partkey AS result_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'none' END AS name FROM part) r
    LEFT JOIN (SELECT name, min(field_id) AS field_id, arg_min(gor, field_id) AS gor FROM fx_field GROUP BY name) f ON r.name = f.name""",
)
def _(fx):
    results = fx.table("part").select(F.col("p_partkey").alias("result_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("none").alias("name"))
    fields = fx.field.groupBy("name").agg(F.min("field_id").alias("field_id"), F.min_by("gor", "field_id").alias("gor"))
    return results.join(fields, "name", "left").select("result_id", "name", "field_id", "gor")
