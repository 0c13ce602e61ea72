"""Queries of the aggregations and window-like operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.catalog.base import SQL_MATCHES, query, rounded
from fieldweave.operators import aggregates as G
from fieldweave.operators import merging as M
from fieldweave.operators.numbering import allocate_ids, dense_renumber
from fieldweave.plans import flares as L
from fieldweave.plans.basins import impact_curve
from fieldweave.plans.ingest import entry_status, processed_counts, profile_dataset

AS_OF = 2024
RULES = {
    "oil_prod": "average",
    "oil_mid": "median",
    "wells": "median int",
    "wells_mid": "average int",
    "kind": "most frequent",
    "age": "avg_age",
    "kinds": "as listed",
}
_LOOKUP = """looked AS (SELECT m.entity_id, m.source_id, m.source_name, m.field_id, m.name, m.score, m.seq, s.oil_prod, s.oil_prod AS oil_mid, s.wells,
    s.wells AS wells_mid, s.kind, 1950 + s.wells AS age, s.kind AS kinds
  FROM matches m JOIN fx_source s ON s.source_id = m.source_id AND s.field_id = m.field_id)"""
SQL_LOOKUP = f"{SQL_MATCHES}, {_LOOKUP}"


def looked_up(fx):
    more = {"oil_mid": F.col("oil_prod"), "wells_mid": F.col("wells"), "age": F.col("wells") + 1950, "kinds": F.col("kind")}
    rows = fx.source_cell.withColumns(more)
    return M.lookup_first(fx.matches.drop("source_name"), rows, ["source_name", *RULES])


def _merged(fx, *columns):
    return M.merge_by_rules(looked_up(fx), "entity_id", {c: RULES[c] for c in columns}, AS_OF)


_MODE = """modes AS (SELECT entity_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, kind) AS rn
  FROM (SELECT entity_id, kind, count(*) AS n FROM looked WHERE kind IS NOT NULL GROUP BY entity_id, kind)) WHERE rn = 1)"""


@query(
    "AGG1_merge_by_rules",
    f"""{SQL_LOOKUP}, {_MODE} SELECT entity_id, round(avg(oil_prod), 4) AS oil_prod, round(median(oil_mid), 4) AS oil_mid,
      CAST(trunc(median(wells)) AS INTEGER) AS wells, any_value(m.kind) AS kind FROM looked LEFT JOIN modes m USING (entity_id) GROUP BY entity_id""",
)
def _(fx):
    out = _merged(fx, "oil_prod", "oil_mid", "wells", "kind")
    return out.select("entity_id", rounded("oil_prod", 4).alias("oil_prod"), rounded("oil_mid", 4).alias("oil_mid"), "wells", "kind")


@query("AGG1a_average", f"{SQL_LOOKUP} SELECT entity_id, round(avg(oil_prod), 4) AS oil_prod FROM looked GROUP BY entity_id")
def _(fx):
    return _merged(fx, "oil_prod").select("entity_id", rounded("oil_prod", 4).alias("oil_prod"))


@query("AGG1b_average_int", f"{SQL_LOOKUP} SELECT entity_id, CAST(trunc(median(wells)) AS INTEGER) AS wells_mid FROM looked GROUP BY entity_id")
def _(fx):
    return _merged(fx, "wells_mid")


@query("AGG1c_median", f"{SQL_LOOKUP} SELECT entity_id, round(median(oil_prod), 4) AS oil_mid, CAST(trunc(median(wells)) AS INTEGER) AS wells FROM looked GROUP BY entity_id")
def _(fx):
    return _merged(fx, "oil_mid", "wells").select("entity_id", rounded("oil_mid", 4).alias("oil_mid"), "wells")


@query("AGG1d_most_frequent", f"{SQL_LOOKUP}, {_MODE} SELECT entity_id, kind FROM modes")
def _(fx):
    return _merged(fx, "kind")


@query("AGG1e_avg_age", f"{SQL_LOOKUP} SELECT entity_id, CAST(trunc({AS_OF} - avg(age)) AS INTEGER) AS age FROM looked GROUP BY entity_id")
def _(fx):
    return _merged(fx, "age")


@query("AGG1f_as_listed", f"{SQL_LOOKUP} SELECT entity_id, string_agg(kinds, '|' ORDER BY kinds) AS kinds FROM looked GROUP BY entity_id")
def _(fx):
    return _merged(fx, "kinds").select("entity_id", F.array_join("kinds", "|").alias("kinds"))


@query("AGG2_best_name", f"{SQL_MATCHES} SELECT entity_id, name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, seq) AS rn FROM matches) WHERE rn = 1")
def _(fx):
    return M.best_name(fx.matches)


@query("AGG3_sources_used", f"{SQL_MATCHES} SELECT entity_id, string_agg(DISTINCT source_id, ', ' ORDER BY source_id) AS sources_used FROM matches GROUP BY entity_id")
def _(fx):
    return M.sources_used(fx.matches)


_LINEAGE_COLS = ["oil_prod", "wells", "kind"]


@query(
    "AGG4_lineage_collect",
    f"{SQL_LOOKUP} " + " UNION ALL ".join(f"SELECT entity_id, '{c}' AS \"column\", source_name, field_id FROM looked WHERE {c} IS NOT NULL" for c in _LINEAGE_COLS),
)
def _(fx):
    return M.lineage_rows(looked_up(fx), _LINEAGE_COLS)


_ITEM = """'{"source_name":"' || source_name || '","field_id":' || field_id || '}'"""


@query(
    "SCL25_json_lineage",
    f"""{SQL_LOOKUP}, long AS ({" UNION ALL ".join(f"SELECT entity_id, '{c}' AS col, source_name, field_id FROM looked WHERE {c} IS NOT NULL" for c in _LINEAGE_COLS)}),
    per AS (SELECT entity_id, col, '"' || col || '":[' || string_agg({_ITEM}, ',' ORDER BY source_name, field_id) || ']' AS part FROM long GROUP BY entity_id, col)
    SELECT entity_id, '{{' || string_agg(part, ',' ORDER BY col) || '}}' AS lineage FROM per GROUP BY entity_id""",
)
def _(fx):
    return M.lineage_map(looked_up(fx), _LINEAGE_COLS)


@query(
    "AGG5_flare_rollup",
    """SELECT id, year, arg_min(lon, month) AS lon, arg_min(lat, month) AS lat, round(avg(t_mean), 6) AS avg_temp, round(sum(bcm), 9) AS bcm
    FROM fx_flare GROUP BY id, year""",
)
def _(fx):
    out = L.flare_rollup(fx.flare, keys=["id", "year"])
    return out.select("id", "year", "lon", "lat", rounded("avg_temp").alias("avg_temp"), rounded("bcm", 9).alias("bcm"))


@query("AGG6_group_mean", "SELECT l_suppkey, round(avg(l_quantity), 6) AS depth FROM lineitem GROUP BY l_suppkey")
def _(fx):
    return fx.table("lineitem").groupBy("l_suppkey").agg(rounded(F.avg("l_quantity")).alias("depth"))


@query(
    "AGG7_time_weighted_mean",
    """SELECT field_id, round(sum(oil * d) / sum(d), 6) AS oil FROM (SELECT *, day(last_day(strptime(period || '-01', '%Y-%m-%d'))) AS d FROM fx_movement)
    GROUP BY field_id""",
)
def _(fx):
    return G.time_weighted_means(fx.movement, "field_id", "period", ["oil"]).select("field_id", rounded("oil", 6).alias("oil"))


@query(
    "AGG8_group_filter_size",
    f"""{SQL_MATCHES}, n AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS k FROM matches)
    SELECT entity_id, source_id, field_id, CASE WHEN k = 1 THEN 'single' ELSE 'shared' END AS kind FROM n""",
)
def _(fx):
    parts = [G.group_size_filter(fx.matches, ["entity_id"], kind).withColumn("kind", F.lit(kind)) for kind in ("single", "shared")]
    return parts[0].unionByName(parts[1]).select("entity_id", "source_id", "field_id", "kind")


@query(
    "AGG9_count_sources_having",
    f"{SQL_MATCHES} SELECT entity_id, count(*) AS n_rows FROM matches WHERE source_id IN ('b2022', 'c2021') GROUP BY entity_id HAVING count(*) >= 2",
)
def _(fx):
    return G.count_having(fx.matches, "entity_id", "source_id", ["b2022", "c2021"], 2)


@query(
    "AGG10_weighted_avg",
    "SELECT country, round(sum((2 + gor / 40) * oil_prod) / sum(oil_prod), 6) AS weighted_ci FROM fx_field GROUP BY country",
)
def _(fx):
    ci = F.lit(2) + F.col("gor") / 40
    # weights of missing production drop out of both sums
    return fx.field.groupBy("country").agg(rounded(G.weighted_average(ci, F.col("oil_prod"))).alias("weighted_ci"))


@query(
    "AGG11_group_stats",
    """WITH o AS (SELECT country, offshore FROM (SELECT country, offshore, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, offshore) AS rn
      FROM fx_field GROUP BY country, offshore) WHERE rn = 1)
    SELECT country, round(coalesce(avg(oil_prod), 0), 4) AS average_for, round(sum(gor), 4) AS total_production, any_value(o.offshore) AS offshore_status
    FROM fx_field JOIN o USING (country) GROUP BY country""",
)
def _(fx):
    stats = fx.field.groupBy("country").agg(
        rounded(F.coalesce(F.avg("oil_prod"), F.lit(0.0)), 4).alias("average_for"), rounded(F.sum("gor"), 4).alias("total_production")
    )
    return stats.join(G.group_modes(fx.field, ["country"], ["offshore"]).withColumnRenamed("offshore", "offshore_status"), "country")


@query("AGG12_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC")
def _(fx):
    return G.value_counts(fx.table("orders"), "o_orderpriority").orderBy(F.desc("n"))


@query(
    "AGG13_distribution_summary",
    """WITH r AS (SELECT l_returnflag, l_quantity, CAST(CASE WHEN l_quantity < 0 THEN -1 WHEN l_quantity > 40 THEN 10
      ELSE least(floor(l_quantity / 4e0), 9) END AS INTEGER) AS bin FROM lineitem WHERE l_quantity IS NOT NULL),
    t AS (SELECT l_returnflag, count(*) AS n_rows, min(l_quantity) AS low, max(l_quantity) AS high, quantile_cont(l_quantity, 0.25) AS q1,
      quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM r GROUP BY l_returnflag)
    SELECT r.l_returnflag, r.bin, count(*) AS n, any_value(n_rows) AS n_rows, any_value(low) AS low, any_value(high) AS high,
      any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3 FROM r JOIN t USING (l_returnflag) GROUP BY r.l_returnflag, r.bin""",
)
def _(fx):
    return G.distribution_summary(fx.table("lineitem"), "l_returnflag", "l_quantity", 40.0)


@query(
    "AGG14_non_null_cells",
    """SELECT source_id, count(source_name) + count(data_score) + count(field_id) + count(name) + count(lon) + count(lat) + count(oil_prod) + count(wells)
      + count(kind) AS n_cells FROM fx_source GROUP BY source_id""",
)
def _(fx):
    return G.non_null_cells(fx.source, ["source_id"])


@query("AGG15_product_sum", "SELECT round(sum(l_quantity * l_discount), 2) AS product_sum FROM lineitem WHERE l_linenumber % 3 <> 0")
def _(fx):
    text = F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_discount").cast("string"))
    return fx.table("lineitem").agg(rounded(G.product_sum(F.col("l_quantity"), text), 2).alias("product_sum"))


@query(
    "AGG16_distinct_overlap_count",
    f"""{SQL_MATCHES} SELECT count(*) AS n_entities FROM (SELECT entity_id FROM matches WHERE contains(source_id, 'a20')
      INTERSECT SELECT entity_id FROM matches WHERE contains(source_id, 'b20'))""",
)
def _(fx):
    return G.overlap_count(fx.matches, "entity_id", "source_id", "a20", "b20")


SQL_FLARES = """fl AS (SELECT id, arg_min(lon, month) AS lon, arg_min(lat, month) AS lat, sum(bcm) AS bcm FROM fx_flare WHERE year = 2000 GROUP BY id),
near AS (SELECT f.id, f.bcm, g.field_id, g.oil_prod, sqrt(greatest(abs(f.lon - g.lon) - g.half, 0) ** 2 + greatest(abs(f.lat - g.lat) - g.half, 0) ** 2) AS d,
  abs(f.lon - g.lon) < g.half AND abs(f.lat - g.lat) < g.half AS interior
  FROM fl f JOIN fx_field g ON abs(f.lon - g.lon) < g.half + 0.1e0 AND abs(f.lat - g.lat) < g.half + 0.1e0),
located AS (SELECT * FROM near WHERE interior UNION ALL SELECT * FROM near WHERE d < 0.05e0 AND id NOT IN (SELECT id FROM near WHERE interior)),
weighted AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN oil_prod / nullif(sum(oil_prod) OVER (PARTITION BY id), 0) ELSE 1e0 END AS weight FROM located),
volumes AS (SELECT field_id, coalesce(sum(bcm * weight), 0) AS flare_bcm FROM weighted GROUP BY field_id),
ratios AS (SELECT g.*, CASE WHEN oil_prod > 0 THEN oil_prod ELSE 1e0 END AS p, v.flare_bcm,
  coalesce(v.flare_bcm * 35314666572.222e0 / ((CASE WHEN oil_prod > 0 THEN oil_prod ELSE 1e0 END) * 365), CASE WHEN g.field_id % 2 = 0 THEN 1e0 END) AS for_value
  FROM fx_field g LEFT JOIN volumes v ON g.field_id = v.field_id)"""


def flares_2000(fx):
    return L.flare_rollup(fx.flare.where("year = 2000"))


def fields_with_old_ratio(fx):
    """Every other field brings an older flaring ratio, which it keeps where no flare reaches it."""
    return fx.field_shape.withColumn("for_value", F.when(F.col("field_id") % 2 == 0, 1.0))


@query(
    "AGG17_match_rates",
    f"""WITH {SQL_FLARES}, t AS (SELECT sum(bcm) AS total FROM fl), i AS (SELECT sum(bcm) AS v FROM fl WHERE id IN (SELECT id FROM near WHERE interior)),
    e AS (SELECT sum(p * for_value) * 365 / 35314666572.222e0 AS v FROM ratios)
    SELECT round(i.v / total, 6) AS initial_rate, round(e.v / total, 6) AS final_rate, round(1 - e.v / total, 6) AS unmatched_rate FROM t, i, e""",
)
def _(fx):
    _, rates = L.attribute_flares(flares_2000(fx), fields_with_old_ratio(fx))
    return rates.select(*[rounded(c).alias(c) for c in rates.columns])


@query(
    "AGG18_monthly_flare",
    """WITH v AS (SELECT id % 100 AS field_id, CAST(month AS INTEGER) AS month, sum(bcm) AS bcm FROM fx_flare GROUP BY 1, 2)
    SELECT f.field_id, f.name, CAST(m AS INTEGER) AS month, round(coalesce(v.bcm, 0), 9) AS flare_volume
    FROM fx_field f CROSS JOIN range(1, 13) t(m) LEFT JOIN v ON v.field_id = f.field_id AND v.month = m""",
)
def _(fx):
    v = fx.flare.groupBy((F.col("id") % 100).alias("field_id"), "month").agg(F.sum("bcm").alias("bcm"))
    grid = L.months_of(fx.field.select("field_id", "name"))
    return grid.join(v, ["field_id", "month"], "left").select(
        "field_id", "name", "month", rounded(F.coalesce("bcm", F.lit(0.0)), 9).alias("flare_volume")
    )


@query("AGG19_processed_count", "SELECT l_suppkey AS data_entry_id, count(*) AS n_rows FROM lineitem GROUP BY l_suppkey")
def _(fx):
    return processed_counts(fx.table("lineitem").withColumnRenamed("l_suppkey", "data_entry_id"))


@query("AGG20_profile_dataset", "SELECT count(*) AS row_count, 5 AS column_count, 'no_such, other' AS missing_columns FROM customer")
def _(fx):
    return profile_dataset(fx.table("customer"), ["c_name", "no_such", "c_acctbal", "other"])


@query(
    "AGG21_dedupe_first",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def _(fx):
    return G.first_rows(fx.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("AGG22_unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(fx):
    return G.unique_violations(fx.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "AGG23_entry_status",
    """SELECT o_orderkey AS data_entry_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
      CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'Processing error' END AS error_message,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = 7) AS n_rows FROM orders WHERE o_orderkey = 7""",
)
def _(fx):
    s = F.col("o_orderstatus")
    entries = fx.table("orders").select(
        F.col("o_orderkey").alias("data_entry_id"),
        F.when(s == "F", "COMPLETED").when(s == "O", "PENDING").otherwise("FAILED").alias("status"),
        F.when(~s.isin("F", "O"), "Processing error").alias("error_message"),
    )
    data = fx.table("lineitem").select(F.col("l_orderkey").alias("data_entry_id"))
    return entry_status(entries, data, 7)


@query(
    "WIN1_share_of_group",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN count(*) OVER w > 1 THEN l_quantity / sum(l_quantity) OVER w ELSE 1e0 END, 9) AS weight
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
)
def _(fx):
    out = L.share_of_group(fx.table("lineitem"), ["l_orderkey"], "l_quantity", ["l_partkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded("weight", 9).alias("weight"))


@query(
    "WIN2_renormalize_weights",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS weight FROM lineitem""",
)
def _(fx):
    out = L.renormalize(fx.table("lineitem").withColumn("weight", F.col("l_quantity")), ["l_orderkey"], ["l_partkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded("weight", 9).alias("weight"))


@query(
    "WIN3_running_share",
    """SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (), 9) AS width,
      round((sum(o_totalprice) OVER (ORDER BY o_custkey % 97, o_orderkey ROWS UNBOUNDED PRECEDING) - o_totalprice) / sum(o_totalprice) OVER (), 9) AS start_x FROM orders""",
)
def _(fx):
    rows = fx.table("orders").select(
        "o_orderkey", F.col("o_totalprice").alias("production"), (F.col("o_custkey") % 97).cast("double").alias("ci"),
        F.lit(1.0).alias("gor"), F.lit("x").alias("basin_name"),
    )
    curve = impact_curve(rows, "o_orderkey")
    return curve.select("o_orderkey", rounded("width", 9).alias("width"), (rounded("start_x", 9) + 0.0).alias("start_x"))


@query(
    "WIN4_dense_renumber",
    "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS o_custkey FROM orders WHERE o_custkey % 3 = 0",
)
def _(fx):
    rows = fx.table("orders").where("o_custkey % 3 = 0").select("o_orderkey", "o_custkey")
    return dense_renumber(rows, "o_custkey")


@query(
    "WIN5_allocate_new_ids",
    """SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS entity_id FROM orders WHERE o_orderstatus = 'F'""",
)
def _(fx):
    unmatched = fx.table("orders").where("o_orderstatus = 'F'").select("o_orderkey")
    existing = fx.table("customer").select(F.col("c_custkey").alias("entity_id"))
    return allocate_ids(unmatched, existing, "entity_id", "o_orderkey")


