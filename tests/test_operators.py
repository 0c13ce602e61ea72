"""Numbering, skew handling, aggregation, merging and the row rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import quantities as Q
from fieldweave.functions import recode as R
from fieldweave.functions import text as X
from fieldweave.functions import units as U
from fieldweave.operators import access as A
from fieldweave.operators import aggregates as G
from fieldweave.operators import merging as M
from fieldweave.operators import projection as P
from fieldweave.operators.numbering import allocate_ids, dense_renumber, number_rows, running_sum
from fieldweave.operators.skew import salted_join, with_group_totals
from fieldweave.sources import files as IO


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("k"), "id")
    rows = number_rows(df, ["k"], "n", start=1).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 5001))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_numbers_with_one_value_in_a_third_of_the_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    rows = number_rows(df, ["k", "id"], "n").orderBy("n").collect()
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_running_sum(spark):
    rng = random.Random(2)
    data = [(i, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(data, "id bigint, v double").repartition(9)
    got = {r["id"]: r["running"] for r in running_sum(df, ["id"], "v").collect()}
    assert np.allclose([got[i] for i in range(2000)], np.cumsum([v for _, v in data]))


def test_renumber_and_allocate(spark):
    df = spark.createDataFrame([(7, "a"), (3, "b"), (7, "c"), (90, "d")], "e bigint, t string")
    assert {r["t"]: r["e"] for r in dense_renumber(df, "e").collect()} == {"b": 0, "a": 1, "c": 1, "d": 2}
    new = spark.createDataFrame([(5, "x"), (2, "y")], "seq bigint, t string")
    assert {r["t"]: r["e"] for r in allocate_ids(new, df, "e", "seq").collect()} == {"y": 91, "x": 92}
    assert {r["t"]: r["e"] for r in allocate_ids(new, df.where("e < 0"), "e", "seq").collect()} == {"y": 0, "x": 1}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    left = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(200).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("b"))
    want = sorted(map(tuple, left.join(right, "k", how).select("k", "a", "b").collect()), key=repr)
    got = salted_join(left, right, ["k"], ["a"], ["b"], how, None, rows_per_split=10)
    assert sorted(map(tuple, got.select("k", "a", "b").collect()), key=repr) == want
    null_safe = salted_join(left.withColumn("k", F.nullif("k", F.lit(0))), right.withColumn("k", F.nullif("k", F.lit(0))), ["k"], ["a"], ["b"], "inner", None, 10, True)
    assert null_safe.count() == left.join(right, "k").count()


def test_group_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, 5.0)], "k bigint, v double")
    for split in (200000, 1):
        rows = with_group_totals(df, ["k"], [F.sum("v").alias("t")], ["v"], split).collect()
        assert sorted((r["v"], r["t"]) for r in rows) == [(1.0, 3.0), (2.0, 3.0), (5.0, 5.0)]


@pytest.mark.parametrize("buffer_rows", [1_000_000, 40])
def test_quantiles_of_hot_groups(spark, buffer_rows):
    rng = random.Random(4)
    data = [(k, rng.choice([None, round(rng.uniform(0, 9), 1)]), rng.uniform(0, 1)) for k in (1, 1, 1, 2, 3) for _ in range(37)]
    df = spark.createDataFrame(data, "k bigint, a double, b double").repartition(5)
    got = {r["k"]: r for r in G.group_quantiles(df, ["k"], ["a", "b"], {"_q1": 0.25, "": 0.5}, buffer_rows).collect()}
    for k in (1, 2, 3):
        a = [x for kk, x, _ in data if kk == k and x is not None]
        b = [x for kk, _, x in data if kk == k]
        assert np.allclose([got[k]["a_q1"], got[k]["a"], got[k]["b_q1"], got[k]["b"]], [np.quantile(a, 0.25), np.median(a), np.quantile(b, 0.25), np.median(b)])


def test_merge_rules(spark):
    rows = [
        (1, 10.0, 4, "x", 1990, 1), (1, None, 7, "y", 2000, 2), (1, 20.0, None, "y", None, 3),
        (2, None, 3, "b", None, 4), (2, None, 4, "a", None, 5), (3, 1.0, -3, None, 2010, 6), (3, 2.0, -4, None, 2011, 7),
    ]
    df = spark.createDataFrame(rows, "e bigint, oil double, wells int, kind string, year int, seq bigint")
    df = df.withColumns({"mid": F.col("oil"), "wells2": F.col("wells"), "kinds": F.col("kind")})
    rules = {"oil": "average", "mid": "median", "wells": "median int", "wells2": "average int", "kind": "most frequent", "year": "avg_age", "kinds": "?"}
    got = {r["e"]: r for r in M.merge_by_rules(df, "e", rules, 2024).collect()}
    # a median rule truncates toward zero, a tied mode takes the smallest value, an empty column stays null
    assert tuple(got[1])[1:] == (15.0, 15.0, 5, 5, "y", 29, ["x", "y", "y"])
    assert tuple(got[2])[1:] == (None, None, 3, 3, "a", None, ["a", "b"])
    assert tuple(got[3])[1:] == (1.5, 1.5, -3, -3, None, 13, None)


def test_lineage_and_names(spark):
    rows = [(1, "a", 7, "one", 60.0, 1, 5.0, None), (1, "b", 8, "two", 100.0, 2, None, "k"), (1, "b", 9, "three", 100.0, 3, 6.0, "k")]
    df = spark.createDataFrame(rows, "entity_id bigint, source_name string, field_id bigint, name string, score double, seq bigint, oil double, kind string")
    df = df.withColumn("source_id", F.col("source_name"))
    assert M.best_name(df).collect()[0]["name"] == "two"
    assert M.sources_used(df).collect()[0]["sources_used"] == "a, b"
    assert {tuple(r) for r in M.lineage_rows(df, ["oil", "kind"]).collect()} == {(1, "oil", "a", 7), (1, "oil", "b", 9), (1, "kind", "b", 8), (1, "kind", "b", 9)}
    text = M.lineage_map(df, ["oil", "kind"]).collect()[0]["lineage"]
    assert text == '{"kind":[{"source_name":"b","field_id":8},{"source_name":"b","field_id":9}],"oil":[{"source_name":"a","field_id":7},{"source_name":"b","field_id":9}]}'


def test_names_and_flags(spark):
    df = spark.createDataFrame([("ÓLEO Štěpán Øre Straße Ærø Łódź",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.normalize_name(F.col("t"))).collect()] == ["oleo stepan ore strasse aero lodz", None, ""]
    words = spark.createDataFrame([("Óleo",), ("GÁS",), ("ole",), ("",), (None,)], "t string")
    assert [r[0] for r in words.select(X.unit_from_text(F.col("t"), X.UNIT_WORDS_PT)).collect()] == ["oil", "gas", None, None, None]
    methods = spark.createDataFrame([("Artificial lift, water drive", None), (None, "Nitrogen flooding"), (None, None)], "a string, b string")
    flags = X.multi_hot_methods([F.col("a"), F.col("b")])
    rows = methods.select(*[c.alias(n) for n, c in flags.items()]).collect()
    assert rows[0].asDict() == {"downhole_pump": 1, "gas_flooding": 0, "water_flooding": 1, "steam_flooding": 0, "water_reinjection": 0}
    assert rows[1]["gas_flooding"] == 1 and sum(rows[2]) == 0
    kinds = spark.createDataFrame([("a.CSV",), ("b.tar.gz",), ("noext",), ("c.GeoJSON",), (None,)], "t string")
    assert [r[0] for r in kinds.select(X.file_kind(F.col("t"))).collect()] == ["csv", "other", None, "geojson", None]


def test_guarded_quantities(spark):
    rows = [(1.0, 2.0, 0.0, 5.0), (None, -1.0, 3.0, 0.0), (None, None, None, 5.0), (3.0, 3.0, 3.0, None), (0.0, 0.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "g double, n double, c double, oil double")
    g, n, c, oil = (F.col(x) for x in ("g", "n", "c", "oil"))
    out = df.select(
        Q.dominant_gas_code(g, n, c).alias("code"), Q.gas_flood_ratio([g, c, n], oil).alias("gfir"), Q.gas_oil_ratio(g, oil).alias("gor"),
        Q.positive_flag2(g, n).alias("two"), Q.remaining_gas_fraction(g, oil, n, c, c, c).alias("left"),
    ).collect()
    assert [r["code"] for r in out] == [2, 3, None, 1, None]
    assert [r["gfir"] is None for r in out] == [False, True, False, True, False] and out[2]["gfir"] == 0
    assert [r["gor"] for r in out] == [1200.0, None, None, None, 0.0]
    assert [r["two"] for r in out] == [1, 0, None, 1, 0]
    assert out[0]["left"] == pytest.approx(1 / (5 * 0.1647 + 2)) and out[2]["left"] is None
    labels = spark.createDataFrame([(100.0,), (100.5,), (10001.0,), (None,)], "v double").select(Q.gor_class(F.col("v"))).collect()
    assert [r[0] for r in labels] == ["red", "orange", "darkgreen", "0"]


def test_long_unit_names(spark):
    for name, unit in U.LONG_NAMES.items():
        assert U.unit_step(name, unit) == (1.0, 0.0)
    assert U.unit_step("barrel_oil", "m^3")[0] == pytest.approx(0.158987294928)
    assert U.unit_step("barrels_oil_equivalent", "joule")[0] == pytest.approx(5.8e6 * 1055.06)


def test_result_rows_by_position(spark):
    rows = [(20, "label", "x", "no", None), (21, "Field", "unit", "marlim", "tupi"), (24, "Oil", "bbl", "100.5", None), (193, "CI", "g/MJ", "7", "8")]
    sheet = spark.createDataFrame(rows, "row int, a string, `b.c` string, d string, e string")
    got = IO.scan_result_rows(sheet, {21: "name", 24: "oil", 193: "ci", 500: "none"}, first_column=3).orderBy("column").collect()
    assert [tuple(r) for r in got] == [(3, "marlim", "100.5", "7", None), (4, "tupi", None, "8", None)]
    assert IO.scan_result_rows(sheet.limit(0), {21: "name"}).count() == 0


def test_units(spark):
    one = spark.range(1)
    value = lambda v, a, b: one.select(U.convert(F.lit(v), a, b)).collect()[0][0]
    assert value(1.0, "bbl", "m^3") == pytest.approx(0.158987294928)
    assert value(1.0, "MMscf", "m^3") == pytest.approx(28316.846592)
    assert value(212.0, "degF", "degC") == pytest.approx(100.0)
    assert value(1.0, "boe", "MMBTU") == pytest.approx(5.8)
    assert value(2.0, "km", "miles") == pytest.approx(1.242742384)
    assert one.select(U.convert(F.lit("12.9"), None, "ft", "number", "integer")).collect()[0][0] == 12
    for bad in (("bbl", "psi"), ("bbl", "furlong")):
        with pytest.raises(ValueError):
            U.unit_step(*bad)


def test_casts(spark):
    rows = [("12.7", "Yes", "2020-02-03", "2020-02-03T04:05:06Z"), ("x", "0", "2020-13-01", "soon"), ("NaN", None, "3/2/2020", None)]
    df = spark.createDataFrame(rows, "n string, b string, d string, t string")
    out = df.select(
        U.cast_typed(F.col("n"), "integer").alias("i"), U.cast_typed(F.col("b"), "boolean").alias("b"),
        U.cast_typed(F.col("d"), "date").cast("string").alias("d"), U.cast_typed(F.col("t"), "datetime").cast("string").alias("t"),
    ).collect()
    assert [tuple(r) for r in out] == [(12, True, "2020-02-03", "2020-02-03 04:05:06"), (None, False, None, None), (None, None, None, None)]


def test_recode_mines_and_options(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, None, 3), (0, 0, 9), (None, None, None)], "u int, w int, g int")
    out = df.select(R.mine_type(F.col("u"), F.col("w")).alias("m"), R.option(F.col("g"), R.FLOOD_GASES).alias("g")).collect()
    assert [tuple(r) for r in out] == [("Integrated with both", "NG"), ("Integrated with upgrader", "CO2"), ("None", None), (None, None)]


def test_map_schema_leaves_absent_inputs_null(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    ops = {"x": (["a"], lambda a: a * 2), "y": (["a", "b"], lambda a, b: a + b), "methods": (["a"], lambda a: {"m1": F.lit(1), "m2": F.lit(0)})}
    row = P.map_schema(df, ops, ["x", "y", "z"]).collect()[0].asDict()
    assert row == {"x": 2.0, "y": None, "z": None, "m1": 1, "m2": 0}


def test_range_rules_ignore_nulls(spark):
    df = spark.createDataFrame([(1, -0.1, 6.0), (2, None, 5.0), (3, 100.0, None)], "id int, f double, s double")
    rules = {"f": (0, 100), "s": (0, 5)}
    assert tuple(P.range_violations(df, rules).collect()[0]) == (1, 1)
    assert [(r["id"], r["violations"]) for r in P.range_rejects(df, rules).collect()] == [(1, ["f", "s"])]


def test_first_rows_and_sizes(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 3, None), (1, 9, "z"), (2, 1, "q")], "k int, seq int, v string")
    assert {tuple(r) for r in G.first_rows(df, ["k"], "seq").collect()} == {(1, 3, None), (2, 1, "q")}
    assert G.group_size_filter(df, ["k"], "single").count() == 1 and G.group_size_filter(df, ["k"], "shared").count() == 3


def test_get_or_create(spark):
    rows = spark.createDataFrame([(1, "A", "BR"), (2, "A", "BR"), (3, "B", "BR"), (4, None, "BR"), (5, None, "BR"), (6, "A", "US"), (7, "", "BR")], "id int, name string, country string")
    known = spark.createDataFrame([("k1", "A", "BR")], "field_code string, name string, country string")
    coded, created = A.get_or_create(rows, known, ["id"], "e1")
    code = {r["id"]: r["field_code"] for r in coded.collect()}
    assert code[1] == code[2] == "k1" and len(set(code.values())) == 6
    assert created.count() == 5
    again, _ = A.get_or_create(rows, known, ["id"], "e1")
    assert {r["id"]: r["field_code"] for r in again.collect()} == code  # a recomputed task gives the same ids


def test_access(spark):
    users = spark.createDataFrame([(1, False), (2, True), (3, None)], "user_id int, is_superuser boolean")
    edges = spark.createDataFrame([(1, 10), (3, 11), (3, 99)], "user_id int, source_id int")
    sources = spark.createDataFrame([(10, "x"), (11, "y")], "source_id int, name string")
    asked = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 11), (4, 10)], "user_id int, source_id int")
    assert {tuple(r) for r in A.has_access(asked, users, edges).collect()} == {(1, 10), (2, 11), (3, 11)}
    assert {r["source_id"] for r in A.sources_of_user(2, users, edges, sources).collect()} == {10, 11}
    assert {r["source_id"] for r in A.sources_of_user(3, users, edges, sources).collect()} == {11}


def test_distribution_counts_rows_beyond_the_axis(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 100, 200)], "k string, v double")
    rows = G.distribution_summary(df, "k", "v", 10.0).collect()
    assert {(r["n_rows"], r["q2"], r["high"]) for r in rows} == {(5, 3.0, 200.0)}
    assert {r["bin"]: r["n"] for r in rows} == {1: 1, 2: 1, 3: 1, 10: 2}
