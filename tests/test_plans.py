"""Flare attribution, reports, ingestion and the file stream on small hand-made data."""

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import shapes as S
from fieldweave.functions.quantities import SCF_PER_BCM
from fieldweave.plans import basins, coverage, estimate, flares, golden, ingest, model_inputs, papers
from fieldweave.plans.standardize import OP_TABLES, SourceMeta, metadata_table, prepare_registry, standardize
from fieldweave.sources.files import append_ignore_existing, scan_csv_config, scan_transposed
from fieldweave.streaming.ingest_stream import COMPLETED, FAILED, UploadStore, ingest_stream, retry_failed

FIELD = "field_id bigint, name string, oil_prod double, for_value double, lon double, lat double, half double"


def fields(spark, rows):
    return spark.createDataFrame(rows, FIELD).withColumn("shape", S.rectangle(F.col("lon"), F.col("lat"), F.col("half")))


FLARES = [(1, 0.1, 0.1, 1.0), (2, 5.0, 5.0, 2.0), (3, 1.03, 0.0, 4.0), (4, 50.0, 50.0, 1.0), (5, 9.5, 0.0, 8.0)]
FIELDS = [
    (1, "a", 300.0, 9.0, 0.0, 0.0, 1.0),
    (2, "b", 100.0, None, 0.0, 0.0, 0.5),
    (3, "c", None, None, 5.0, 5.0, 1.0),
    (4, "d", 50.0, 7.0, 20.0, 20.0, 1.0),
    (5, "e", 0.0, None, 9.5, 0.0, 1.0),
    (6, "f", 0.0, None, 9.5, 0.0, 1.0),
]


def test_annual_attribution(spark):
    fl = spark.createDataFrame(FLARES, "id bigint, lon double, lat double, bcm double")
    out, rates = flares.attribute_flares(fl, fields(spark, FIELDS))
    got = {r["field_id"]: (r["flare_bcm"], r["for_value"]) for r in out.collect()}
    scf = lambda bcm, oil: bcm * SCF_PER_BCM / (oil * 365)
    # flare 1 is shared 3:1 by production; 3 only reaches field 1's buffer; 5 lies in two fields without
    # production, whose total of zero gives no weight; field 4 keeps its older value
    assert got[1] == (pytest.approx(4.75), pytest.approx(scf(4.75, 300)))
    assert got[2] == (pytest.approx(0.25), pytest.approx(scf(0.25, 100)))
    assert got[3] == (pytest.approx(2.0), pytest.approx(scf(2.0, 1)))
    assert got[4] == (None, 7.0)
    assert got[5] == (0.0, 0.0) and got[6] == (0.0, 0.0)
    r = rates.collect()[0]
    assert r["initial_rate"] == pytest.approx(11 / 16)
    assert r["final_rate"] == pytest.approx((7.0 + 7.0 * 50 * 365 / SCF_PER_BCM) / 16)
    assert r["unmatched_rate"] == pytest.approx(1 - r["final_rate"])


def test_no_flares_at_all(spark):
    fl = spark.createDataFrame([], "id bigint, lon double, lat double, bcm double")
    out, rates = flares.attribute_flares(fl, fields(spark, FIELDS))
    assert {r["field_id"]: r["for_value"] for r in out.collect()}[1] == 9.0
    assert tuple(rates.collect()[0]) == (0.0, 0.0, 1.0)


def test_monthly_attribution(spark):
    rows = [(1, m, 0.1, 0.1, 1.0) for m in (1, 2)] + [(3, 2, 1.03, 0.0, 4.0)]
    fl = spark.createDataFrame(rows, "id bigint, month int, lon double, lat double, bcm double")
    weights = flares.monthly_weights(fl, fields(spark, FIELDS)).groupBy("id", "month").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1.0) for r in weights)
    out = flares.attribute_flares_monthly(fl, fields(spark, FIELDS))
    got = {(r["field_id"], r["month"]): r["flare_volume"] for r in out.collect()}
    assert len(got) == 72 and got[1, 1] == pytest.approx(0.75) and got[1, 2] == pytest.approx(4.75) and got[2, 2] == pytest.approx(0.25) and got[1, 3] == 0.0


def test_overlap_weights_add_up(spark):
    pairs = spark.createDataFrame([(1, 5.0), (1, 15.0), (2, 7.0), (3, 0.0), (3, 0.0), (4, None), (4, 2.0)], "id bigint, oil_prod double")
    rows = flares.share_of_group(pairs, ["id"], "oil_prod", ["oil_prod"]).collect()
    got = sorted((r["id"], -1 if r["weight"] is None else r["weight"]) for r in rows)
    assert got == [(1, 0.25), (1, 0.75), (2, 1.0), (3, -1), (3, -1), (4, -1), (4, 1.0)]


def test_model_inputs(spark):
    rows = [(1, "oil", 5.0, 0, 2.0, 90.0, 40.0), (2, "oil", 5.0, 3, 30.0, 10.0, None), (3, "gas", 5.0, 1, 30.0, 1.0, 1.0), (4, "oil", 0.0, 1, 30.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, functional_unit string, oil_prod double, num_prod_wells int, api double, for_value double, gor double")
    got = {r["id"]: r for r in model_inputs.prepare_model_inputs(df, "Brazil").collect()}
    assert set(got) == {1, 2}
    assert (got[1]["num_prod_wells"], got[1]["api"], got[1]["for_value"], got[1]["country"]) == (None, None, 40.0, "Brazil")
    assert (got[2]["num_prod_wells"], got[2]["api"], got[2]["for_value"]) == (3, 30.0, 10.0)


def test_impact_curve(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0, 50.0, "Santos"), (2, 30.0, 2.0, 600.0, None)], "entity_id int, production double, ci double, gor double, basin_name string")
    got = {r["entity_id"]: r for r in basins.impact_curve(df).collect()}
    assert (got[2]["start_x"], got[2]["width"], got[2]["gor_class"], got[2]["basin_class"]) == (0.0, 0.75, "yellow", "Others")
    assert (got[1]["start_x"], got[1]["basin_class"], got[1]["average_ci"]) == (0.75, "Santos", pytest.approx(2.75))


def test_estimates(spark):
    rows = [(1, (0, 0), "r", 10.0), (2, (0, 1), "r", None), (3, (90, 90), "r", None), (4, (90, 0), "s", None), (5, (0, 2), "r", 30.0)]
    df = spark.createDataFrame(rows, "id int, cell struct<q:bigint,r:bigint>, region string, oil double")
    got = {r["id"]: (r["oil"], r["oil_origin"]) for r in estimate.estimate_missing(df, "id", "cell", "region", ["oil"], 2).collect()}
    assert got == {1: (10.0, "data"), 2: (20.0, "neighbours"), 3: (20.0, "region"), 4: (None, None), 5: (30.0, "data")}


def test_standardize(spark):
    raw = spark.createDataFrame(
        [("F1", "Tupi Área", "Oil", 5.0, float("nan"), 2.2), ("F2", None, "x", 0.0, 3.0, 0.0)],
        "`Field ID` string, `Field name` string, `Function u` string, `Water In 2` double, `CO₂ Inje` double, `no. Produc` double",
    )
    out = standardize(raw, SourceMeta("reg", "2024"), OP_TABLES["registry"], ["name", "functional_unit", "water_reinjection", "gas_flooding", "num_prod_wells", "api"], order=["Field ID"])
    rows = out.orderBy("field_id").collect()
    assert out.columns[:5] == ["field_id", "name", "cell", "source_id", "source_name"]
    assert [(r["field_id"], r["name"], r["field_name"], r["source_id"], r["functional_unit"], r["water_reinjection"], r["gas_flooding"], r["num_prod_wells"]) for r in rows] == [
        (0, "tupi area", "Tupi Área", "reg2024", "oil", 1, None, 3), (1, None, None, "reg2024", None, 0, None, 0)]
    scores = metadata_table(spark, [SourceMeta("r", "1", reliability=4.5, recency=5, coverage=5), SourceMeta("p", "1", reliability=5, recency=4, coverage=3)])
    assert sorted(round(r["data_score"], 6) for r in scores.collect()) == [4.3, 4.75]


def test_registry_weights_days(spark):
    shapes = spark.createDataFrame([("a", "ÓLEO", "on", 2), ("a", "GÁS", "off", 1), ("b", "ÁGUA", "on", 3)], "name string, fluid string, status string, seq int")
    wells = spark.createDataFrame([("a", 10.0), ("a", 20.0)], "name string, depth double")
    reg = spark.createDataFrame([("a", 30.0, "2001-02-03", "sea", 1)], "name string, api double, start string, location string, seq int")
    moved = spark.createDataFrame([("a", "2021-01", 31.0), ("a", "2021-02", 3.0), ("a", "Total", 99.0)], "name string, period string, oil double")
    row = prepare_registry(shapes, wells, reg, moved, ["oil"]).collect()
    assert len(row) == 1 and row[0]["function_unit"] == "gas" and row[0]["depth"] == 15.0 and row[0]["start_year"] == 2001
    assert row[0]["oil"] == pytest.approx((31 * 31 + 3 * 28) / 59)


def test_versions_equal_separate_merges(spark):
    """Every version in one pass is what merging its own match table gives, hot entity and missing rows included."""
    order = ["s1", "s2", "s3"]
    rows = [(f"e{i % 5 if i < 40 else i}", f"n{i % 7}", order[i % 3], i, float(i % 4), i) for i in range(60)]
    rows += [("e1", "other", "s9", 99, 5.0, 100), ("e2", None, "s2", 100, 9.0, 101)]
    matches = spark.createDataFrame(rows, "entity_id string, name string, source_id string, field_id bigint, score double, seq bigint")
    values = [(order[i % 3], i, i, None if i % 5 == 0 else float(i * 7 % 11), i % 6, None if i % 8 == 0 else "abc"[i % 3]) for i in range(59)]
    sources = spark.createDataFrame([(*v, v[0]) for v in values], "source_id string, field_id bigint, seq bigint, oil double, wells int, kind string, source_name string")
    rules = {"oil": "average", "wells": "median int", "kind": "most frequent"}
    labelled = golden.cumulative_versions(matches, order)
    got = golden.merge_versions(labelled, sources, rules, 2024)
    columns = ["entity_id", "name", "sources_used", *rules]
    for k in (1, 2, 3):
        alone = golden.merge_entities(matches.where(F.col("source_id").isin(order[:k])), sources, rules, 2024)
        want = sorted(map(tuple, alone.select(columns).collect()), key=repr)
        assert sorted(map(tuple, got.where(F.col("version") == k).select(columns).collect()), key=repr) == want
    cells = {r["version"]: r["n_cells"] for r in coverage.richness_by_version(got, ["oil", "kind"]).collect()}
    assert cells == {k: sum(x is not None for r in got.where(F.col("version") == k).select("oil", "kind").collect() for x in r) for k in (1, 2, 3)}
    assert golden.merge_versions(golden.cumulative_versions(matches.limit(0), order), sources, rules, 2024).collect() == []


def test_golden_records_with_shapes(spark):
    matches = spark.createDataFrame([(0, "a", None, "s1", "s", 1, 100.0, 1), (0, "a2", None, "t1", "t", 1, 80.0, 2), (1, "b", None, "s1", "s", 2, 100.0, 3), (1, "b", None, "s1", "s", 77, 70.0, 4)],
        "entity_id bigint, name string, cell struct<q:bigint,r:bigint>, source_id string, source_name string, field_id bigint, score double, seq bigint")
    src = spark.createDataFrame([("s1", "s", 1, 1, 4.0, 0.0), ("s1", "s", 1, 2, 400.0, 0.0), ("t1", "t", 1, 1, 6.0, 2.0), ("s1", "s", 2, 3, None, None)], "source_id string, source_name string, field_id bigint, seq bigint, oil double, x double")
    src = src.withColumn("shape", F.when(F.col("x").isNotNull(), S.rectangle_of_bounds(F.col("x"), F.lit(0.0), F.col("x") + 2.0, F.lit(2.0))))
    got = {r["entity_id"]: r for r in golden.merge_entities(matches, src, {"oil": "average"}, 2024, with_lineage=True, edge_deg=0.05).collect()}
    assert (got[0]["name"], got[0]["sources_used"], got[0]["oil"], len(got[0]["shape"])) == ("a", "s1, t1", 5.0, 2)
    assert got[0]["lineage"] == '{"oil":[{"source_name":"s","field_id":1},{"source_name":"t","field_id":1}]}'
    assert (got[1]["oil"], got[1]["shape"], got[1]["lineage"]) == (None, None, None)


def test_coverage(spark):
    rows = [(1, "a", "a1", 1), (1, "b", "b1", 1), (1, "b", "b1", 2), (2, "a", "a1", 2)]
    m = spark.createDataFrame(rows, "entity_id bigint, source_name string, source_id string, field_id bigint")
    assert {tuple(r) for r in coverage.source_pairs(m).collect()} == {("a", "b", 1, 1), ("b", "a", 1, 0)}
    assert [r["field_id"] for r in coverage.single_source_entities(m).collect()] == [2]


def test_papers(spark):
    sheet = spark.createDataFrame([("name", "Tupi", "Lula"), ("oil_prod", "5", None), ("note", "x", "y")], "attribute string, col1 string, col2 string")
    assert {tuple(r) for r in scan_transposed(sheet, "attribute", ["name", "oil_prod"]).collect()} == {("col1", "Tupi", "5"), ("col2", "Lula", None)}
    table = papers.read_paper(sheet, "attribute", SourceMeta("paper", "2020"), ["name", "oil_prod"])
    assert [(r["field_id"], r["name"], r["oil_prod"]) for r in table.orderBy("field_id").collect()] == [(0, "tupi", 5.0), (1, "lula", None)]


CONFIG = {
    "data_metadata": {
        "name": "n", "type": "csv", "version": "1",
        "attributes": [{"name": "f", "type": "string"}, {"name": "land", "type": "string"}, {"name": "d", "type": "number", "units": "m"}],
    },
    "file_specific": {"csv": {"delimiter": ";", "header_row": 1}},
    "mappings": [
        {"source_attribute": "f", "target_attribute": "name"},
        {"source_attribute": "land", "target_attribute": "country"},
        {"source_attribute": "d", "target_attribute": "depth"},
    ],
}


def test_config_errors():
    def problem(**change):
        config = {**CONFIG, **change}
        with pytest.raises(ingest.ConfigError) as error:
            ingest.EntryConfig.parse(config)
        return str(error.value)

    assert "data_metadata" in problem(data_metadata=None)
    twice = CONFIG["mappings"] + [{"source_attribute": "f", "target_attribute": "age"}]
    assert "'f' is mapped twice" in problem(mappings=twice)
    assert "known type" in problem(data_metadata={**CONFIG["data_metadata"], "attributes": [{"name": "f", "type": "text"}]})
    wrong = ingest.EntryConfig.parse({**CONFIG, "mappings": [{"source_attribute": "f", "target_attribute": "nope"}]})
    assert ingest.check_mappings(wrong) == ["Target attribute 'nope' is not a valid attribute"]


def write(path, text):
    path.write_text(text)


GOOD = "made by hand\nf;land;d\nTupi;BR;100\n\"Lula; Norte\";BR;200\nTupi;BR;x\n;BR;10\n"


def test_csv_config(spark, tmp_path):
    write(tmp_path / "a.csv", GOOD)
    rows = scan_csv_config(spark, str(tmp_path / "a.csv"), None, ";", "utf-8", 1).collect()
    assert [tuple(r) for r in rows] == [("Tupi", "BR", "100"), ("Lula; Norte", "BR", "200"), ("Tupi", "BR", "x"), (None, "BR", "10")]


@pytest.mark.parametrize("header_row", [0, 1])
def test_csv_files_with_other_headers(spark, tmp_path, header_row):
    """Columns meet by name whatever their order; what a file lacks is null; an equal header is one pass."""
    top = "title\n" * header_row
    for name, body in {"x": 'a;b\n1;2\n', "y": 'b;a\n4;3\n"6;";5\n', "z": "a\n7\n", "w": "a;b\n8;9\n"}.items():
        (tmp_path / f"{name}.csv").write_text(top + body)
    got = scan_csv_config(spark, str(tmp_path), None, ";", "utf-8", header_row).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [("1", "2"), ("3", "4"), ("5", "6;"), ("7", None), ("8", "9")]


def test_append_keeps_the_first_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "old", 0)], "k int, v string, seq int").write.parquet(path)
    append_ignore_existing(spark, path, spark.createDataFrame([(1, "x", 1), (2, "late", 3), (2, "first", 2)], "k int, v string, seq int"), ["k"], "seq")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "old", 0), (2, "first", 2)]


def test_csv_encodings(spark, tmp_path):
    for header_row, head in ((0, ""), (1, "title\n")):
        path = tmp_path / f"latin{header_row}.csv"
        path.write_bytes((head + "nome|área\nGarça|3\n").encode("latin-1"))
        out = scan_csv_config(spark, str(path), None, "|", "latin-1", header_row)
        assert out.columns == ["nome", "área"] and [tuple(r) for r in out.collect()] == [("Garça", "3")]


def test_ingest(spark, tmp_path):
    write(tmp_path / "a.csv", GOOD)
    nobody = spark.createDataFrame([("k", "Tupi", "BR")], "field_code string, name string, country string")
    created, data, rejects = ingest.ingest_file(spark, str(tmp_path / "a.csv"), CONFIG, "2024-01-02", 5, nobody)
    rows = sorted(((r["name"] or "", round(r["depth"], 3), r["field_code"] == "k") for r in data.collect()))
    assert rows == [("", 32.808, False), ("Lula; Norte", 656.168, False), ("Tupi", 328.084, True)]
    assert created.count() == 2 and [r["faults"] for r in rejects.collect()] == ["depth"]
    with pytest.raises(ingest.ConfigError, match="Missing source attributes in data: land"):
        ingest.ingest(spark.createDataFrame([("a", "1")], "f string, d string"), CONFIG, "2024-01-02", 5, nobody, ["f"])


def test_upload_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox / "a.csv", GOOD)
    write(inbox / "b.csv", "title\nwrong;head\n1;2\n")
    write(inbox / "c.txt", "whatever")
    store = UploadStore(spark, str(tmp_path / "store"))
    run = lambda: ingest_stream(spark, str(inbox), store, CONFIG, "2024-01-02", str(tmp_path / "state")).awaitTermination()
    run()
    status = {r["path"].rsplit("/", 1)[1]: r for r in store.status().collect()}
    assert {k: v["status"] for k, v in status.items()} == {"a.csv": COMPLETED, "b.csv": FAILED, "c.txt": FAILED}
    assert status["a.csv"]["n_rejected"] == 1 and [r["faults"] for r in store.rejects().collect()] == ["depth"]
    assert status["a.csv"]["n_rows"] == 3 and "Missing source attributes" in status["b.csv"]["error_message"]
    assert "Unsupported file extension: txt" in status["c.txt"]["error_message"]
    write(inbox / "copy-of-a.csv", GOOD)
    write(inbox / "d.csv", GOOD.replace("Tupi", "Iara"))
    run()
    assert store.fields().count() == 6 and store.identities().where("name = 'Tupi'").count() == 1
    write(inbox / "b.csv", GOOD.replace("Tupi", "Sapo"))
    retry_failed(store, str(inbox), CONFIG, "2024-01-02")
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in store.status().collect()}
    assert status["b.csv"] == COMPLETED and status["c.txt"] == FAILED


def test_stream_keeps_line_breaks_in_quotes(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox / "a.csv", "made\nf;land;d\n\"Tupi\nSul\";BR;100\n\nIara;BR;x\n")
    store = UploadStore(spark, str(tmp_path / "store"))
    ingest_stream(spark, str(inbox), store, CONFIG, "2024-01-02", str(tmp_path / "state")).awaitTermination()
    assert [r["name"] for r in store.fields().where("depth is not null").collect()] == ["Tupi\nSul"]
    assert [r["line_no"] for r in store.rejects().collect()] == [3]


def test_interrupted_batch_leaves_nothing_twice(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox / "a.csv", GOOD)
    for failing in ("fields", "rejects", "identities", "status"):
        store = UploadStore(spark, str(tmp_path / f"store-{failing}"))
        write_table, calls = store.write, []

        def broken(df, name, part, write_table=write_table, calls=calls, failing=failing):
            calls.append(name)
            if name == failing and calls.count("status") == (2 if failing == "status" else 1):
                raise OSError("lost")
            write_table(df, name, part)

        run = lambda store=store, failing=failing: ingest_stream(spark, str(inbox), store, CONFIG, "2024-01-02", str(tmp_path / f"state-{failing}")).awaitTermination()
        store.write = broken
        with pytest.raises(Exception, match="lost"):
            run()
        store.write = write_table
        run()
        assert store.fields().count() == 3 and store.rejects().count() == 1
        assert [(r["status"], r["n_rows"], r["n_rejected"]) for r in store.status().collect()] == [(COMPLETED, 3, 1)]


def test_missing_words_are_no_values(spark):
    nobody = spark.createDataFrame([], "field_code string, name string, country string")
    raw = spark.createDataFrame([(1, "a", "BR", "N/A"), (2, "b", "NA", "NaN"), (3, "c", "BR", "7")], "k int, f string, land string, d string")
    _, data, rejects = ingest.ingest(raw, CONFIG, "2024-01-02", 5, nobody, ["k"])
    assert rejects.count() == 0
    assert {(r["name"], r["country"], r["depth"] is None) for r in data.collect()} == {("a", "BR", True), ("b", None, True), ("c", "BR", False)}


def test_flares_count_where_they_were(spark):
    flares_in = spark.createDataFrame([(1, 1, 0.5, 0.5, 2.0), (1, 2, 5.5, 0.5, 3.0)], "id int, month int, lon double, lat double, bcm double")
    two = fields(spark, [(1, "west", 1.0, None, 0.5, 0.5, 0.5), (2, "east", 1.0, None, 5.5, 0.5, 0.5)])
    out = flares.attribute_flares_monthly(flares_in, two)
    assert {(r["name"], r["month"]): r["flare_volume"] for r in out.collect() if r["flare_volume"]} == {("west", 1): 2.0, ("east", 2): 3.0}


def test_match_order_beyond_forty_bits(spark):
    from fieldweave.plans.matching import match_version, seed_matches

    big = (1 << 40) + 5
    rows = spark.createDataFrame([("s", "s", 1, big, "Tupi", (0, 0))], "source_id string, source_name string, field_id bigint, seq bigint, name string, cell struct<q:bigint,r:bigint>")
    assert match_version(seed_matches(rows), 1).count() == 1
