"""Cells, shapes and spatial joins against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import cells as C
from fieldweave.functions import shapes as S
from fieldweave.operators import cover as V
from fieldweave.operators.spatial_join import point_shape_join, point_shape_pairs, shape_cells, shape_shape_join, shape_union_join
from fieldweave.sources.files import scan_geojson

SHAPE = f"id bigint, shape {S.SHAPE_TYPE}"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def inside(x, y, shape):
    def odd(part):
        hit = False
        for r in part:
            for a, b in zip(r, r[1:]):
                if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                    hit = not hit
        return hit

    return any(odd(p) for p in shape)


def edge_distance(x, y, shape):
    best = math.inf
    for part in shape:
        for r in part:
            for a, b in zip(r, r[1:]):
                dx, dy = b["x"] - a["x"], b["y"] - a["y"]
                n = dx * dx + dy * dy
                t = max(0, min(1, ((x - a["x"]) * dx + (y - a["y"]) * dy) / n)) if n else 0
                best = min(best, math.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy))
    return best


def random_shapes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.choice([1, 1, 2])):
            cx, cy = rng.uniform(0, 6), rng.uniform(0, 6)
            angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.choice([3, 5, 7])))
            shell = ring(*[(cx + rng.uniform(0.5, 1.5) * math.cos(a), cy + rng.uniform(0.5, 1.5) * math.sin(a)) for a in angles])
            parts.append([shell] if rng.random() < 0.6 else [shell, box(cx - 0.1, cy - 0.1, cx + 0.1, cy + 0.1)])
        out.append((i, parts))
    return out


@pytest.mark.parametrize("split", [200000, 6])
@pytest.mark.parametrize("distance", [0.0, 0.2])
def test_point_join_equals_brute_force(spark, split, distance):
    rng = random.Random(5)
    points = [(i, rng.uniform(-1, 7), rng.uniform(-1, 7)) for i in range(120)]
    shapes = random_shapes(25, 9)
    p = spark.createDataFrame(points, "pid bigint, lon double, lat double")
    f = spark.createDataFrame(shapes, SHAPE)
    rows = point_shape_join(p, f, "pid", "left", distance=distance, rows_per_split=split).select("pid", "id").collect()
    want = set()
    for i, x, y in points:
        hits = {(i, k) for k, s in shapes if inside(x, y, s) or (distance and edge_distance(x, y, s) < distance)}
        want |= hits or {(i, None)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def sized_shapes(n, seed):
    """Shapes from a hundredth of a degree to twenty degrees, some of them with holes."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size, x, y = 10 ** rng.uniform(-2, 1.3), rng.uniform(-30, 30), rng.uniform(-30, 30)
        shell = box(x, y, x + size, y + size * rng.uniform(0.2, 1))
        out.append((i, [[shell] if i % 3 else [shell, box(x + size * 0.1, y + size * 0.05, x + size * 0.3, y + size * 0.1)]]))
    return out


@pytest.mark.parametrize("distance,split", [(0.0, 200000), (0.05, 200000), (0.05, 40)])
def test_adaptive_grid_equals_brute_force(spark, distance, split):
    rng = random.Random(3)
    shapes = sized_shapes(150, 4)
    corners = [(v["x"] + rng.uniform(-0.06, 0.06), v["y"] + rng.uniform(-0.06, 0.06)) for _, s in shapes for v in s[0][0][:2]]
    points = list(enumerate([(rng.uniform(-35, 45), rng.uniform(-35, 45)) for _ in range(500)] + corners))
    p = spark.createDataFrame([(i, *at) for i, at in points], "pid bigint, lon double, lat double")
    f = spark.createDataFrame(shapes, SHAPE)
    got = {tuple(r) for r in point_shape_pairs(p, f, "pid", distance=distance, rows_per_split=split).select("pid", "id", "interior").collect()}
    want = set()
    for i, (x, y) in points:
        for k, s in shapes:
            if inside(x, y, s):
                want.add((i, k, True))
            elif distance and edge_distance(x, y, s) < distance:
                want.add((i, k, False))
    assert got == want


def test_adaptive_grid_tests_few_pairs(spark):
    """Points share a cell with little more than the shapes that hold them, and mostly need no walk along the edges."""
    rng = random.Random(6)
    shapes = [s for s in sized_shapes(400, 7) if len(s[1][0]) == 1]
    points = [(i, rng.uniform(-30, 40), rng.uniform(-30, 40)) for i in range(3000)]
    hits = sum(inside(x, y, s) for _, x, y in points for _, s in shapes)
    cells = shape_cells(spark.createDataFrame(shapes, SHAPE), "shape").drop("shape")
    p = spark.createDataFrame(points, "pid bigint, lon double, lat double")
    size = F.lit(64.0) / F.pow(F.lit(2.0), "_lv")
    met = p.join(F.broadcast(cells), (F.floor(F.col("lon") / size) == F.col("_bx")) & (F.floor(F.col("lat") / size) == F.col("_by")))
    b = F.col("_box")
    boxed = F.col("lon").between(b["xmin"], b["xmax"]) & F.col("lat").between(b["ymin"], b["ymax"])
    row = met.agg(F.count(F.lit(1)).alias("met"), F.count(F.when(F.col("_full") | boxed, 1)).alias("kept"), F.count(F.when(~F.col("_full") & boxed, 1)).alias("walked")).first()
    assert row["kept"] <= 1.5 * hits and row["met"] <= 2 * hits and row["walked"] < 0.6 * hits


def test_boundary_points_are_outside(spark):
    f = spark.createDataFrame([(0, [[box(0, 0, 2, 2)]])], SHAPE)
    p = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 2.0), (3, 1.0, 1.0)], "pid bigint, lon double, lat double")
    assert [r["pid"] for r in point_shape_join(p, f, "pid").collect()] == [3]


def test_shape_in_shape(spark):
    outer = [(0, [[box(0, 0, 10, 10), box(4, 4, 6, 6)]])]
    inner = [(1, [[box(1, 1, 2, 2)]]), (2, [[box(3, 3, 7, 7)]]), (3, [[box(9, 9, 11, 11)]]), (4, [[box(0, 0, 1, 1)]]), (5, [[box(4.5, 4.5, 5, 5)]])]
    o = spark.createDataFrame(outer, f"oid bigint, outer_shape {S.SHAPE_TYPE}")
    i = spark.createDataFrame(inner, SHAPE)
    got = {(r["id"], r["oid"]) for r in shape_shape_join(i, o, "id", "left").collect()}
    # 1 is inside, 4 touches the border from inside; 2 spans the hole, 3 crosses the border, 5 lies in the hole
    assert got == {(1, 0), (2, None), (3, None), (4, 0), (5, None)}


def test_shape_in_union_of_parts(spark):
    """Halves with a straight and with a slanted common line, a hole across it, a hole that another part fills."""
    left, right = box(0, 0, 5, 10), box(5, 0, 10, 10)
    slant = [[ring((0, 0), (4.3, 0), (6.1, 10), (0, 10))], [ring((4.3, 0), (10, 0), (10, 10), (6.1, 10))]]
    pierced = [[ring((0, 0), (5, 0), (5, 4), (4, 4), (4, 6), (5, 6), (5, 10), (0, 10))], [ring((5, 0), (10, 0), (10, 10), (5, 10), (5, 6), (6, 6), (6, 4), (5, 4))]]
    filled = [[box(0, 0, 10, 10), box(4, 4, 6, 6)], [box(4, 4, 6, 6)]]
    apart = [[box(0, 0, 4.9, 10)], [right]]
    outer = [(0, [[left], [right]]), (1, slant), (2, pierced), (3, filled), (4, apart)]
    inner = [(1, [[box(3, 3, 7, 7)]]), (2, [[box(4.5, 1, 5.5, 2)]]), (3, [[box(8, 8, 11, 9)]]), (4, [[ring((3, 3), (7.3, 3.1), (5.2, 8.8))]])]
    o = spark.createDataFrame(outer, f"oid bigint, outer_shape {S.SHAPE_TYPE}")
    i = spark.createDataFrame(inner, SHAPE)
    expected = {(a, b) for a in (1, 2, 4) for b in (0, 1, 3)} | {(2, 2)}
    assert {(r["id"], r["oid"]) for r in shape_shape_join(i, o, "id", "inner").collect()} == expected
    parts = o.select("oid", F.explode("outer_shape").alias("part"))
    for bucket in (1.0, 3.0):
        assert {(r["id"], r["oid"]) for r in shape_union_join(i, parts, "id", "oid", bucket_deg=bucket).collect()} == expected


def test_centroids(spark):
    rows = [(0, [[box(0, 0, 2, 2)]]), (1, [[box(0, 0, 4, 4), box(0, 0, 2, 4)]]), (2, [[box(0, 0, 1, 1)], [box(3, 0, 4, 1)]]), (3, [[ring((1, 1))]]), (4, None)]
    got = {r["id"]: r["c"] for r in spark.createDataFrame(rows, SHAPE).select("id", S.centroid(F.col("shape")).alias("c")).collect()}
    assert {k: (round(v["x"], 9), round(v["y"], 9)) for k, v in got.items() if v} == {0: (1, 1), 1: (3, 2), 2: (2, 0.5), 3: (1, 1)}
    assert got[4] is None


def test_wkt_round_trip(spark):
    texts = ["POINT (1.5 -2.0)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.2 5.1, 5.3 5.1, 5.3 5.2, 5.2 5.1)))", "LINESTRING (0 0, 1 1)", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.parse_wkt(F.col("t")).alias("s"))
    rows = df.select("s", S.format_wkt(F.col("s")).alias("w")).collect()
    assert [len(r["s"]) if r["s"] else None for r in rows] == [1, 1, 2, None, None, None]
    assert [[len(p) for p in r["s"]] for r in rows[:3]] == [[1], [2], [1, 2]]
    assert rows[1]["w"] == "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0))"
    assert rows[0]["w"] == "POINT (1.5 -2.0)"


def test_cells(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double").withColumn("cell", C.cell_of_point(F.col("x"), F.col("y"), 0.5))
    near = df.select(F.hypot(F.col("x") - C.cell_center_x(F.col("cell"), 0.5), F.col("y") - C.cell_center_y(F.col("cell"), 0.5)).alias("d"))
    assert near.agg(F.max("d")).collect()[0][0] <= 0.5  # no point is farther from its centre than a corner
    pairs = df.crossJoin(df.limit(20).select(F.col("cell").alias("other")))
    odd = pairs.where(C.cell_distance(F.col("cell"), F.col("other")) != C.cell_distance(F.col("other"), F.col("cell")))
    assert odd.isEmpty()
    for k in (0, 1, 2, 5):
        ring_rows = V.ring(df.limit(1), "id", "cell", k)
        assert ring_rows.count() == 3 * k * (k + 1) + 1
    assert df.select(C.cell_of_point(F.lit(None).cast("double"), F.col("y"))).limit(1).collect()[0][0] is None


def test_cover_equals_brute_force(spark):
    shapes = random_shapes(4, 21)
    df = spark.createDataFrame(shapes, SHAPE)
    edge = 0.11
    got = {(r["id"], r["cell"]["q"], r["cell"]["r"]) for r in V.cover(df, "id", "shape", edge).collect()}
    want = set()
    for i, s in shapes:
        for r in range(-20, 80):
            for q in range(-60, 80):
                x, y = (q + r * 0.5) * edge * math.sqrt(3), r * edge * 1.5
                if inside(x, y, s):
                    want.add((i, q, r))
    assert got == want


def test_cover_of_awkward_shapes(spark):
    """Edges and corners through cell centres, flat edges on a row, holes, parts that overlap or repeat, an open ring."""
    edge = 1.0
    h, w = 1.5, math.sqrt(3.0)
    at = lambda q, r: {"x": (q + r * 0.5) * (edge * w), "y": r * (edge * h)}
    ring = lambda *cells: [at(*c) for c in (*cells, cells[0])]
    block, hole = ring((0, 0), (9, 0), (4, 10), (-5, 10)), ring((1, 2), (5, 2), (3, 6), (-1, 6))
    shifted = [{"x": v["x"] + 0.3, "y": v["y"] + 0.4} for v in block]
    star = ring((0, 0), (4, 3), (9, 0), (4, 5), (4, 10), (1, 5))
    shapes = [
        (1, [[block]]), (2, [[block, hole]]), (3, [[block], [shifted], [block]]), (4, [[shifted, hole], [hole]]), (5, [[star]]),
        (6, [[star[:-1]]]), (7, [[ring((3, 3))]]), (8, [[ring((0, 4), (9, 4))]]), (9, []), (10, None), (11, [[block, block]]),
    ]
    df = spark.createDataFrame(shapes, SHAPE)
    rows = [(r["id"], r["cell"]["q"], r["cell"]["r"]) for r in V.cover(df, "id", "shape", edge).collect()]
    grid = spark.range(-12, 24).select(F.col("id").alias("q")).crossJoin(spark.range(-2, 14).select(F.col("id").alias("r")))
    cell = F.struct("q", "r")
    boxed = df.crossJoin(grid).where(C.cell_center_x(cell, edge) >= S.bounds(F.col("shape"))["xmin"])  # an open ring has no left side
    tested = boxed.where(S.point_in_shape(C.cell_center_x(cell, edge), C.cell_center_y(cell, edge), F.col("shape")))
    assert sorted(rows) == sorted(tuple(r) for r in tested.select("id", "q", "r").collect()) and {r[0] for r in rows} >= {1, 2, 3, 4, 5, 6}


def test_hull(spark):
    rows = [(0, [[ring((0, 0), (2, 0), (1, 0.5), (2, 2), (0, 2), (1, 1))]]), (1, [[ring((1, 1))]]), (2, None)]
    got = {r["id"]: r["h"] for r in spark.createDataFrame(rows, SHAPE).select("id", V.convex_hull(F.col("shape")).alias("h")).collect()}
    assert [(v["x"], v["y"]) for v in got[0][0][0]] == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert got[2] is None


def test_largest_cluster_equals_brute_force(spark):
    rng = random.Random(8)
    shapes = []
    for i in range(6):
        lat0 = rng.choice([-2, 40, 70])
        parts = []
        for _ in range(30):
            x, y = rng.uniform(0, 1.2), lat0 + rng.uniform(0, 0.8)
            parts.append([box(x, y, x + 0.01, y + 0.01)])
        shapes.append((i, parts))
    df = spark.createDataFrame(shapes, SHAPE)
    got = {r["id"]: r for r in V.largest_part_cluster(df, "id", "shape", eps_km=10.0).collect()}

    def km(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    for i, parts in shapes:
        c = [(p[0][0]["x"] + 0.005, p[0][0]["y"] + 0.005) for p in parts]
        label = list(range(len(c)))
        changed = True
        while changed:
            changed = False
            for a in range(len(c)):
                for b in range(len(c)):
                    if label[b] < label[a] and km(c[a], c[b]) <= 10.0:
                        label[a], changed = label[b], True
        groups = {}
        for n, lab in enumerate(label):
            groups.setdefault(lab, []).append(n)
        best = max(groups.values(), key=lambda g: (len(g), -g[0]))
        assert got[i]["n_parts"] == len(best)
        assert [p[0][0]["x"] for p in got[i]["shape"]] == [parts[n][0][0]["x"] for n in best]


def test_dissolved_centroid_counts_overlap_once(spark):
    rows = [(0, [[box(0, 0, 2, 2)]]), (0, [[box(0, 0, 2, 2)]]), (0, [[box(2, 0, 4, 2)]]), (1, None)]
    df = spark.createDataFrame(rows, SHAPE)
    got = V.dissolved_centroids(df, "id", "shape", 0.05).collect()
    assert len(got) == 1 and abs(got[0]["centroid_x"] - 2) < 0.1 and abs(got[0]["centroid_y"] - 1) < 0.1
    assert V.dissolve_parts(df, "id", "shape").count() == 2


def test_geojson_collection(spark, tmp_path):
    feature = lambda kind, coords, **props: {"type": "Feature", "geometry": {"type": kind, "coordinates": coords}, "properties": props}
    ring3 = [[0, 0, 5], [1, 0, 5], [1, 1, 5], [0, 0, 5]]
    features = [
        feature("Polygon", [ring3], name="a", size=3),
        feature("MultiPolygon", [[ring3], [ring3]], name="b"),
        feature("Point", [7, 8], name="c", extra=1),
        {"type": "Feature", "geometry": None, "properties": {"name": "d", "size": 1}},
    ]
    path = tmp_path / "layer.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = {r["name"]: r for r in scan_geojson(spark, str(path)).collect()}
    assert rows["a"].asDict().keys() == {"name", "size", "shape"} and rows["a"]["size"] == "3" and rows["b"]["size"] is None
    assert [len(rows[k]["shape"]) for k in "abc"] == [1, 2, 1] and rows["d"]["shape"] is None
    assert (rows["c"]["shape"][0][0][0]["x"], rows["c"]["shape"][0][0][0]["y"]) == (7.0, 8.0)
