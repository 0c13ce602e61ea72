"""Point-in-shape and shape-in-shape joins over a grid of buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import shapes as S
from fieldweave.operators.skew import ROWS_PER_SPLIT, salted_join, shuffle_partitions
from fieldweave.session import freeze


def _bucket(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def _shape_buckets(df: DataFrame, shape: str, size: float, grow: float) -> DataFrame:
    """One row per bucket that the (grown) bounding box touches."""
    b = F.col("_box")
    g = F.lit(grow)
    return (
        df.where(F.col(shape).isNotNull())
        .withColumn("_box", S.bounds(F.col(shape)))
        .withColumn("_bx", F.explode(F.sequence(_bucket(b["xmin"] - g, size), _bucket(b["xmax"] + g, size))))
        .withColumn("_by", F.explode(F.sequence(_bucket(b["ymin"] - g, size), _bucket(b["ymax"] + g, size))))
    )


def _in_box(x: Column, y: Column, box: Column, grow: float) -> Column:
    g = F.lit(grow)
    return (x >= box["xmin"] - g) & (x <= box["xmax"] + g) & (y >= box["ymin"] - g) & (y <= box["ymax"] + g)


# The adaptive grid: cells of BASE_DEG / 2 ** level degrees, and how many of them a shape may measure in width or height.
BASE_DEG = 64.0
MAX_LEVEL = 24
SPAN = 8
_MARGIN = 1e-9


def _level_of(extent: Column) -> Column:
    """The finest level at which a shape of this extent measures no more than ``SPAN`` cells."""
    fits = F.floor(F.log2(F.lit(BASE_DEG * SPAN) / extent))
    return F.when(extent > 0, F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), fits))).otherwise(F.lit(MAX_LEVEL)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    # a power of two: the product is exact
    return F.floor(value * F.pow(F.lit(2.0), level) / F.lit(BASE_DEG)).cast("bigint")


def shape_cells(df: DataFrame, shape: str, distance: float = 0.0) -> DataFrame:
    """``df`` with one row per grid cell that holds points of the shape or nearer to it than ``distance``.

    A shape is posted at the level of its own size (``_lv``, ``_bx``, ``_by``), so a small one among large ones has small
    cells. ``_full`` marks cells that lie wholly inside: their points need no further test, so only the other cells
    carry the shape to be walked (``_walk``). Cells that lie wholly outside are left out.
    """
    b = F.col("_box")
    # few shapes make many cells: they are spread before their cells are made
    spread_out = df.where(F.col(shape).isNotNull()).repartition(shuffle_partitions(df))
    grown = spread_out.withColumn("_box", S.bounds(F.col(shape)))
    grown = grown.withColumn("_lv", _level_of(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) + 2 * distance))
    spread = lambda low, high: F.explode(F.sequence(_cell(low - distance, F.col("_lv")), _cell(high + distance, F.col("_lv"))))
    cells = grown.withColumn("_bx", spread(b["xmin"], b["xmax"])).withColumn("_by", spread(b["ymin"], b["ymax"]))
    size = F.lit(BASE_DEG) / F.pow(F.lit(2.0), F.col("_lv"))
    x, y = (F.col("_bx") + 0.5) * size, (F.col("_by") + 0.5) * size
    cells = cells.withColumn("_far", S.edge_distance(x, y, F.col(shape)) - size * math.sqrt(0.5) - _MARGIN).withColumn("_in", S.point_in_shape(x, y, F.col(shape)))
    # no edge passes a cell whose middle is farther from all edges than its corners are: all of it is in, or out
    cells = cells.where(F.col("_in") | F.coalesce(F.col("_far") < distance, F.lit(True)))
    cells = cells.withColumn("_full", F.col("_in") & F.coalesce(F.col("_far") > 0, F.lit(False)))
    return cells.withColumn("_walk", F.when(~F.col("_full"), F.col(shape))).drop("_far", "_in")


def _numbered_shapes(fields: DataFrame, shape: str) -> tuple[DataFrame, DataFrame]:
    """The distinct shapes, stored, with a number (``_sid``) and how many rows have them (``_n``), and ``fields`` with the
    number of their shape."""
    shapes = fields.where(F.col(shape).isNotNull()).groupBy(F.col(shape).alias("_shape")).agg(F.count(F.lit(1)).alias("_n"))
    shapes = freeze(shapes.withColumn("_sid", F.monotonically_increasing_id()), "shapes")
    return shapes, fields.join(shapes.select("_shape", "_sid"), F.col(shape) == F.col("_shape")).drop("_shape")


def place_shape_hits(places: DataFrame, shapes: DataFrame, x: str, y: str, distance: float, rows_per_split: int, place_bound: int | None) -> DataFrame:
    """``x, y, _sid, interior`` of distinct positions and distinct shapes: which shape strictly contains a position or is
    nearer to it than ``distance``.

    A position looks up one cell per level in use, at most ``MAX_LEVEL + 1``; a pair is met once. Crowded cells are split on
    both sides. The cells are stored once; their levels and number are known before the join.
    """
    cells = freeze(shape_cells(shapes.select("_sid", "_shape"), "_shape", distance).drop("_shape"), "cells")
    levels = {r["_lv"]: r["n"] for r in cells.groupBy("_lv").agg(F.count(F.lit(1)).alias("n")).collect()}
    px, py, s = F.col(x), F.col(y), F.col("_walk")
    probes = F.array(*[F.lit(v) for v in sorted(levels)]).cast("array<int>")
    left = places.withColumn("_lv", F.explode(probes)).withColumn("_bx", _cell(px, F.col("_lv"))).withColumn("_by", _cell(py, F.col("_lv")))
    boxed = F.col("_full") | _in_box(px, py, F.col("_box"), distance)
    met = salted_join(
        left, cells, ["_lv", "_bx", "_by"], [x, y], ["_sid"], "inner", boxed, rows_per_split, heavy=True,
        left_bound=place_bound, right_bound=sum(levels.values()),
    )
    met = met.withColumn("interior", F.col("_full") | S.point_in_shape(px, py, s))
    if distance:
        met = met.where(F.col("interior") | F.coalesce(F.when(~F.col("interior"), S.edge_distance(px, py, s) < F.lit(distance)), F.lit(False)))
    else:
        met = met.where("interior")
    return met.select(x, y, "_sid", "interior")


def point_shape_pairs(
    points: DataFrame,
    fields: DataFrame,
    point_id: str | Sequence[str],
    x: str = "lon",
    y: str = "lat",
    shape: str = "shape",
    distance: float = 0.0,
    rows_per_split: int = ROWS_PER_SPLIT,
    how: str = "inner",
) -> DataFrame:
    """Points with the shapes that strictly contain them or are nearer than ``distance``, and whether they contain them
    (``interior``).

    Positions that several points share are tested once, and so are shapes that several rows share; what lies where is
    then brought to the points by their position. ``points`` should be stored, it is read twice. ``left`` keeps points
    near no shape, ``left_anti`` keeps only these. Positions shared by more points than a task may hold are split.
    """
    ids = [point_id] if isinstance(point_id, str) else list(point_id)
    places = freeze(points.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n")), "places")
    most = places.agg(F.count(F.lit(1)).alias("places"), F.max("_n").alias("points")).first()
    shapes, keyed = _numbered_shapes(fields, shape)
    located = places.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    hits = place_shape_hits(located, shapes, x, y, distance, rows_per_split, most["places"])
    if how == "left_anti":
        around = hits.select(x, y).distinct()
        return salted_join(points, around, [x, y], ids, None, how, None, rows_per_split, null_safe=True, left_bound=most["points"] or 0)
    around = hits.join(keyed, "_sid").drop("_sid")
    hashable = [c for c, t in fields.dtypes if not t.startswith("map")]
    bound = shapes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    # few points may make many pairs: the left side keeps all its partitions
    return salted_join(
        points, around, [x, y], ids, hashable, how, None, rows_per_split, null_safe=True, heavy=True,
        left_bound=most["points"] or 0, right_bound=bound,
    )


def point_shape_join(
    points: DataFrame,
    fields: DataFrame,
    point_id: str | Sequence[str],
    how: str = "inner",
    x: str = "lon",
    y: str = "lat",
    shape: str = "shape",
    distance: float = 0.0,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Points with the shapes strictly containing them (``distance`` > 0: containing, or nearer than that), over the
    adaptive grid.

    The points are stored. ``left`` keeps points near no shape, ``left_anti`` returns only these, with their own columns.
    Columns of ``fields`` must not repeat names of ``points``.
    """
    if how not in ("inner", "left", "left_anti"):
        raise ValueError(f"how must be 'inner', 'left' or 'left_anti', not {how!r}")
    points = freeze(points, "points")
    return point_shape_pairs(points, fields, point_id, x, y, shape, distance, rows_per_split, how).drop("interior")


def shape_shape_join(
    inner: DataFrame,
    outer: DataFrame,
    inner_id: str,
    how: str = "left",
    inner_shape: str = "shape",
    outer_shape: str = "outer_shape",
    bucket_deg: float = 1.0,
    rows_per_split: int = ROWS_PER_SPLIT,
    inner_bound: int | None = None,
) -> DataFrame:
    """Shapes with the shapes that wholly contain them.

    A contained shape has its lower-left box corner inside the container's box, so the corner's bucket is
    the only one to probe.
    """
    box = S.bounds(F.col(inner_shape))
    left = (
        inner.withColumn("_ibox", box)
        .withColumn("_bx", _bucket(F.col("_ibox")["xmin"], bucket_deg))
        .withColumn("_by", _bucket(F.col("_ibox")["ymin"], bucket_deg))
    )
    right = _shape_buckets(outer, outer_shape, bucket_deg, 0.0)
    i, o = F.col("_ibox"), F.col("_box")
    boxed = (i["xmin"] >= o["xmin"]) & (i["ymin"] >= o["ymin"]) & (i["xmax"] <= o["xmax"]) & (i["ymax"] <= o["ymax"])
    hit = boxed & S.shape_in_shape(F.col(inner_shape), F.col(outer_shape))
    joined = salted_join(left, right, ["_bx", "_by"], [inner_id], None, how, hit, rows_per_split, left_bound=inner_bound, heavy=True)
    return joined.drop("_bx", "_by", "_box", "_ibox")


def shape_union_join(
    inner: DataFrame,
    parts: DataFrame,
    inner_id: str,
    key: str,
    inner_shape: str = "shape",
    part: str = "part",
    bucket_deg: float = 1.0,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Pairs ``inner_id``, ``key`` where the union of all parts of the key contains the shape.

    Only the parts whose box meets the shape's box come together for a pair, so an outline of very many parts
    never stands in one row. A pair meets in the bucket of the lower left corner that their boxes share, once.
    """
    left = _shape_buckets(inner.select(inner_id, inner_shape), inner_shape, bucket_deg, 0.0).withColumnRenamed("_box", "_ibox")
    right = _shape_buckets(parts.select(key, F.array(part).alias("_part")), "_part", bucket_deg, 0.0)
    i, o = F.col("_ibox"), F.col("_box")
    meet = (i["xmin"] <= o["xmax"]) & (o["xmin"] <= i["xmax"]) & (i["ymin"] <= o["ymax"]) & (o["ymin"] <= i["ymax"])
    here = (_bucket(F.greatest(i["xmin"], o["xmin"]), bucket_deg) == F.col("_bx")) & (_bucket(F.greatest(i["ymin"], o["ymin"]), bucket_deg) == F.col("_by"))
    met = salted_join(left, right, ["_bx", "_by"], [inner_id], None, "inner", meet & here, rows_per_split, heavy=True)
    gathered = met.groupBy(inner_id, key).agg(F.first(inner_shape).alias("_inner"), F.flatten(F.collect_set("_part")).alias("_outer"))
    return gathered.where(S.shape_in_shape(F.col("_inner"), F.col("_outer"))).select(inner_id, key)
