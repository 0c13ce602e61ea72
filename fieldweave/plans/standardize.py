"""Raw source -> source info table in the target schema."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions import cells as C
from fieldweave.functions import quantities as Q
from fieldweave.functions import shapes as S
from fieldweave.functions import text as X
from fieldweave.functions.recode import FLOOD_GASES, option
from fieldweave.functions.schema import target_schema
from fieldweave.operators.aggregates import first_rows, time_weighted_means
from fieldweave.operators.projection import OpTable, filter_recode, mapped_columns, row_counter_id

_keep = lambda value: value


@dataclass(frozen=True)
class SourceMeta:
    """What is known about a source; scores run from 0 to 5."""

    name: str
    time: str
    explain: str = ""
    url: str = ""
    kind: str = ""
    reliability: float = 0.0
    recency: float = 0.0
    coverage: float = 0.0

    @property
    def source_id(self) -> str:
        return f"{self.name}{self.time}"


def metadata_table(spark: SparkSession, sources: Sequence[SourceMeta]) -> DataFrame:
    rows = [(s.source_id, s.name, s.explain, s.url, s.kind, s.time, float(s.reliability), float(s.recency), float(s.coverage)) for s in sources]
    schema = "source_id string, name string, name_explain string, url string, type string, time string, reliability double, recency double, coverage double"
    table = spark.createDataFrame(rows, schema)
    return table.withColumn("data_score", Q.source_score(F.col("reliability"), F.col("recency"), F.col("coverage")))


def _methods(*columns: Column) -> dict[str, Column]:
    return X.multi_hot_methods(columns)


def _gas_flood_ratio(natural: Column, carbon: Column, nitrogen: Column, oil: Column) -> Column:
    return Q.gas_flood_ratio([natural, carbon, nitrogen], oil)


#: Functions a layout may name; the arguments are its input columns in order.
LAYOUT_FUNCTIONS = {
    "keep": _keep,
    "methods": _methods,
    "location_flag": lambda c: X.offshore_flag(c, X.LOCATION_WORDS),
    "unit_from_portuguese": lambda c: X.unit_from_text(c, X.UNIT_WORDS_PT),
    "gas_flood_ratio": _gas_flood_ratio,
    "as_text": lambda value: value.cast("string"),
    "dominant_gas": lambda natural, carbon, nitrogen: option(Q.dominant_gas_code(natural, nitrogen, carbon), FLOOD_GASES),
    **{f.__name__: f for f in (X.unit_from_text, X.offshore_flag, X.year_from_text)},
    **{f.__name__: f for f in (Q.feet_from_metres, Q.barrels_from_thousands, Q.percent_from_ppm, Q.ceil_count)},
    **{f.__name__: f for f in (Q.positive_flag, Q.positive_flag2, Q.remaining_gas_fraction, Q.reinjected_water_fraction)},
    **{f.__name__: f for f in (Q.gas_oil_ratio, Q.water_oil_ratio, Q.water_injection_ratio, Q.gas_lift_ratio, Q.steam_oil_ratio)},
}


def load_layouts(path: str = os.path.join(os.path.dirname(__file__), "source_layouts.json")) -> dict[str, OpTable]:
    """Source layouts of a JSON file: per source a list of target, input columns and the name of a function."""
    with open(path, encoding="utf-8") as f:
        layouts = {name: rows for name, rows in json.load(f).items() if isinstance(rows, list)}
    return {name: {r["target"]: (r["columns"], LAYOUT_FUNCTIONS[r["function"]]) for r in rows} for name, rows in layouts.items()}


OP_TABLES = load_layouts()


def standardize(
    df: DataFrame,
    source: SourceMeta,
    ops: OpTable,
    targets: Sequence[str],
    edge_deg: float = C.DEFAULT_EDGE,
    order: Sequence[str] | None = None,
    field_id: str | None = None,
) -> DataFrame:
    """Map one raw source; identity columns first, then the targets, in the types of the target schema.

    A value that the declared type cannot hold is missing; names the schema does not know keep their type.
    ``field_id`` names a ready key of the input; without one, rows are numbered from 0 in ``order``. The cell
    comes from ``shape`` (its centroid) or from ``lon`` / ``lat`` where the input has them.
    """
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    df = df.withColumns({c: Q.clean_double(F.col(f"`{c}`")) for c in doubles}) if doubles else df
    if field_id is None:
        if not order:
            raise ValueError("give either field_id or the order in which to number the rows")
        df, field_id = row_counter_id(df, order, "_field_id"), "_field_id"
    if "shape" in df.columns:
        df = df.withColumn("_center", S.centroid(F.col("shape")))
        cell, shape = C.cell_of_point(F.col("_center.x"), F.col("_center.y"), edge_deg), F.col("shape")
    elif {"lon", "lat"} <= set(df.columns):
        cell, shape = C.cell_of_point(F.col("lon"), F.col("lat"), edge_deg), F.lit(None).cast(S.SHAPE_TYPE)
    else:
        cell, shape = F.lit(None).cast(C.CELL_TYPE), F.lit(None).cast(S.SHAPE_TYPE)
    columns = mapped_columns(df, ops, targets)
    frame = df.select(
        F.col(f"`{field_id}`").cast("bigint").alias("field_id"),
        cell.alias("cell"),
        F.lit(source.source_id).alias("source_id"),
        F.lit(source.name).alias("source_name"),
        shape.alias("shape"),
        *columns,
    )
    kinds = {f.name: f.dataType for f in target_schema().fields if f.name in frame.columns}
    frame = frame.withColumns({n: F.col(n).try_cast(t) for n, t in kinds.items()})
    raw = F.col("name")
    name = F.when(raw == "", F.lit(None)).otherwise(X.normalize_name(raw))
    front = ["field_id", "name", "cell", "source_id", "source_name"]
    frame = frame.withColumns({"field_name": raw, "name": name})
    return frame.select(*front, *[c for c in frame.columns if c not in front])


def standardize_all(
    inputs: Sequence[tuple[DataFrame, SourceMeta, str]], targets: Sequence[str], field_id: str, layouts: Mapping[str, OpTable] | None = None, edge_deg: float = C.DEFAULT_EDGE
) -> DataFrame:
    """All sources in one table: each ``(rows, source, layout)`` standardized, targets a layout lacks null."""
    layouts = OP_TABLES if layouts is None else layouts
    tables = [standardize(rows, source, layouts[layout], targets, edge_deg, field_id=field_id) for rows, source, layout in inputs]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


# Fluid words of the shape registry (fixed values).
FLUID_WORDS = {"ÓLEO": "oil", "GÁS": "gas"}


def prepare_registry(
    shapes: DataFrame, wells: DataFrame, registration: DataFrame, movement: DataFrame, measures: Sequence[str], codes: Mapping[str, str] = FLUID_WORDS
) -> DataFrame:
    """Field shapes with mean depth, registration and day-weighted movement; first row per field name.

    ``shapes``: ``name, fluid, status, shape, seq``; ``wells``: ``name, depth``; ``registration``:
    ``name, api, start, location``; ``movement``: ``name, period`` and the measures.
    """
    base = first_rows(filter_recode(shapes, "fluid", codes), ["name"], "seq")
    depth = wells.groupBy("name").agg(F.avg("depth").alias("depth"))
    registered = first_rows(
        registration.select("name", "api", F.year(F.to_date("start")).alias("start_year"), "location", F.col("seq").alias("_rseq")), ["name"], "_rseq"
    ).drop("_rseq")
    flows = time_weighted_means(movement, "name", "period", measures)
    out = base.join(depth, "name", "left").join(registered, "name", "left").join(flows, "name", "left")
    return out.withColumnRenamed("fluid", "function_unit")
