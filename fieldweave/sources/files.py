"""CSV, GeoJSON, transposed sheets and keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.functions import cells as C
from fieldweave.functions import shapes as S
from fieldweave.sources import csv_records as R


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def scan_csv_config(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, delimiter: str = ",", encoding: str = "utf-8", header_row: int = 0
) -> DataFrame:
    """CSV as text columns by configured delimiter, encoding and number of the header record.

    Without ``columns`` every file is read by its own header and columns meet by name, whatever the number of layouts:
    files may order them differently, and a column that a file lacks is null there. Fields in quotes may hold line breaks.
    Files are read in splits. Where all share one header on top and no quote spans lines, the built-in reader does.
    """
    lines = R.file_lines(spark, path, encoding)
    blocks = R.line_blocks(lines, delimiter)
    if header_row == 0 and blocks.where("_opens = 1").isEmpty():
        reader = spark.read.option("sep", delimiter).option("encoding", R.charset(encoding)).option("escape", '"').option("quote", '"')
        if columns is not None:
            return reader.schema(_declared(columns)).csv(path, header=True)
        tops = lines.where("_block = 0").groupBy("_file").agg(F.min_by("value", "_n").alias("header"))
        if len(tops.select("header").distinct().limit(2).collect()) < 2:
            return reader.csv(path, header=True)
    headers, body = R.records(lines, blocks, delimiter, header_row)
    if columns is not None:
        parsed = F.from_csv("record", F.lit(_declared(columns)), R.csv_options(delimiter))
        return body.select(parsed.alias("_r")).select("_r.*")
    if headers.isEmpty():
        raise ValueError(f"no header line in {path}")
    width = R.header_width(headers, delimiter)
    return R.columns_of(body, R.header_names(headers, width, delimiter), width, delimiter)


def _declared(names: Sequence[str]) -> str:
    return ", ".join("`" + c.replace("`", "``") + "` string" for c in names)


def scan_projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


_POINT = "array<double>"
_RINGS = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def _shape_of_geojson(geometry: Column) -> Column:
    """Shape of a GeoJSON geometry text; 3-D positions lose their height."""

    def coords(kind: str) -> Column:
        return F.get_json_object(geometry, "$.coordinates") if kind == "" else F.from_json(F.get_json_object(geometry, "$.coordinates"), kind)

    position = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    rings = lambda part: F.transform(part, lambda ring: F.transform(ring, position))
    kind = F.get_json_object(geometry, "$.type")
    point = F.array(F.array(F.array(position(coords(_POINT)))))
    return (
        F.when(kind == "MultiPolygon", F.transform(coords(_MULTI), rings))
        .when(kind == "Polygon", F.array(rings(coords(_RINGS))))
        .when(kind == "Point", point)
    )


def scan_geojson(spark: SparkSession, path: str, attributes: Sequence[str] | None = None, layout: str = "collection") -> DataFrame:
    """One row per feature: attribute texts and ``shape``.

    ``collection`` files hold one FeatureCollection each and are read whole; ``lines`` files hold one feature
    per line and are split. Without ``attributes`` the property keys of the first feature count.
    """
    if layout == "lines":
        features = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("_f"))
    else:
        text = spark.read.text(path, wholetext=True)
        items = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
        features = text.select(F.explode(items).alias("_f"))
    props = F.get_json_object("_f", "$.properties")
    if attributes is None:
        first = features.select(F.json_object_keys(props).alias("k")).limit(1).collect()
        attributes = first[0]["k"] if first else []
    values = F.from_json(props, "map<string,string>")
    return features.select(
        *[F.try_element_at(values, F.lit(a)).alias(a) for a in attributes],
        _shape_of_geojson(F.get_json_object("_f", "$.geometry")).alias("shape"),
    )


def scan_transposed(sheet: DataFrame, name_col: str, attributes: Sequence[str], out_id: str = "field_id") -> DataFrame:
    """One row per field from a sheet with one column per field and the attribute name in ``name_col``."""
    fields = [c for c in sheet.columns if c != name_col]
    long = sheet.where(F.col(name_col).isin(*attributes)).unpivot([name_col], fields, out_id, "_value")
    picks = [F.max(F.when(F.col(name_col) == a, F.col("_value"))).alias(a) for a in attributes]
    return long.groupBy(out_id).agg(*picks)


def scan_result_rows(
    sheet: DataFrame, attributes: Mapping[int, str], row_col: str = "row", first_column: int = 1, out_id: str = "column"
) -> DataFrame:
    """One row per column of a result sheet whose rows are known by position only.

    ``sheet`` has the row number in ``row_col`` and the cells in its other columns, counted from 1 in their order; columns
    before ``first_column`` hold labels. ``attributes`` names the rows wanted. Output: the column's number as ``out_id``
    and one text column per attribute, null where a cell or a row is missing; columns without a value in any are left out.
    """
    cells = [c for c in sheet.columns if c != row_col]
    numbered = sheet.where(F.col(row_col).isin(*attributes)).select(
        F.col(row_col).alias("_row"), *[F.col(f"`{c}`").cast("string").alias(str(i)) for i, c in enumerate(cells, start=1) if i >= first_column]
    )
    long = numbered.unpivot(["_row"], numbered.columns[1:], out_id, "_value").where(F.col("_value").isNotNull())
    picks = [F.max(F.when(F.col("_row") == row, F.col("_value"))).alias(name) for row, name in attributes.items()]
    return long.groupBy(F.col(out_id).cast("int").alias(out_id)).agg(*picks)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"')


def _feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def cell_features(df: DataFrame, cell_col: str, properties: Sequence[str], edge_deg: float = C.DEFAULT_EDGE) -> DataFrame:
    """One Feature line per cell: its hexagon and numeric properties."""
    ring = F.transform(C.cell_boundary(F.col(cell_col), edge_deg), lambda v: F.array(v["x"], v["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return df.select(_feature(geometry, F.struct(*[F.col(p).cast("double").alias(p) for p in properties])).alias("value"))


def point_features(df: DataFrame, x: str, y: str, properties: Sequence[str]) -> DataFrame:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return df.select(_feature(geometry, F.struct(*properties)).alias("value"))


def shape_features(df: DataFrame, shape_col: str, properties: Sequence[str]) -> DataFrame:
    coords = F.transform(F.col(shape_col), lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))
    return df.select(_feature(geometry, F.struct(*properties)).alias("value"))


def write_lines(features: DataFrame, path: str) -> None:
    """Feature lines, one file per task."""
    features.select("value").write.text(path)


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Each key once. Without partition columns every file holds a range of keys, so key ranges prune."""
    unique = df.dropDuplicates(list(keys))
    if partition_by:
        unique.write.partitionBy(*partition_by).parquet(path)
    else:
        unique.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def append_ignore_existing(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], order: str | None = None) -> None:
    """Append the rows whose key the table at ``path`` does not hold; of rows with one key the first by ``order``
    (without one the smallest by contents)."""
    target = spark.read.schema(incoming.schema).parquet(path)
    others = [c for c in incoming.columns if c not in keys]
    rank = F.struct(*([order] if order else []), *others) if others else F.lit(0)
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*incoming.columns), rank).alias("_row")).select("_row.*")
    first.join(target.select(*keys), list(keys), "left_anti").write.mode("append").parquet(path)


def quality_gate_split(df: DataFrame, score_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows to merge, rows to keep aside as JSON text)."""
    good = F.coalesce(F.col(score_col) >= threshold, F.lit(False))
    kept = df.where(~good)
    return df.where(good), kept.select("source_id", F.to_json(F.struct(*[c for c in kept.columns])).alias("value"))


def latest_rows(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("_row")).select(*keys, "_row.*")
