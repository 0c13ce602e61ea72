"""Views of the test tables that play the roles of field, flare, source and movement inputs.

Each view is one SQL text that Spark and the SQL check read alike; only the month format differs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions import cells as C
from fieldweave.functions import shapes as S
from fieldweave.plans.matching import match_all_sources

FIELD = """
SELECT s.s_suppkey AS field_id, p.p_name AS name, n.n_name AS country,
       CASE WHEN s.s_suppkey % 3 = 0 THEN 'gas' ELSE 'oil' END AS function_unit,
       CASE WHEN s.s_suppkey % 10 = 0 THEN NULL ELSE s.s_acctbal END AS oil_prod,
       CAST(p.p_size AS DOUBLE) * 20 AS gor,
       s.s_suppkey % 2 AS offshore,
       -60 + ((s.s_suppkey * 7919) % 1000) / 1e2 AS lon,
       -30 + ((s.s_suppkey * 104729) % 1000) / 1e2 AS lat,
       2e-1 + (s.s_suppkey % 10) * 1e-1 AS half
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {part} p ON p.p_partkey = s.s_suppkey
"""
FLARE = """
SELECT l_partkey AS id, r.r_name AS country, year(l_shipdate) AS year, month(l_shipdate) AS month,
       -60 + ((l_partkey * 6007) % 1000) / 1e2 + 3e-3 AS lon,
       -30 + ((l_partkey * 3571) % 1000) / 1e2 + 3e-3 AS lat,
       avg(1500 + l_quantity) AS t_mean, sum(l_quantity) / 1e6 AS bcm
FROM {lineitem} JOIN {region} r ON r.r_regionkey = l_partkey % 5
GROUP BY l_partkey, r.r_name, year(l_shipdate), month(l_shipdate)
"""
SOURCE = """
SELECT 'a2024' AS source_id, 'a' AS source_name, 4.75e0 AS data_score, p_partkey AS field_id, p_name AS name,
       -60 + ((p_partkey * 7919) % 1000) / 1e2 AS lon, -30 + ((p_partkey * 104729) % 1000) / 1e2 AS lat,
       p_retailprice AS oil_prod, p_size AS wells, p_type AS kind FROM {part} WHERE p_partkey % 4 = 0
UNION ALL
SELECT 'b2022', 'b', 4.5e0, p_partkey, p_name,
       -60 + ((p_partkey * 7919) % 1000) / 1e2 + 1e-3 * (p_partkey % 7), -30 + ((p_partkey * 104729) % 1000) / 1e2,
       p_retailprice * 1.1e0, p_size + 1, p_type FROM {part} WHERE p_partkey % 3 = 0
UNION ALL
SELECT 'c2021', 'c', 4.3e0, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END,
       -60 + ((p_partkey * 7919) % 1000) / 1e2, -30 + ((p_partkey * 104729) % 1000) / 1e2 + 1e-3 * (p_partkey % 5),
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice * 9e-1 END, p_size, p_brand FROM {part} WHERE p_partkey % 2 = 0
"""
MOVEMENT = """
SELECT o_custkey AS field_id, {ym} AS period, sum(o_totalprice) AS oil
FROM {orders} GROUP BY o_custkey, {ym}
"""

SOURCE_ORDER = ["a2024", "b2022", "c2021"]
_matches: dict[tuple[str, str], DataFrame] = {}

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SPARK_YM = "date_format(o_orderdate, 'yyyy-MM')"
DUCK_YM = "strftime(o_orderdate, '%Y-%m')"


def sql_views() -> str:
    """The views as common table expressions over tables of the same names."""
    names = {t: t for t in _TABLES} | {"ym": DUCK_YM}
    views = {"fx_field": FIELD, "fx_flare": FLARE, "fx_source": SOURCE, "fx_movement": MOVEMENT}
    return ",\n".join(f"{name} AS ({text.format(**names).strip()})" for name, text in views.items())


class Fixtures:
    """The test tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, text: str, *tables: str) -> DataFrame:
        return self.spark.sql(text.replace("{ym}", SPARK_YM), **{t: self.table(t) for t in tables})

    @cached_property
    def field(self) -> DataFrame:
        return self._view(FIELD, "supplier", "nation", "part")

    @cached_property
    def field_shape(self) -> DataFrame:
        return self.field.withColumn("shape", S.rectangle(F.col("lon"), F.col("lat"), F.col("half")))

    @cached_property
    def flare(self) -> DataFrame:
        return self._view(FLARE, "lineitem", "region")

    @cached_property
    def source(self) -> DataFrame:
        return self._view(SOURCE, "part")

    @cached_property
    def source_cell(self) -> DataFrame:
        """Sources with the cell of their point and their row order."""
        cell = C.cell_of_point(F.col("lon"), F.col("lat"))
        return self.source.withColumn("cell", cell).withColumn("seq", F.col("field_id"))

    @property
    def matches(self) -> DataFrame:
        """Match table of the three sources, computed once per session and folder and kept in the work folder."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _matches:
            _matches[key] = match_all_sources(self.source_cell, SOURCE_ORDER)
        return _matches[key]

    @cached_property
    def movement(self) -> DataFrame:
        return self._view(MOVEMENT, "orders")

    @cached_property
    def basin(self) -> DataFrame:
        """Five 10 x 2 degree bands, each as an offshore and an onshore half, from the regions."""
        region = self.table("region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("r"))
        halves = region.withColumn("side", F.explode(F.array(F.lit("_Mar"), F.lit("_Terra"))))
        south = F.lit(-30.0) + F.col("k") * 2.0
        west = F.when(F.col("side") == "_Mar", F.lit(-60.0)).otherwise(F.lit(-55.0))
        shape = S.rectangle_of_bounds(west, south, west + 5.0, south + 2.0)
        return halves.select(F.concat("r", "side").alias("name"), shape.alias("outer_shape"), west.alias("west"), south.alias("south"))
