"""Values for fields without data: neighbours first, then the region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.cells import cell_ring


def estimate_missing(fields: DataFrame, key: str, cell: str, region: str, columns: Sequence[str], k: int = 2) -> DataFrame:
    """Fill nulls with the mean over the cells within ``k`` steps, else over the region.

    Sums and counts are taken per cell before the ring join, so a crowded cell is one row there.
    """
    sums = [F.sum(c).alias(f"_s_{c}") for c in columns] + [F.count(c).alias(f"_n_{c}") for c in columns]
    per_cell = fields.where(F.col(cell).isNotNull()).groupBy(F.col(cell).alias("_near")).agg(*sums)
    gaps = fields.where(" or ".join(f"{c} is null" for c in columns) + f" and {cell} is not null")
    around = gaps.select(key, F.explode(cell_ring(F.col(cell), k)).alias("_near"))
    near = around.join(per_cell, "_near").groupBy(key).agg(
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"_near_{c}") for c in columns]
    )
    regional = fields.groupBy(region).agg(*[F.avg(c).alias(f"_region_{c}") for c in columns])
    out = fields.join(near, key, "left").join(regional, region, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_near_{c}"), F.col(f"_region_{c}")) for c in columns}
    origin = {
        f"{c}_origin": F.when(F.col(c).isNotNull(), "data")
        .when(F.col(f"_near_{c}").isNotNull(), "neighbours")
        .when(F.col(f"_region_{c}").isNotNull(), "region")
        for c in columns
    }
    return out.withColumns(origin).withColumns(filled).select(*fields.columns, *origin)


