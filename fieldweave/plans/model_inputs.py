"""Inputs of the emissions model from merged fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.quantities import cap_by
from fieldweave.operators.projection import null_outside

API_RANGE = (3.0, 88.0)


def filter_producing(fields: DataFrame) -> DataFrame:
    return fields.where((F.col("functional_unit") == "oil") & F.col("oil_prod").isNotNull() & (F.col("oil_prod") > 0))


def prepare_model_inputs(fields: DataFrame, country: str) -> DataFrame:
    """Producing oil fields with implausible values cleared and flaring capped by the gas-oil ratio."""
    rows = filter_producing(fields)
    have = set(rows.columns)
    fixes = {c: null_outside(F.col(c), low=1) for c in ("num_prod_wells", "num_water_inj_wells") if c in have}
    if "api" in have:
        fixes["api"] = null_outside(F.col("api"), *API_RANGE)
    if {"for_value", "gor"} <= have:
        fixes["for_value"] = cap_by(F.col("for_value"), F.col("gor"))
    fixes["country"] = F.lit(country)
    return rows.withColumns(fixes)


def long_layout(fields: DataFrame, id_col: str, attributes: Sequence[str]) -> DataFrame:
    """One row per field and attribute, the sheet layout of the model."""
    texts = fields.select(id_col, *[F.col(a).cast("string").alias(a) for a in attributes])
    return texts.unpivot([id_col], list(attributes), "attribute", "value")
