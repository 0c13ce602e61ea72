"""Small literature sources: transposed sheets, identity mapping, match by name alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fieldweave.operators.projection import identity_ops
from fieldweave.plans.matching import match_by_name
from fieldweave.plans.standardize import SourceMeta, standardize
from fieldweave.session import freeze
from fieldweave.sources.files import scan_transposed


def read_paper(sheet: DataFrame, name_col: str, source: SourceMeta, attributes: Sequence[str]) -> DataFrame:
    """Source info table of a sheet with one column per field."""
    rows = scan_transposed(sheet, name_col, attributes, "sheet_column")
    return standardize(rows, source, identity_ops(attributes), attributes, order=["sheet_column"])


def ingest_papers(matches: DataFrame, papers: Sequence[DataFrame], first_rank: int, threshold: float = 60, similarity: str = "edit") -> DataFrame:
    """Match table extended by each paper in turn."""
    for rank, paper in enumerate(papers, start=first_rank):
        rows = match_by_name(matches, paper.withColumn("seq", paper["field_id"]), threshold, rank=rank, similarity=similarity)
        matches = freeze(matches.unionByName(rows), "matches")
    return matches
