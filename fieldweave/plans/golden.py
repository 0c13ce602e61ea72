"""Golden records from the match table and the source info tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.cells import DEFAULT_EDGE
from fieldweave.operators.cover import dissolve, dissolved_centroids
from fieldweave.operators.merging import best_name, lineage_map, lookup_first, merge_by_rules, sources_used
from fieldweave.session import freeze


def merge_entities(
    matches: DataFrame,
    sources: DataFrame,
    rules: Mapping[str, str],
    as_of_year: int,
    with_lineage: bool = False,
    edge_deg: float = DEFAULT_EDGE,
) -> DataFrame:
    """One row per entity: name, sources used, merged columns, and geometry where the sources have shapes."""
    has_shape = "shape" in sources.columns
    columns = [*rules, *(["shape"] if has_shape else [])]
    looked_up = lookup_first(matches.drop("source_name"), sources, ["source_name", *columns])
    out = best_name(matches).join(sources_used(matches), "entity_id")
    out = out.join(merge_by_rules(looked_up, "entity_id", rules, as_of_year), "entity_id", "left")
    if has_shape:
        members = looked_up.select("entity_id", "shape")
        out = out.join(dissolve(members, "entity_id", "shape"), "entity_id", "left")
        out = out.join(dissolved_centroids(members, "entity_id", "shape", edge_deg).select("entity_id", "cell"), "entity_id", "left")
    if with_lineage:
        out = out.join(lineage_map(looked_up, list(rules)), "entity_id", "left")
    return out


def cumulative_versions(matches: DataFrame, order: Sequence[str]) -> DataFrame:
    """Match rows once for every version that holds their source: version k merges the first k sources of ``order``.

    Matching adds one source after the other, so the rows of the first k sources are the match table of version k.
    Rows of other sources are in no version.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source_id"))
    held = F.explode(F.sequence(rank, F.lit(len(order)).cast("bigint")).cast("array<int>"))
    return matches.where(rank > 0).withColumn("version", held)


def merge_versions(labelled: DataFrame, sources: DataFrame, rules: Mapping[str, str], as_of_year: int) -> DataFrame:
    """Golden records of all versions in one pass: ``version``, ``entity_id``, ``name``, ``sources_used``, merged columns.

    ``labelled``: match rows with a ``version`` of any type, as of :func:`cumulative_versions` or several match tables put
    together. The source rows are looked up once per match row, whatever number of versions holds it, and stored; only
    these narrow rows are repeated per version. Rules work per version and entity as they do per entity.
    """
    place = ["source_id", "field_id", "seq"]
    labelled = freeze(labelled.select("version", "entity_id", "name", "score", *place), "labelled")
    found = lookup_first(labelled.select("source_id", "field_id").distinct(), sources, list(rules))
    found = freeze(found, "looked_up")
    # version and entity stand in one key, so that the per-entity operators serve as they are
    keyed = labelled.withColumn("entity_id", F.struct("version", "entity_id"))
    merged = merge_by_rules(keyed.select("entity_id", "source_id", "field_id").join(found, ["source_id", "field_id"]), "entity_id", rules, as_of_year)
    out = best_name(keyed).join(sources_used(keyed), "entity_id").join(merged, "entity_id", "left")
    return out.select("entity_id.version", "entity_id.entity_id", "name", "sources_used", *rules)
