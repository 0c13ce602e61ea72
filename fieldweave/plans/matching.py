"""Match table: which source record belongs to which entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.similarity import WEIGHTS
from fieldweave.operators.aggregates import count_having
from fieldweave.operators.matching import best_matches, best_matches_by_name
from fieldweave.operators.numbering import allocate_ids, dense_renumber, number_rows
from fieldweave.operators.skew import ROWS_PER_SPLIT, salted_join
from fieldweave.session import freeze

# The source's rank sits above all row numbers (bigint), so ``seq``, a decimal, is the order of the whole table.
SOURCE_STRIDE = 10**19

COLUMNS = ["entity_id", "name", "cell", "source_id", "source_name", "field_id", "score", "seq"]


def order_sources(metadata: DataFrame) -> list[str]:
    """Source ids by falling data score; one row per source comes to the driver."""
    rows = metadata.select("source_id", "data_score").orderBy(F.desc("data_score"), "source_id").collect()
    return [r["source_id"] for r in rows]


def _table_order(rank: int, seq: Column) -> Column:
    return (F.lit(str(rank * SOURCE_STRIDE)).cast("decimal(37,0)") + seq.cast("decimal(20,0)")).cast("decimal(38,0)")


def _prepare(source: DataFrame, rank: int) -> DataFrame:
    named = source.where(F.col("name").isNotNull())
    return named.select("name", "cell", "source_id", "source_name", "field_id", _table_order(rank, F.col("seq")).alias("seq"))


def seed_matches(source: DataFrame) -> DataFrame:
    """Named rows of the best source as entities 0, 1, ... with score 100."""
    numbered = number_rows(_prepare(source, 0), ["seq"], "entity_id")
    return numbered.withColumn("score", F.lit(100.0)).select(*COLUMNS)


def match_sources(
    entities: DataFrame,
    new: DataFrame,
    threshold: float = 60,
    weights: tuple[float, float] = WEIGHTS,
    max_steps: int = 50,
    rank: int = 1,
    tie_break: str = "first",
    similarity: str = "edit",
) -> DataFrame:
    """Rows of ``new`` with the entity each belongs to; rows without a match become new entities.

    ``entities`` is the match table so far and should be stored (see :func:`fieldweave.session.freeze`).
    """
    rows = _prepare(new, rank)
    best = best_matches(entities, rows, threshold, weights, max_steps, tie_break, similarity)
    best = freeze(best.withColumnsRenamed({"name": "_bname", "cell": "_bcell"}), "best")
    keyed = rows.withColumns({"_bname": F.col("name"), "_bcell": F.col("cell")})
    found = salted_join(keyed, best, ["_bname", "_bcell"], ["seq"], None, "left", None, ROWS_PER_SPLIT, null_safe=True, left_bound=rows.count())
    found = found.withColumnRenamed("matched_entity_id", "entity_id").drop("_bname", "_bcell")
    return _settle(entities, freeze(found, "matched"))


def _settle(entities: DataFrame, found: DataFrame) -> DataFrame:
    matched = found.where(F.col("entity_id").isNotNull())
    created = allocate_ids(found.where(F.col("entity_id").isNull()), entities, "entity_id", "seq").withColumn("score", F.lit(100.0))
    return matched.select(*COLUMNS).unionByName(created.select(*COLUMNS))


def match_by_name(entities: DataFrame, new: DataFrame, threshold: float = 60, weight: float = 1.0, rank: int = 1, similarity: str = "edit") -> DataFrame:
    """Like :func:`match_sources` by name alone; a matched row adopts the entity's cell."""
    rows = _prepare(new, rank)
    best = best_matches_by_name(entities, rows, threshold, weight, similarity).withColumnRenamed("name", "_bname")
    keyed = rows.withColumn("_bname", F.col("name"))
    found = salted_join(keyed, freeze(best, "best"), ["_bname"], ["seq"], None, "left", left_bound=rows.count())
    cell = F.when(F.col("matched_entity_id").isNotNull(), F.col("matched_cell")).otherwise(F.col("cell"))
    found = found.withColumn("cell", cell).withColumnRenamed("matched_entity_id", "entity_id").drop("matched_cell", "_bname")
    return _settle(entities, freeze(found, "matched"))


def match_all_sources(
    sources: DataFrame, order: Sequence[str], threshold: float = 60, tie_break: str = "first", similarity: str = "edit"
) -> DataFrame:
    """Match table of all sources in ``order``: parallel within a source, one source after the other.

    ``sources`` holds the rows of every source: ``source_id, source_name, field_id, seq, name, cell``.
    """
    table = freeze(seed_matches(sources.where(F.col("source_id") == order[0])), "matches")
    for rank, source_id in enumerate(order[1:], start=1):
        new = sources.where(F.col("source_id") == source_id)
        rows = match_sources(table, new, threshold, rank=rank, tie_break=tie_break, similarity=similarity)
        table = freeze(table.unionByName(rows), "matches")
    return table


def match_version(matches: DataFrame, n_sources: int) -> DataFrame:
    """The table after the first ``n_sources`` sources. Later sources only append, so it is a prefix."""
    return matches.where(F.col("seq") < F.lit(str(n_sources * SOURCE_STRIDE)).cast("decimal(38,0)"))


def filter_authoritative(matches: DataFrame, authority_id: str, other_ids: Sequence[str]) -> DataFrame:
    """Entities of the authority, or with enough rows of the others; ids become 0..n-1."""
    required = (1 + len(other_ids)) // 2 + 1
    by_authority = matches.where(F.col("source_id") == authority_id).select("entity_id")
    by_count = count_having(matches, "entity_id", "source_id", other_ids, required).select("entity_id")
    keep = by_authority.union(by_count).distinct()
    return dense_renumber(matches.join(keep, "entity_id", "left_semi"), "entity_id")


def leave_one_out(sources: DataFrame, order: Sequence[str], without: str, authority_id: str) -> DataFrame:
    """The authoritative table rebuilt without one source."""
    kept = [s for s in order if s != without]
    matches = match_all_sources(sources.where(F.col("source_id") != without), kept)
    return filter_authoritative(matches, authority_id, [s for s in kept if s != authority_id])


def leave_each_out(sources: DataFrame, order: Sequence[str], authority_id: str) -> DataFrame:
    """The authoritative tables of :func:`leave_one_out` for every source in turn, told apart by ``version``, the source left out.

    Sources before the one left out are matched as in the full run, so their table is shared and matching runs again only
    from the next source on. The rows serve :func:`fieldweave.plans.golden.merge_versions` as they are.
    """
    rows_of = lambda s: sources.where(F.col("source_id") == s)
    out, before = None, None
    for k, without in enumerate(order):
        table = before
        for rank, source_id in enumerate(order[k + 1 :], start=k + 1):
            rows = seed_matches(rows_of(source_id)) if table is None else table.unionByName(match_sources(table, rows_of(source_id), rank=rank))
            table = freeze(rows, "matches")
        if table is not None:
            others = [s for s in order if s not in (without, authority_id)]
            one = filter_authoritative(table, authority_id, others).withColumn("version", F.lit(without))
            out = one if out is None else out.unionByName(one)
        if k + 1 < len(order):
            rows = seed_matches(rows_of(without)) if before is None else before.unionByName(match_sources(before, rows_of(without), rank=k))
            before = freeze(rows, "matches")
    if out is None:
        raise ValueError("leaving a source out takes two sources or more")
    return out
