"""Best-match search between a new source and the known entities.

Scores are ``0.7 * name + 0.3 * distance`` with a threshold of 60, which bounds what a pair must have:

* 50 or more steps apart the score is at most 58, so such a pair never matches;
* 20 or more steps apart the name score must be at least 80;
* with a cell missing it must be at least 86.

Candidate joins follow from that, together complete: where buckets hold few entities, all pairs of
neighbouring buckets; in crowded buckets near pairs by a finer bucket and far pairs by bucket and name piece;
pairs without a cell by name piece. Copies of a (name, cell) are scored once, identical ones not at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import cells as C
from fieldweave.functions import similarity as N
from fieldweave.operators.skew import ROWS_PER_SPLIT, salted_join
from fieldweave.session import freeze

NEAR_STEPS = 20
# Entities in a bucket above which name pieces are cheaper than trying them all.
CROWDED = 200
# From this name score on, the pieces of a name are long enough to serve as join keys.
PIECE_RATIO = 75
# The metric index of names: pivots, the names they are chosen from and their longest length, pivots with rings, groups
# letters are counted in. The index scores few pairs (5 % of 21 million at ratio 60), but finding them costs more than scoring
# all pairs of admissible lengths with a cut-off, so it is built only where ``index_from`` asks for it.
PIVOTS = 10
PIVOT_SAMPLE = 128
PIVOT_LENGTH = 40
RINGED = 2
LETTER_GROUPS = 16
INDEX_FROM = None
# An exact pair cannot tie with a merely similar one up to this length (rounding to integers).
EXACT_LENGTH = {"edit": 198, "blocks": 98}


def name_needed(steps: int | None, threshold: float, weights: tuple[float, float]) -> int:
    """Least integer name score that can reach the threshold at this distance (``None``: cell missing)."""
    geo = 0.0 if steps is None else 100.0 * math.exp(-0.5 * (0.1 * steps) ** 2)
    return max(0, math.ceil((threshold - weights[1] * geo) / weights[0] - 1e-9))


def _edits(longest: Column, ratio: int) -> Column:
    """Most edits that still round to ``ratio`` for a pair whose longer name has this length."""
    return F.floor(longest * F.lit((100.5 - ratio) / 100.0) + F.lit(1e-9)).cast("int")


def long_pieces(name: Column, ratio: int) -> Column:
    """The name cut into one piece more than the edits allowed: a similar shorter name keeps one piece intact."""
    m = F.length(name)
    k = _edits(m, ratio) + 1
    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(
            m.alias("longest"),
            i.alias("piece_no"),
            F.substring(name, (F.floor(i * m / k) + 1).cast("int"), (F.floor((i + 1) * m / k) - F.floor(i * m / k)).cast("int")).alias("piece"),
        ),
    )


def short_pieces(name: Column, ratio: int, equal_too: bool) -> Column:
    """Substrings at which a longer similar name's pieces may occur, for each admissible longer length."""
    n = F.length(name)
    first = n if equal_too else n + 1
    last = F.greatest(n, F.floor(n / F.lit((ratio - 0.5) / 100.0)).cast("int"))

    def for_length(m: Column) -> Column:
        tau = _edits(m, ratio)
        k = tau + 1

        def for_piece(i: Column) -> Column:
            start = F.floor(i * m / k).cast("int")
            size = (F.floor((i + 1) * m / k) - F.floor(i * m / k)).cast("int")
            shift = n - m
            low = F.greatest(start - i, start + shift - (tau - i), F.lit(0))
            high = F.least(start + i, start + shift + (tau - i), n - size)
            return F.when(
                high >= low,
                F.transform(
                    F.sequence(low, high),
                    lambda p: F.struct(m.alias("longest"), i.alias("piece_no"), F.substring(name, p + 1, size).alias("piece")),
                ),
            ).otherwise(F.array().cast("array<struct<longest:int,piece_no:int,piece:string>>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), k - 1), for_piece))

    pieces = F.flatten(F.transform(F.sequence(first, F.greatest(first, last)), for_length))
    return F.array_distinct(pieces) if equal_too else F.when(last >= first, F.array_distinct(pieces))


def similar_name_pairs(
    left: DataFrame,
    right: DataFrame,
    ratio: int,
    keys: list[str],
    condition: Column,
    left_ids: list[str],
    right_ids: list[str],
    rows_per_split: int = ROWS_PER_SPLIT,
    left_bound: int | None = None,
    right_bound: int | None = None,
    left_spread: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Pairs sharing a name piece (and ``keys``) that meet ``condition``; complete for name scores >= ``ratio``.

    ``left`` has ``name``, ``right`` has ``_name``. The longer name of a pair gives the pieces, so both
    directions are joined. ``left_spread`` multiplies the left rows (over neighbouring buckets) after their
    pieces are cut.
    """
    on = [*keys, "_longest", "_piece_no", "_piece"]

    def opened(df: DataFrame, pieces: Column) -> DataFrame:
        cut = df.withColumn("_pieces", pieces)
        cut = left_spread(cut) if "name" in df.columns else cut
        rest = [c for c in cut.columns if c != "_pieces"]
        return cut.select(*rest, F.explode("_pieces").alias("_p")).select(
            *rest, F.col("_p.longest").alias("_longest"), F.col("_p.piece_no").alias("_piece_no"), F.col("_p.piece").alias("_piece")
        )

    left_longer = salted_join(
        opened(left, long_pieces(F.col("name"), ratio)),
        opened(right, short_pieces(F.col("_name"), ratio, equal_too=True)),
        on, left_ids, right_ids, "inner", condition, rows_per_split, left_bound=left_bound, right_bound=right_bound,
    )
    right_longer = salted_join(
        opened(left, short_pieces(F.col("name"), ratio, equal_too=False)),
        opened(right, long_pieces(F.col("_name"), ratio)),
        on, left_ids, right_ids, "inner", condition, rows_per_split, left_bound=left_bound, right_bound=right_bound,
    )
    cols = [c for c in left_longer.columns if c not in ("_longest", "_piece_no", "_piece")]
    return left_longer.select(*cols).unionByName(right_longer.select(*cols))


def _distinct_entities(entities: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """First row (smallest ``seq``) of each key; later copies can never win."""
    picked = entities.where(F.col("name").isNotNull()).groupBy(*keys).agg(
        F.min("seq").alias("_seq"), F.min_by(F.struct(*carry), F.col("seq")).alias("_row")
    )
    return picked.select(*[F.col(k).alias(f"_{k}") for k in keys], "_seq", *[F.col(f"_row.{c}").alias(f"_{c}") for c in carry])


def _best(pairs: DataFrame, keys: list[str], carry: list[str], tie_break: str) -> DataFrame:
    """Highest score per key, by partial aggregation; ties go to the earliest row or the better name."""
    order = F.struct("score", "name_score", -F.col("_seq")) if tie_break == "name" else F.struct("score", -F.col("_seq"))
    row = F.struct(*[F.col(f"_{c}").alias(c) for c in carry], "score")
    top = pairs.groupBy(*keys).agg(F.max_by(row, order).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(f"matched_{c}") for c in carry], F.col("_top.score").alias("score"))


def _bucketed(df: DataFrame, cell: str, steps: int, spread: bool) -> DataFrame:
    """Coarse bucket of a cell; ``spread`` yields the bucket and its eight neighbours."""
    bq = F.floor(F.col(cell)["q"] / F.lit(steps)).cast("bigint")
    br = F.floor(F.col(cell)["r"] / F.lit(steps)).cast("bigint")
    if not spread:
        return df.select("*", bq.alias("_bq"), br.alias("_br"))
    around = F.array(*[F.struct((bq + i).alias("q"), (br + j).alias("r")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.select("*", F.explode(around).alias("_b")).select(*df.columns, F.col("_b.q").alias("_bq"), F.col("_b.r").alias("_br"))


def _lengths_ok(ratio: int) -> Column:
    """Lengths that allow an edit similarity of at least ``ratio``."""
    short = F.least(F.length("name"), F.length("_name"))
    long = F.greatest(F.length("name"), F.length("_name"))
    return short * F.lit(200.0) >= long * F.lit(2.0 * ratio - 1.0) - F.lit(1e-6)


def common_letters(a: Column, b: Column) -> Column:
    """Letters two names share, counted with repetition: an upper bound of any matching of blocks."""
    count = lambda text, ch: F.length(text) - F.length(F.replace(text, ch, F.lit("")))
    letters = F.array_distinct(F.split(a, ""))
    shared = F.transform(F.filter(letters, lambda ch: ch != ""), lambda ch: F.least(count(a, ch), count(b, ch)))
    return F.aggregate(shared, F.lit(0), lambda acc, n: acc + n)


def blocks_bound(a: Column, b: Column) -> Column:
    """Highest matching-blocks score two names can have, from their common letters."""
    share = F.try_divide(common_letters(a, b) * F.lit(200.0), F.length(a) + F.length(b))
    return F.coalesce(F.floor(share + F.lit(0.5)), F.lit(0))


def _edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for ch in a:
        diagonal, row[0] = row[0], row[0] + 1
        for j, other in enumerate(b, start=1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (ch != other))
    return row[-1]


def choose_pivots(known: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[str]:
    """Names far from each other, from the ``sample`` short names with the smallest hashes.

    Pivots decide how much the index leaves out, never what is found, so a bounded sample is enough.
    """
    short = known.where(F.length("_name").between(1, PIVOT_LENGTH)).select("_name")
    names = [r["_name"] for r in short.orderBy(F.xxhash64("_name"), "_name").limit(sample).collect()]
    if not names:
        return []
    pivots, nearest = [names[0]], [_edit_distance(x, names[0]) for x in names]
    while len(pivots) < n and max(nearest) > 0:
        pivots.append(names[nearest.index(max(nearest))])
        nearest = [min(d, _edit_distance(x, pivots[-1])) for d, x in zip(nearest, names)]
    return pivots


def _outlined(df: DataFrame, name: str, side: str, pivots: list[str], ratio: int) -> DataFrame:
    """``df`` with the distances of a name to the pivots, its counts per letter group, and the ring cell it is in.

    A cell is a length and a ring around each of the first pivots; rings are as wide as the edits allowed.
    """
    out = df.withColumn(f"{side}len", F.length(name)).withColumn(f"{side}most", _edits(F.col(f"{side}len"), ratio))
    distances = {f"{side}d{i}": F.levenshtein(F.col(name), F.lit(p)) for i, p in enumerate(pivots)}
    letters = F.split(F.col(name), "")
    group = lambda g: F.size(F.filter(letters, lambda ch: (ch != "") & (F.pmod(F.ascii(ch), F.lit(LETTER_GROUPS)) == g)))
    out = out.withColumns(distances | {f"{side}c{g}": group(g) for g in range(LETTER_GROUPS)})
    width = F.greatest(F.lit(1), F.col(f"{side}most"))
    rings = [F.floor(F.col(f"{side}d{i}") / width).cast("int") for i in range(min(RINGED, len(pivots)))]
    return out.withColumn(f"{side}ring", F.array(*rings) if rings else F.array().cast("array<int>"))


def _cells(outlined: DataFrame, side: str, n_pivots: int) -> DataFrame:
    """One row per ring cell in use with the least and greatest distance of its names to each pivot."""
    bounds = [f(f"{side}d{i}").alias(f"{side}{label}{i}") for i in range(n_pivots) for f, label in ((F.min, "lo"), (F.max, "hi"))]
    return outlined.groupBy(f"{side}len", f"{side}ring").agg(F.max(f"{side}most").alias(f"{side}most"), *bounds)


def metric_candidates(
    names: DataFrame, known: DataFrame, ratio: int, rows_per_split: int = ROWS_PER_SPLIT, pivots: list[str] | None = None, **bounds: int
) -> DataFrame:
    """Pairs of ``name`` and ``_name`` that a metric index cannot tell apart by more edits than ``ratio`` allows.

    By the triangle inequality two names differ by at least the difference of their distances to any pivot, and by at
    least the letters one has and the other lacks. Names are kept in cells of a length and rings around pivots. Pairs of
    cells meet on admissible lengths, and those whose distances to some pivot lie too far apart are left out; only the
    names of the cell pairs that are left meet, and are tested the same way one by one. No pair of names whose score
    reaches ``ratio`` is lost.
    """
    pivots = choose_pivots(known) if pivots is None else pivots
    left = freeze(_outlined(names, "name", "_l", pivots, ratio), "outlined")
    right = freeze(_outlined(known, "_name", "_r", pivots, ratio), "outlined")
    n, share = F.col("_llen"), F.lit((ratio - 0.5) / 100.0)
    lengths = F.sequence(F.ceil(n * share - F.lit(1e-9)).cast("int"), F.floor(n / share + F.lit(1e-9)).cast("int"))
    most = F.greatest("_lmost", "_rmost")  # a pair's edits go by its longer name
    apart = [F.greatest(F.col(f"_llo{i}") - F.col(f"_rhi{i}"), F.col(f"_rlo{i}") - F.col(f"_lhi{i}")) for i in range(len(pivots))]
    close = [F.col("_to") == F.col("_rlen"), *[gap <= most for gap in apart]]
    cells = _cells(left, "_l", len(pivots)).withColumn("_to", F.explode(lengths))
    cells = cells.join(_cells(right, "_r", len(pivots)), close).select("_llen", "_lring", F.col("_rlen").alias("_len"), F.col("_rring").alias("_ring"))
    # cells are few, names are many: a cell's names may be any share of all
    left = salted_join(left, cells, ["_llen", "_lring"], ["name"], None, "inner", None, rows_per_split, left_bound=bounds.get("left_bound"))
    right = right.withColumnsRenamed({"_rlen": "_len", "_rring": "_ring"})
    near = F.lit(True)
    for i in range(len(pivots)):
        near &= F.abs(F.col(f"_ld{i}") - F.col(f"_rd{i}")) <= most
    for a, b in (("_l", "_r"), ("_r", "_l")):
        lacking = [F.greatest(F.col(f"{a}c{g}") - F.col(f"{b}c{g}"), F.lit(0)) for g in range(LETTER_GROUPS)]
        near &= sum(lacking[1:], lacking[0]) <= most
    pairs = salted_join(left, right, ["_len", "_ring"], ["name"], ["_name"], "inner", near, rows_per_split, heavy=True, **bounds)
    return pairs.select(*names.columns, *known.columns)


def _best_by_name(
    names: DataFrame, known: DataFrame, ratio: int, similarity: str, rows_per_split: int, index_from: int | None = INDEX_FROM
) -> DataFrame:
    """Best known row per distinct name with ``name_score >= ratio``: ``name, name_score, _row, _seq``.

    ``known`` has one row per ``_name``. A name already known is settled by an equi-join. The others are
    compared through common name pieces where the ratio is high enough for pieces to be telling, otherwise
    with the names of every length that can still reach the ratio, crowded lengths cut into blocks; from
    ``index_from`` pairs on with the candidates of the metric index instead.
    """
    same = F.col("name") == F.col("_name")
    limit = EXACT_LENGTH[similarity]
    short = F.length("name") <= limit
    known = freeze(known, "known")
    bounds = {"right_bound": known.count()}
    exact = names.where(short).join(known, same).select("name", F.lit(100).alias("name_score"), "_row", "_seq")
    settled = known.where(F.length("_name") <= limit).select("_name")
    open_ = freeze(names.join(settled, same, "left_anti").where(F.length("name") > 0), "open")
    bounds["left_bound"] = open_.count()
    score = N.name_ratio(F.col("name"), F.col("_name"))
    if similarity == "edit" and ratio >= PIECE_RATIO:
        pairs = similar_name_pairs(open_, known, ratio, [], _lengths_ok(ratio) & (score >= ratio), ["name"], ["_name"], rows_per_split, **bounds)
        pairs = pairs.withColumn("name_score", score)
    else:
        bound = (ratio - 0.5) / 100.0
        if similarity == "blocks":
            bound = bound / (2.0 - bound)  # 2*min/(min+max) >= b  <=>  min/max >= b/(2-b)
        n = F.length("name")
        shortest = F.ceil(n * F.lit(bound) - F.lit(1e-9)).cast("int")
        longest = F.floor(n / F.lit(bound) + F.lit(1e-9)).cast("int")
        left = open_.withColumn("_len", F.explode(F.sequence(shortest, longest)))
        right = known.withColumn("_len", F.length("_name"))
        # distances beyond the most edits allowed are not computed to the end
        most = f"cast(floor(greatest(length(name), length(_name)) * {(100.5 - ratio) / 100.0!r}D + 1e-9D) as int)"
        close = F.expr(f"levenshtein(name, _name, {most}) >= 0") & (score >= ratio)
        if similarity == "edit" and index_from is not None and bounds["left_bound"] * bounds["right_bound"] >= index_from:
            pairs = metric_candidates(open_, known, ratio, rows_per_split, **bounds).where(close)
            pairs = pairs.withColumn("name_score", score)
        elif similarity == "edit":
            pairs = salted_join(left, right, ["_len"], ["name"], ["_name"], "inner", close, rows_per_split, heavy=True, **bounds)
            pairs = pairs.withColumn("name_score", score)
        else:
            hopeful = blocks_bound(F.col("name"), F.col("_name")) >= ratio
            pairs = salted_join(left, right, ["_len"], ["name"], ["_name"], "inner", hopeful, rows_per_split, heavy=True, **bounds)
            pairs = pairs.withColumn("name_score", N.matching_blocks_ratio("name", "_name")).where(F.col("name_score") >= ratio)
    every = exact.unionByName(pairs.select("name", "name_score", "_row", "_seq"))
    top = F.struct("name_score", "_row", "_seq")
    best = every.groupBy("name").agg(F.max_by(top, F.struct("name_score", -F.col("_seq"))).alias("_top"))
    return best.select("name", "_top.name_score", "_top._row", "_top._seq")


def _known_names(entities: DataFrame, carry: list[str]) -> DataFrame:
    """First row of each name: ``_name, _row, _seq``."""
    named = entities.where(F.col("name").isNotNull())
    return named.groupBy(F.col("name").alias("_name")).agg(
        F.min_by(F.struct(*carry), F.col("seq")).alias("_row"), F.min("seq").alias("_seq")
    )


def best_matches(
    entities: DataFrame,
    new: DataFrame,
    threshold: float = 60,
    weights: tuple[float, float] = N.WEIGHTS,
    max_steps: int = N.DECAY_STEPS,
    tie_break: str = "first",
    similarity: str = "edit",
    rows_per_split: int = ROWS_PER_SPLIT,
    crowded_from: int = CROWDED,
) -> DataFrame:
    """Best entity for each distinct (name, cell) of ``new`` that reaches the threshold.

    ``entities``: ``entity_id, name, cell, seq``; ``new``: ``name, cell``. Output: ``name, cell,
    matched_entity_id, score``. ``similarity="edit"`` stays in the JVM; ``"blocks"`` scores names by matching
    blocks, in Arrow batches over the pairs whose position and common letters allow the threshold.
    """
    if weights[0] * 100 + weights[1] * N.FAR_SCORE >= threshold:
        raise ValueError("with these weights far pairs could match; blocking by distance would lose them")
    if tie_break not in ("first", "name"):
        raise ValueError("tie_break is 'first' or 'name'")
    known = freeze(_distinct_entities(entities, ["name", "cell"], ["entity_id"]), "known")
    placed_known = known.where("_cell is not null")
    wanted = new.where(F.col("name").isNotNull()).select("name", "cell").distinct()

    same = (F.col("name") == F.col("_name")) & (F.col("cell") == F.col("_cell"))
    full = F.lit(weights[0] * 100.0 + weights[1] * 100.0)
    exact = wanted.where(F.length("name") <= EXACT_LENGTH[similarity]).join(placed_known, same).select(
        "name", "cell", F.lit(100).alias("name_score"), full.alias("score"), "_entity_id", "_seq"
    )
    settled = placed_known.where(F.length("_name") <= EXACT_LENGTH[similarity]).select("_name", "_cell")
    open_ = freeze(wanted.join(settled, same, "left_anti"), "open")
    placed, unplaced = open_.where("cell is not null"), open_.where("cell is null")
    # a bucket cannot hold more rows than there are
    sizes = {"left_bound": placed.count(), "right_bound": placed_known.count()}

    steps = C.cell_distance(F.col("cell"), F.col("_cell"))
    name_score = N.name_ratio(F.col("name"), F.col("_name"))
    score = N.match_score(name_score, N.geo_decay_score(steps), weights)
    good = score >= F.lit(max(float(threshold), 1e-9))

    lengths = _lengths_ok(name_needed(0, threshold, weights))
    ids = (["name", "cell"], ["_name", "_cell"])
    coarse = _bucketed(placed_known, "_cell", max_steps, False)
    spread = lambda df: _bucketed(df, "cell", max_steps, True)
    crowded = coarse.groupBy("_bq", "_br").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded_from).select("_bq", "_br")
    found = []
    if similarity == "blocks" or crowded.isEmpty():
        sparse = coarse
    else:
        crowded = freeze(crowded, "crowded")
        sparse = coarse.join(crowded, ["_bq", "_br"], "left_anti")
        dense = freeze(coarse.join(crowded, ["_bq", "_br"], "left_semi"), "dense")
        # crowded buckets, near: pairs of neighbouring fine buckets
        fine = _bucketed(dense.drop("_bq", "_br"), "_cell", NEAR_STEPS, False)
        near_ok = (steps < min(NEAR_STEPS, max_steps)) & lengths & good
        found.append(
            salted_join(_bucketed(placed, "cell", NEAR_STEPS, True), fine, ["_bq", "_br"], *ids, "inner", near_ok, rows_per_split, heavy=True, **sizes)
        )
        # crowded buckets, far: the high name score needed there leaves a piece of the name in common
        far_ratio = name_needed(NEAR_STEPS, threshold, weights)
        far_ok = (steps >= NEAR_STEPS) & (steps < max_steps) & _lengths_ok(far_ratio) & good
        found.append(
            similar_name_pairs(placed, dense, far_ratio, ["_bq", "_br"], far_ok, *ids, rows_per_split, left_spread=spread, **sizes)
        )
    # other buckets: all pairs of neighbouring buckets
    if similarity == "edit":
        sparse_ok = (steps < max_steps) & lengths & good
    else:
        hopeful = N.match_score(blocks_bound(F.col("name"), F.col("_name")), N.geo_decay_score(steps), weights)
        sparse_ok = (steps < max_steps) & (hopeful >= F.lit(max(float(threshold), 1e-9)))
        name_score = N.matching_blocks_ratio("name", "_name")
    found.append(salted_join(spread(placed), sparse, ["_bq", "_br"], *ids, "inner", sparse_ok, rows_per_split, heavy=True, **sizes))
    pairs = exact
    for p in found:
        scored = p.withColumn("name_score", name_score)
        scored = scored.withColumn("score", N.match_score(F.col("name_score"), N.geo_decay_score(steps), weights))
        scored = scored.where(F.col("score") >= F.lit(max(float(threshold), 1e-9)))
        pairs = pairs.unionByName(scored.select("name", "cell", "name_score", "score", "_entity_id", "_seq"))
    # a cell is missing on one side or both: only the name counts, so names are compared once each
    ratio = name_needed(None, threshold, weights)
    by_name = N.match_score(F.col("name_score"), F.lit(0.0), weights)
    branches = []
    if not unplaced.isEmpty():
        branches.append((unplaced, _known_names(entities, ["entity_id"])))
    if not known.where("_cell is null").isEmpty():
        branches.append((placed, _known_names(entities.where("cell is null"), ["entity_id"])))
    for rows, names in branches:
        best = _best_by_name(rows.select("name").distinct(), names, ratio, similarity, rows_per_split)
        pairs = pairs.unionByName(
            best.join(rows, "name").select("name", "cell", "name_score", by_name.alias("score"), F.col("_row.entity_id").alias("_entity_id"), "_seq")
        )
    return _best(pairs, ["name", "cell"], ["entity_id"], tie_break)


def best_matches_by_name(
    entities: DataFrame,
    new: DataFrame,
    threshold: float = 60,
    weight: float = 1.0,
    similarity: str = "edit",
    rows_per_split: int = ROWS_PER_SPLIT,
    index_from: int | None = INDEX_FROM,
) -> DataFrame:
    """Best entity by name alone for each distinct name; output ``name, matched_entity_id, matched_cell, score``.

    ``similarity="edit"`` stays in the JVM; ``"blocks"`` scores by matching blocks (Arrow batches over the
    pairs whose common letters allow the threshold).
    """
    ratio = max(1, math.ceil(threshold / weight - 1e-9))
    names = new.where(F.col("name").isNotNull()).select("name").distinct()
    best = _best_by_name(names, _known_names(entities, ["entity_id", "cell"]), ratio, similarity, rows_per_split, index_from)
    return best.select(
        "name",
        F.col("_row.entity_id").alias("matched_entity_id"),
        F.col("_row.cell").alias("matched_cell"),
        (F.col("name_score") * F.lit(float(weight))).alias("score"),
    )
