"""Blocked matching equals comparing every pair."""

import difflib
import math
import random

import pytest

from fieldweave.operators.matching import best_matches, best_matches_by_name, choose_pivots, metric_candidates, name_needed
from fieldweave.plans.matching import filter_authoritative, leave_each_out, leave_one_out, match_all_sources, match_by_name, match_version, seed_matches

WORDS = ["norte", "sul", "leste", "campo", "marlim", "tupi", "buzios", "lula", "albacora", "roncador", "x"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(a, b):
    return math.floor((1 - edits(a, b) / max(len(a), len(b))) * 100 + 0.5)


def blocks(a, b):
    return 100 if a == b else int(round(100 * difflib.SequenceMatcher(None, a, b).ratio()))


def steps(a, b):
    dq, dr = a[0] - b[0], a[1] - b[1]
    return (abs(dq) + abs(dr) + abs(dq + dr)) // 2


def score(n1, c1, n2, c2, rate=ratio):
    geo = 0.0
    if c1 and c2:
        d = steps(c1, c2)
        geo = 100 * math.exp(-0.5 * (d * 0.1) * (d * 0.1)) if d < 50 else -40.0
    return 0.7 * rate(n1, n2) + 0.3 * geo


def noisy(rng, name):
    out = list(name)
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "o", "q"])
    return "".join(out) or "y"


def records(seed, n, null_cells):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = noisy(rng, " ".join(rng.sample(WORDS, rng.choice([1, 2, 2, 3]))))
        cell = None if rng.random() < null_cells else (rng.randrange(-60, 60), rng.randrange(-60, 60))
        rows.append((i, name, cell))
    return rows


ROW = "id bigint, name string, cell struct<q:bigint,r:bigint>"


def frames(spark, known, new):
    k = spark.createDataFrame(known, ROW).selectExpr("id + 1000 as entity_id", "name", "cell", "id as seq")
    return k, spark.createDataFrame(new, ROW).select("name", "cell")


@pytest.mark.parametrize(
    "null_cells,options",
    [(0.0, {}), (0.15, {}), (0.15, {"crowded_from": 0}), (0.1, {"crowded_from": 0, "rows_per_split": 7}), (0.1, {"rows_per_split": 5}), (0.1, {"similarity": "blocks"})],
)
def test_blocked_equals_brute_force(spark, null_cells, options):
    known, new = records(1, 120, null_cells), records(2, 150, null_cells)
    k, n = frames(spark, known, new)
    got = {(r["name"], tuple(r["cell"]) if r["cell"] else None): (r["matched_entity_id"], round(r["score"], 9)) for r in best_matches(k, n, **options).collect()}
    want = {}
    for _, name, cell in new:
        best, best_score = None, 0
        for i, other, other_cell in known:
            s = score(name, cell, other, other_cell, blocks if "similarity" in options else ratio)
            if s > best_score:
                best, best_score = i, s
        if best is not None and best_score >= 60:
            want[(name, cell)] = (best + 1000, round(best_score, 9))
    assert want and got == want


def test_far_pairs_match_only_with_close_names(spark):
    known = [(0, "campo marlim norte leste", (0, 0)), (1, "buzios", (0, 0))]
    new = [(0, "campo marlim norte leste", (30, 0)), (1, "campo marlim norte lests", (0, 22)), (2, "buzios", (0, 51))]
    for options in ({}, {"crowded_from": 0}):
        got = {r["name"]: r["matched_entity_id"] for r in best_matches(*frames(spark, known, new), **options).collect()}
        assert got == {"campo marlim norte leste": 1000, "campo marlim norte lests": 1000}


def test_first_row_wins_ties_unless_the_name_decides(spark):
    known = [(0, "aaaaaaaaab", (0, 0)), (1, "aaaaaaaaac", (0, 0))]
    new = [(0, "aaaaaaaaaa", (0, 0))]
    assert best_matches(*frames(spark, known, new)).collect()[0]["matched_entity_id"] == 1000
    assert best_matches(*frames(spark, list(reversed(known)), new), tie_break="name").collect()[0]["matched_entity_id"] == 1000


def test_needed_name_scores():
    assert [name_needed(d, 60, (0.7, 0.3)) for d in (0, 10, 20, 30, None)] == [43, 60, 80, 86, 86]


def test_weights_that_break_the_blocking_are_refused(spark):
    with pytest.raises(ValueError):
        best_matches(*frames(spark, [(0, "a", None)], [(0, "a", None)]), weights=(0.9, 0.1))


@pytest.mark.parametrize("threshold,similarity,split", [(60, "edit", 200000), (60, "edit", 9), (85, "edit", 200000), (78, "edit", 9), (60, "blocks", 200000), (75, "blocks", 11)])
@pytest.mark.parametrize("index_from", [0, 10**9])
def test_by_name_equals_brute_force(spark, threshold, similarity, split, index_from):
    if index_from == 0 and (similarity, threshold) != ("edit", 60):
        pytest.skip("the metric index serves edit similarity below the ratio of name pieces")
    known, new = records(3, 120, 0.1), records(4, 150, 0.1)
    k, n = frames(spark, known, new)
    rows = best_matches_by_name(k, n, threshold, similarity=similarity, rows_per_split=split, index_from=index_from).collect()
    got = {r["name"]: (r["matched_entity_id"], r["score"]) for r in rows}
    rate = ratio if similarity == "edit" else blocks
    want = {}
    for _, name, _ in new:
        best, best_score = None, 0
        for i, other, _ in known:
            s = rate(name, other)
            if s > best_score:
                best, best_score = i, s
        if best is not None and best_score >= threshold:
            want[name] = (best + 1000, float(best_score))
    assert want and got == want


def test_metric_index_loses_no_pair(spark):
    """Every pair at 60 or more is a candidate, with any pivots, and few others are."""
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghijklmnoprstuvz") for _ in range(random.randint(3, 9)))
    words = [word() for _ in range(150)]
    left = {" ".join(random.sample(words, random.randint(1, 3))) for _ in range(250)} | {"a", "é", "x" * 90}
    right = {n[:-1] + random.choice("xyz") if random.random() < 0.4 else " ".join(random.sample(words, random.randint(1, 3))) for n in sorted(left)} | {"", "x" * 80}
    names = spark.createDataFrame([(n,) for n in sorted(left)], "name string")
    known = spark.createDataFrame([(n,) for n in sorted(right)], "_name string")
    want = {(a, b) for a in left for b in right if b and ratio(a, b) >= 60}
    for pivots in (None, [], ["zzz"]):
        got = [tuple(r) for r in metric_candidates(names, known, 60, pivots=pivots).collect()]
        assert len(got) == len(set(got)) and want <= set(got)
        if pivots is None:
            assert len(got) <= 0.1 * len(left) * len(right)
    assert metric_candidates(names, known.limit(0), 60).count() == 0
    assert len(choose_pivots(known)) > 1 and choose_pivots(known.limit(0)) == []


def source(spark, rows):
    schema = "source_id string, source_name string, field_id bigint, seq bigint, name string, cell struct<q:bigint,r:bigint>"
    return spark.createDataFrame(rows, schema)


def test_sources_are_matched_one_after_the_other(spark):
    rows = [
        ("a1", "a", 0, 0, "marlim", (0, 0)),
        ("a1", "a", 1, 1, "tupi", (500, 0)),
        ("a1", "a", 2, 2, None, (1, 1)),
        ("b1", "b", 0, 0, "marlim sul", (1, 0)),
        ("b1", "b", 1, 1, "roncador", (900, 0)),
        ("b1", "b", 2, 2, "roncadox", (900, 0)),
        ("c1", "c", 0, 0, "roncador", (900, 1)),
        ("c1", "c", 1, 1, "tupi", None),
    ]
    table = match_all_sources(source(spark, rows), ["a1", "b1", "c1"])
    got = {(r["source_id"], r["field_id"]): r["entity_id"] for r in table.collect()}
    # rows of one source do not see each other: both roncador rows of b become entities, in row order
    assert got == {("a1", 0): 0, ("a1", 1): 1, ("b1", 0): 0, ("b1", 1): 2, ("b1", 2): 3, ("c1", 0): 2, ("c1", 1): 1}
    assert match_version(table, 2).count() == 5
    kept = filter_authoritative(table, "a1", ["b1", "c1"])
    ids = {(r["source_id"], r["field_id"]): r["entity_id"] for r in kept.collect()}
    assert ids == {("a1", 0): 0, ("a1", 1): 1, ("b1", 0): 0, ("b1", 1): 2, ("c1", 0): 2, ("c1", 1): 1}


def test_name_match_adopts_the_cell(spark):
    seeded = seed_matches(source(spark, [("a1", "a", 0, 0, "marlim", (5, 6))]))
    new = source(spark, [("p1", "p", 0, 0, "marlin", None), ("p1", "p", 1, 1, "zzz", None)])
    rows = {r["field_id"]: r for r in match_by_name(seeded, new).collect()}
    assert (rows[0]["entity_id"], tuple(rows[0]["cell"]), rows[0]["score"]) == (0, (5, 6), 83.0)
    assert (rows[1]["entity_id"], rows[1]["cell"], rows[1]["score"]) == (1, None, 100.0)


def test_each_source_left_out_equals_full_reruns(spark):
    rows = []
    for s, seed in (("a1", 21), ("b1", 22), ("c1", 23)):
        rows += [(s, s[0], i, i, name, cell) for i, name, cell in records(seed, 25, 0.2)]
    table, order = source(spark, rows), ["a1", "b1", "c1"]
    shown = ("entity_id", "name", "source_id", "field_id", "score")
    got = [tuple(r) for r in leave_each_out(table, order, "b1").select("version", *shown).collect()]
    want = [(w, *r) for w in order for r in leave_one_out(table, order, w, "b1").select(*shown).collect()]
    assert {g[0] for g in got} == set(order) and sorted(got, key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        leave_each_out(table, ["a1"], "a1")
