"""Nearest neighbours where rows repeat and where parts are small, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from fieldweave.llm import learned_partitions


def brute(rows, query, k=5):
    """Ids of the best rows, each (id, vector) once."""
    own = np.array(dict(rows)[query], float)
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    once = {(i, tuple(v)) for i, v in rows if i != query}
    return [i for _, i in sorted((-float(unit(v) @ unit(own)), i) for i, v in once)[:k]]


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    near = brute(rows, 0, 1)[0]
    rows += [rows[near]] * 9 + [rows[0]] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = learned_partitions.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == brute(rows, 0) and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_small_parts_are_not_all_a_query_gets(spark, monkeypatch):
    router = learned_partitions.Router(2, 3)
    first, second = np.zeros((2, learned_partitions.HIDDEN)), np.zeros((learned_partitions.HIDDEN, 3))
    first[0, 0], first[0, 1], second[0, 0], second[1, 1] = 1, -1, 9, 9  # part 0 right, part 1 left, part 2 empty
    router.w = [first, np.zeros(learned_partitions.HIDDEN), second, np.array([0, 0, 1.0])]
    monkeypatch.setattr(learned_partitions, "learn", lambda *_: (router, 1))
    rows = [(i, [1.0, 0.1 * i]) for i in range(10)] + [(20, [-1.0, 0.5]), (21, [-1.0, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = learned_partitions.search(df, F.col("vec_id").isin(3, 20)).orderBy("query_id", "rank").collect()
    for query in (3, 20):
        assert [r["vec_id"] for r in got if r["query_id"] == query] == brute(rows, query)
