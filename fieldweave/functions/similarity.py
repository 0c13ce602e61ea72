"""Name and distance scores of a candidate pair."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECAY_STEPS = 50
FAR_SCORE = -40.0
WEIGHTS = (0.7, 0.3)


def name_ratio(a: Column, b: Column) -> Column:
    """Edit similarity as an integer 0..100; 0 where a name is missing."""
    longest = F.greatest(F.length(a), F.length(b))
    share = F.lit(1.0) - F.try_divide(F.levenshtein(a, b), longest)
    ratio = F.floor(share * F.lit(100.0) + F.lit(0.5)).cast("int")
    both_empty = (longest == 0) & a.isNotNull() & b.isNotNull()
    return F.when(both_empty, F.lit(100)).otherwise(F.coalesce(ratio, F.lit(0)))


@F.pandas_udf(T.IntegerType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity (2 * matches / total length), Arrow batches over already blocked pairs."""

    def score(x: str | None, y: str | None) -> int:
        if x is None or y is None:
            return 0
        if x == y:
            return 100
        return int(round(100 * difflib.SequenceMatcher(None, x, y).ratio()))

    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="int32")


def geo_decay_score(steps: Column) -> Column:
    """Gaussian of the grid distance inside 50 steps, a penalty beyond, 0 where a cell is missing."""
    near = F.lit(100.0) * F.exp(F.lit(-0.5) * (steps * F.lit(0.1)) * (steps * F.lit(0.1)))
    return F.when(steps.isNull(), F.lit(0.0)).when(steps < DECAY_STEPS, near).otherwise(F.lit(FAR_SCORE))


def match_score(name_score: Column, geo_score: Column, weights: tuple[float, float] = WEIGHTS) -> Column:
    return F.lit(weights[0]) * name_score + F.lit(weights[1]) * geo_score
