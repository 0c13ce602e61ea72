"""Flags, counts and guarded production ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion constants (fixed values).
FT_PER_M = 3.28084
SCF_PER_M3 = 35.31466657
BBL_PER_M3 = 6.28981
BBL_PER_T_STEAM = 8.14
SCF_PER_BOE = 6000
THOUSAND_M3_PER_BOE = 0.1647
PERCENT_PER_PPM = 0.0001
SCF_PER_BCM = 35314666572.222


def clean_double(value: Column) -> Column:
    """NaN becomes null, so that comparisons treat a missing number as missing."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def feet_from_metres(value: Column) -> Column:
    return value * F.lit(FT_PER_M)


def barrels_from_thousands(value: Column) -> Column:
    return value * F.lit(1000)


def percent_from_ppm(value: Column) -> Column:
    return value * F.lit(PERCENT_PER_PPM)


def positive_flag(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(None).cast("int")).when(value > 0, 1).otherwise(0)


def positive_flag2(first: Column, second: Column) -> Column:
    """1 if either is positive, null only if both are missing."""
    return F.greatest(positive_flag(first), positive_flag(second))


def ceil_count(value: Column) -> Column:
    return F.ceil(value)


def guarded_ratio(amount: Column, base: Column, factor: float = 1.0) -> Column:
    """``amount * factor / base``; null where an input is missing or the base is zero."""
    scaled = amount if factor == 1.0 else amount * F.lit(factor)
    return F.try_divide(scaled, base)


def gas_oil_ratio(gas: Column, oil: Column) -> Column:
    return guarded_ratio(gas, oil, SCF_PER_BOE)


def water_oil_ratio(water: Column, oil: Column) -> Column:
    return guarded_ratio(water, oil)


def water_injection_ratio(water: Column, oil: Column) -> Column:
    return guarded_ratio(water, oil, BBL_PER_M3)


def gas_lift_ratio(lift: Column, oil: Column) -> Column:
    return F.try_divide(lift * F.lit(1000) * F.lit(SCF_PER_M3), oil)


def steam_oil_ratio(steam: Column, oil: Column) -> Column:
    return guarded_ratio(steam, oil, BBL_PER_T_STEAM)


def reinjected_water_fraction(injected: Column, produced: Column) -> Column:
    return guarded_ratio(injected, produced)


def gas_flood_ratio(gases: list[Column], oil: Column) -> Column:
    """All known gases over oil; gases that are all missing count as zero."""
    total = reduce(lambda a, b: a + b, [F.coalesce(g, F.lit(0.0)) for g in gases])
    return F.try_divide(total * F.lit(1000) * F.lit(SCF_PER_M3), oil)


def dominant_gas_code(natural_gas: Column, nitrogen: Column, co2: Column) -> Column:
    """1, 2 or 3 for the largest positive amount (lowest code on ties), null if none is positive."""
    options = F.array(
        *[F.struct(v.cast("double").alias("v"), F.lit(-code).alias("c")) for code, v in ((1, natural_gas), (2, nitrogen), (3, co2))]
    )
    return -F.array_max(F.filter(options, lambda o: o["v"] > 0))["c"]


def remaining_gas_fraction(
    injected: Column, produced: Column, received: Column, consumed: Column, transferred: Column, flared: Column
) -> Column:
    left = produced * F.lit(THOUSAND_M3_PER_BOE) + received - consumed - transferred - flared
    return F.when(left > 0, F.try_divide(injected, left))


def age_from_year(year: Column, as_of_year: int) -> Column:
    return F.lit(as_of_year) - year


def cap_by(value: Column, limit: Column) -> Column:
    """``limit`` where the value exceeds it; a missing side leaves the value as it is."""
    return F.when(value > limit, limit).otherwise(value)


# Upper bounds of the gas-oil classes and their labels (fixed values).
GOR_BOUNDS = (100, 500, 1000, 5000, 10000)
GOR_LABELS = ("red", "orange", "yellow", "lightgreen", "seagreen", "darkgreen")


def gor_class(gor: Column) -> Column:
    out = F.when(gor <= GOR_BOUNDS[0], GOR_LABELS[0])
    for bound, label in zip(GOR_BOUNDS[1:], GOR_LABELS[1:]):
        out = out.when(gor <= bound, label)
    return out.when(gor > GOR_BOUNDS[-1], GOR_LABELS[-1]).otherwise("0")


def basin_class(basin: Column, named: tuple[str, ...] = ("Santos", "Campos")) -> Column:
    return F.when(basin.isin(*named), basin).otherwise("Others")


def source_score(
    reliability: Column, recency: Column, coverage: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
) -> Column:
    return F.lit(weights[0]) * reliability + F.lit(weights[1]) * recency + F.lit(weights[2]) * coverage
