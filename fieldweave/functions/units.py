"""Typed casts and unit conversion for mapped columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# unit: (dimension, factor to the base unit, offset to the base unit) - fixed values.
# base units: m3, m3/day, pascal, joule, kelvin, metre, kilogram, kilogram CO2 equivalent, year, 1
_BBL = 0.158987294928
_FT3 = 0.028316846592
_BTU = 1055.06
UNITS: dict[str, tuple[str, float, float]] = {
    "m^3": ("volume", 1.0, 0.0),
    "m3": ("volume", 1.0, 0.0),
    "bbl": ("volume", _BBL, 0.0),
    "bbl_oil": ("volume", _BBL, 0.0),
    "bbl_water": ("volume", _BBL, 0.0),
    "bbl_steam": ("volume", _BBL, 0.0),
    "bbl_liquid": ("volume", _BBL, 0.0),
    "kbbl": ("volume", 1e3 * _BBL, 0.0),
    "mbbl": ("volume", 1e3 * _BBL, 0.0),
    "mmbbl": ("volume", 1e6 * _BBL, 0.0),
    "ft^3": ("volume", _FT3, 0.0),
    "scf": ("volume", _FT3, 0.0),
    "MMscf": ("volume", 1e6 * _FT3, 0.0),
    "Bscf": ("volume", 1e9 * _FT3, 0.0),
    "Tscf": ("volume", 1e12 * _FT3, 0.0),
    "ksm3": ("volume", 1e3, 0.0),
    "MSm3": ("volume", 1e6, 0.0),
    "m^3/day": ("volume/day", 1.0, 0.0),
    "bbl/day": ("volume/day", _BBL, 0.0),
    "bpd": ("volume/day", _BBL, 0.0),
    "kbpd": ("volume/day", 1e3 * _BBL, 0.0),
    "scfd": ("volume/day", _FT3, 0.0),
    "MMcfd": ("volume/day", 1e6 * _FT3, 0.0),
    "scf/bbl_oil": ("1", _FT3 / _BBL, 0.0),
    "scf/bbl_liquid": ("1", _FT3 / _BBL, 0.0),
    "bbl_water/bbl_oil": ("1", 1.0, 0.0),
    "bbl_steam/bbl_oil": ("1", 1.0, 0.0),
    "m^3/m^3": ("1", 1.0, 0.0),
    "percent": ("1", 0.01, 0.0),
    "ppm": ("1", 1e-6, 0.0),
    "dimensionless": ("1", 1.0, 0.0),
    "bbl_oil/(psi*day)": ("volume/pressure/day", _BBL / 6894.757293168361, 0.0),
    "m^3/(Pa*day)": ("volume/pressure/day", 1.0, 0.0),
    "Pa": ("pressure", 1.0, 0.0),
    "kPa": ("pressure", 1e3, 0.0),
    "MPa": ("pressure", 1e6, 0.0),
    "bar": ("pressure", 1e5, 0.0),
    "psi": ("pressure", 6894.757293168361, 0.0),
    "psia": ("pressure", 6894.757293168361, 0.0),
    "kelvin": ("temperature", 1.0, 0.0),
    "degC": ("temperature", 1.0, 273.15),
    "degF": ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    "m": ("length", 1.0, 0.0),
    "km": ("length", 1e3, 0.0),
    "ft": ("length", 0.3048, 0.0),
    "inch": ("length", 0.0254, 0.0),
    "miles": ("length", 1609.344, 0.0),
    "kg": ("mass", 1.0, 0.0),
    "g": ("mass", 1e-3, 0.0),
    "tonne": ("mass", 1e3, 0.0),
    "lb": ("mass", 0.45359237, 0.0),
    "t_CO2e": ("co2e", 1.0, 0.0),
    "kt_CO2e": ("co2e", 1e3, 0.0),
    "Mt_CO2e": ("co2e", 1e6, 0.0),
    "Gt_CO2e": ("co2e", 1e9, 0.0),
    "lb_CO2e": ("lb_co2e", 1.0, 0.0),
    "joule": ("energy", 1.0, 0.0),
    "BTU": ("energy", _BTU, 0.0),
    "kBTU": ("energy", 1e3 * _BTU, 0.0),
    "MMBTU": ("energy", 1e6 * _BTU, 0.0),
    "boe": ("energy", 5.8e6 * _BTU, 0.0),
    "kboe": ("energy", 5.8e9 * _BTU, 0.0),
    "MMboe": ("energy", 5.8e12 * _BTU, 0.0),
    "toe": ("energy", 41.868e9, 0.0),
    "ktoe": ("energy", 41.868e12, 0.0),
    "Mtoe": ("energy", 41.868e15, 0.0),
    "g/MJ": ("mass/energy", 1e-9, 0.0),
    "kg/J": ("mass/energy", 1.0, 0.0),
    "years": ("time", 1.0, 0.0),
    "days": ("time", 1.0 / 365.25, 0.0),
}

# long unit names and second symbols - fixed values.
LONG_NAMES = {
    "barrel_oil": "bbl",
    "standard_cubic_foot": "scf",
    "million_standard_cubic_feet": "MMscf",
    "billion_standard_cubic_feet": "Bscf",
    "trillion_standard_cubic_feet": "Tscf",
    "thousand_standard_cubic_meters": "ksm3",
    "million_standard_cubic_meters": "MSm3",
    "barrels_per_day": "bpd",
    "thousand_barrels_per_day": "kbpd",
    "million_cubic_feet_per_day": "MMcfd",
    "standard_cubic_feet_per_day": "scfd",
    "pounds_per_square_inch": "psi",
    "pascal": "Pa",
    "kilopascal": "kPa",
    "megapascal": "MPa",
    "tonnes_CO2_equivalent": "t_CO2e",
    "kilotonnes_CO2_equivalent": "kt_CO2e",
    "megatonnes_CO2_equivalent": "Mt_CO2e",
    "gigatonnes_CO2_equivalent": "Gt_CO2e",
    "pounds_CO2_equivalent": "lb_CO2e",
    "british_thermal_unit": "BTU",
    "Btu": "BTU",
    "million_british_thermal_units": "MMBTU",
    "thousand_british_thermal_units": "kBTU",
    "barrels_oil_equivalent": "boe",
    "thousand_barrels_oil_equivalent": "kboe",
    "million_barrels_oil_equivalent": "MMboe",
    "tonnes_oil_equivalent": "toe",
    "thousand_tonnes_oil_equivalent": "ktoe",
    "million_tonnes_oil_equivalent": "Mtoe",
}
UNITS |= {name: UNITS[unit] for name, unit in LONG_NAMES.items()}

# Spark type of each configured attribute type; a geometry travels as it came.
SPARK_TYPES = {
    "string": "string",
    "integer": "bigint",
    "number": "double",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp",
    "geometry": "string",
}
TRUE_WORDS = ("true", "yes", "y", "1")


def cast_typed(value: Column, kind: str, from_text: bool = True) -> Column:
    """The value as the configured type, null where it cannot be read as one (see :func:`cast_failed`)."""
    if kind in ("string", "geometry"):
        return value.cast("string")
    if kind == "number":
        number = value.try_cast("double")
        return F.when(~F.isnan(number), number)
    if kind == "integer":
        number = value.try_cast("double")
        return F.when(~F.isnan(number), number.try_cast("bigint"))
    if kind == "boolean":
        if from_text:
            return F.lower(value).isin(*TRUE_WORDS)
        return value.cast("double") != 0
    if kind == "date":
        return F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), value.try_cast("date")) if from_text else value.cast("date")
    if kind == "datetime":
        return value.try_cast("timestamp") if from_text else value.cast("timestamp")
    raise ValueError(f"unknown attribute type: {kind}")


def cast_failed(value: Column, typed: Column) -> Column:
    """A value that is there but cannot be read; not-a-number is a missing value."""
    missing = F.coalesce(F.isnan(value.try_cast("double")), F.lit(False))
    return value.isNotNull() & typed.isNull() & ~missing


def unit_step(from_unit: str, to_unit: str) -> tuple[float, float]:
    """``(factor, shift)`` with ``to = from * factor + shift``; an error for unknown or unlike units."""
    for unit in (from_unit, to_unit):
        if unit not in UNITS:
            raise ValueError(f"unknown unit: {unit}")
    dim_s, fac_s, off_s = UNITS[from_unit]
    dim_t, fac_t, off_t = UNITS[to_unit]
    if dim_s != dim_t:
        raise ValueError(f"cannot convert {from_unit} to {to_unit}")
    return fac_s / fac_t, (off_s - off_t) / fac_t


def convert(value: Column, from_unit: str | None, to_unit: str | None, source_type: str = "number", target_type: str = "number") -> Column:
    """Read by source type, convert if both units are known, return as target type.

    Units belong to columns, so the factor is resolved once here and becomes a literal of the plan.
    """
    typed = cast_typed(value, source_type)
    if from_unit and to_unit:
        factor, shift = unit_step(from_unit, to_unit)
        typed = typed.try_cast("double") * F.lit(factor) + F.lit(shift)
        return cast_typed(typed, target_type, from_text=False)
    return cast_typed(typed, target_type, from_text=source_type in ("string", "geometry"))


def unit_table(spark: SparkSession) -> DataFrame:
    rows = [(u, d, f, o) for u, (d, f, o) in UNITS.items()]
    return spark.createDataFrame(rows, "unit string, dimension string, factor double, offset double")


def convert_by_column(df: DataFrame, value: str, from_unit: str, to_unit: str, out: str = "converted") -> DataFrame:
    """Conversion for units stored in the rows; the unit table is this module's fixed list, hence the broadcast.

    Unknown or unlike units give null and ``unit_ok = false``.
    """
    units = unit_table(df.sparkSession)
    src = F.broadcast(units.select(*[F.col(c).alias(f"_s_{c}") for c in units.columns]))
    dst = F.broadcast(units.select(*[F.col(c).alias(f"_t_{c}") for c in units.columns]))
    joined = df.join(src, F.col(from_unit) == F.col("_s_unit"), "left").join(dst, F.col(to_unit) == F.col("_t_unit"), "left")
    ok = F.coalesce(F.col("_s_dimension") == F.col("_t_dimension"), F.lit(False))
    result = (F.col(value) * F.col("_s_factor") + F.col("_s_offset") - F.col("_t_offset")) / F.col("_t_factor")
    return joined.select(*df.columns, F.when(ok, result).alias(out), ok.alias("unit_ok"))
