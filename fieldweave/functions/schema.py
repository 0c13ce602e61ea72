"""Target schema: declared types, units and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

from fieldweave.functions import recode

_UNITS = {
    "age": "years",
    "depth": "ft",
    "oil_prod": "bbl/day",
    "well_diam": "inch",
    "prod_index": "bbl_oil/(psi*day)",
    "res_press": "psi",
    "res_temp": "degF",
    "gor": "scf/bbl_oil",
    "wor": "bbl_water/bbl_oil",
    "wir": "bbl_water/bbl_oil",
    "glir": "scf/bbl_liquid",
    "gfir": "scf/bbl_oil",
    "sor": "bbl_steam/bbl_oil",
    "for_value": "scf/bbl_oil",
    "transport_dist_tanker": "miles",
    "transport_dist_barge": "miles",
    "transport_dist_pipeline": "miles",
    "transport_dist_rail": "miles",
    "transport_dist_truck": "miles",
    "ocean_tanker_size": "tonne",
    "small_sources_emissions": "g/MJ",
}
_TEXT = ["name", "country", "centroid_cell", "geometry"]
_OPTIONS = {
    "functional_unit": ("oil", "gas"),
    "oil_sands_mine_type": ("None", "Integrated with upgrader", "Integrated with diluent", "Integrated with both"),
    "flood_gas_type": tuple(recode.FLOOD_GASES.values()),
    "co2_source": tuple(recode.CO2_SOURCES.values()),
    "upgrader_type": tuple(recode.UPGRADERS.values()),
    "gas_processing_path": tuple(recode.GAS_PATHS.values()),
    "ecosystem_richness": recode.RICHNESS,
    "field_development_intensity": recode.INTENSITY,
}
_FLAGS = [
    "downhole_pump",
    "water_reinjection",
    "natural_gas_reinjection",
    "water_flooding",
    "gas_lifting",
    "gas_flooding",
    "steam_flooding",
    "offshore",
    "heater_treater",
    "stabilizer_column",
]
_COUNTS = ["num_prod_wells", "num_water_inj_wells"]
FRACTIONS = (
    "fraction_elec_onsite",
    "fraction_remaining_gas_inj",
    "fraction_water_reinjected",
    "fraction_steam_cogen",
    "fraction_steam_solar",
    "frac_venting",
    "fraction_diluent",
    "frac_transport_tanker",
    "frac_transport_barge",
    "frac_transport_pipeline",
    "frac_transport_rail",
    "frac_transport_truck",
)
_NUMBERS = [
    "latitude",
    "longitude",
    *_UNITS,
    "api",
    "gas_comp_n2",
    "gas_comp_co2",
    "gas_comp_c1",
    "gas_comp_c2",
    "gas_comp_c3",
    "gas_comp_c4",
    "gas_comp_h2s",
    "frac_co2_breakthrough",
    "perc_sequestration_credit",
    *FRACTIONS,
]
ALLOWED = _OPTIONS


def target_schema() -> T.StructType:
    """All target attributes; units and allowed values travel in the column metadata."""
    fields = [T.StructField(n, T.StringType()) for n in _TEXT]
    fields += [T.StructField(n, T.StringType(), True, {"allowed": list(v)}) for n, v in _OPTIONS.items()]
    fields += [T.StructField(n, T.BooleanType()) for n in _FLAGS]
    fields += [T.StructField(n, T.LongType()) for n in _COUNTS]
    fields += [T.StructField(n, T.DoubleType(), True, {"units": _UNITS[n]} if n in _UNITS else {}) for n in _NUMBERS]
    fields.append(T.StructField("additional_attributes", T.MapType(T.StringType(), T.StringType())))
    return T.StructType(fields)


# Spark type -> configured attribute type.
_KINDS = {"boolean": "boolean", "bigint": "integer", "double": "number", "date": "date", "timestamp": "datetime"}


def attribute_kind(name: str) -> str:
    if name == "geometry":
        return "geometry"
    return _KINDS.get(target_schema()[name].dataType.simpleString(), "string")


def attribute_units(name: str) -> str | None:
    return _UNITS.get(name)


def attribute_names() -> list[str]:
    """Every name a mapping may target: identity fields, validity dates and attributes."""
    return ["field_code", "effective_start_date", "effective_end_date", *target_schema().fieldNames()]
