"""Column recoding from the older model inputs to the newer target schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Options of the newer schema in code order (fixed values).
FLOOD_GASES = {1: "NG", 2: "N2", 3: "CO2"}
CO2_SOURCES = {1: "Natural subsurface reservoir", 2: "Anthropogenic"}
UPGRADERS = {0: "None", 1: "Delayed coking", 2: "Hydroconversion", 3: "Combined"}
GAS_PATHS = {
    1: "None",
    2: "Minimal",
    3: "Acid Gas",
    4: "Wet Gas",
    5: "Acid Wet Gas",
    6: "Sour Gas Reinjection",
    7: "CO2-EOR Membrane",
    8: "CO2-EOR Ryan Holmes",
}
RICHNESS = ("Low carbon", "Med carbon", "High carbon")
INTENSITY = ("Low", "Med", "High")


def option(code: Column, options: Mapping[int, str]) -> Column:
    """Option of a numeric code, null for a code without one."""
    out = F.lit(None).cast("string")
    for key, label in options.items():
        out = F.when(code.cast("int") == key, F.lit(label)).otherwise(out)
    return out


def first_set(flags: list[Column], labels: tuple[str, ...]) -> Column:
    """Label of the first flag that is set."""
    return F.coalesce(*[F.when(flag == 1, F.lit(label)) for flag, label in zip(flags, labels)])


def mine_type(with_upgrader: Column, without_upgrader: Column) -> Column:
    up, dil = F.coalesce(with_upgrader == 1, F.lit(False)), F.coalesce(without_upgrader == 1, F.lit(False))
    known = with_upgrader.isNotNull() | without_upgrader.isNotNull()
    return (
        F.when(up & dil, "Integrated with both")
        .when(up, "Integrated with upgrader")
        .when(dil, "Integrated with diluent")
        .when(known, "None")
    )


# Older input column -> newer attribute, plain renames (fixed values).
RENAMES = {
    "Function unit": "functional_unit",
    "Downhole pump": "downhole_pump",
    "Water reinjection": "water_reinjection",
    "Natural gas reinjection": "natural_gas_reinjection",
    "Water flooding": "water_flooding",
    "Gas lifting": "gas_lifting",
    "Gas flooding": "gas_flooding",
    "Steam flooding": "steam_flooding",
    "Field location(Country)": "country",
    "Field name": "name",
    "Field depth": "depth",
    "Oil production volume": "oil_prod",
    "Number of producing wells": "num_prod_wells",
    "Number of water injecting wells": "num_water_inj_wells",
    "Production tubing diameter": "well_diam",
    "Productivity index": "prod_index",
    "Reservoir pressure": "res_press",
    "Reservoir temperature": "res_temp",
    "Offshore?": "offshore",
    'API gravity (oil at standard pressure and temperature, or "dead oil")': "api",
    "N2": "gas_comp_n2",
    "CO2": "gas_comp_co2",
    "C1": "gas_comp_c1",
    "C2": "gas_comp_c2",
    "C3": "gas_comp_c3",
    "C4+": "gas_comp_c4",
    "H2S": "gas_comp_h2s",
    "Gas-to-oil ratio (GOR)": "gor",
    "Water-to-oil ratio (WOR)": "wor",
    "Water injection ratio": "wir",
    "Gas lifting injection ratio": "glir",
    "Gas flooding injection ratio": "gfir",
    "Fraction of CO2 breaking through to producers": "frac_co2_breakthrough",
    "Percentage of sequestration credit assigned to the oilfield": "perc_sequestration_credit",
    "Steam-to-oil ratio (SOR)": "sor",
    "Fraction of required fossil electricity generated onsite": "fraction_elec_onsite",
    "Fraction of remaining natural gas reinjected": "fraction_remaining_gas_inj",
    "Fraction of produced water reinjected": "fraction_water_reinjected",
    "Fraction of steam generation via cogeneration": "fraction_steam_cogen",
    "Fraction of steam generation via solar thermal": "fraction_steam_solar",
    "Heater/treater": "heater_treater",
    "Stabilizer column": "stabilizer_column",
    "Flaring-to-oil ratio": "for_value",
    "Purposeful venting fraction (post-flare gas fraction vented)": "frac_venting",
    "Volume fraction of diluent": "fraction_diluent",
    "Ocean tanker_frac": "frac_transport_tanker",
    "Barge_frac": "frac_transport_barge",
    "Pipeline_frac": "frac_transport_pipeline",
    "Rail_frac": "frac_transport_rail",
    "Truck_frac": "frac_transport_truck",
    "Ocean tanker_dis": "transport_dist_tanker",
    "Barge_dis": "transport_dist_barge",
    "Pipeline_dis": "transport_dist_pipeline",
    "Rail_dis": "transport_dist_rail",
    "Truck_dis": "transport_dist_truck",
    "Ocean tanker size, if applicable": "ocean_tanker_size",
    "Small sources emissions": "small_sources_emissions",
}

# Columns that are recoded rather than renamed (fixed values).
FLOOD_GAS = "Flood gas"
CO2_SOURCE = "Source of makeup CO2"
UPGRADER = "Upgrader type"
GAS_PATH = "Associated Gas Processing Path"
START_YEAR = "Field age"
MINE_FLAGS = ("Oil sands mine (integrated with upgrader)", "Oil sands mine (non-integrated with upgrader)")
RICHNESS_FLAGS = (
    "Low carbon richness (semi-arid grasslands)",
    "Moderate carbon richness (mixed)",
    "High carbon richness (forested)",
)
INTENSITY_FLAGS = (
    "Low intensity development and low oxidation",
    "Moderate intensity development and moderate oxidation",
    "High intensity development and high oxidation",
)


def target_columns(available: list[str], as_of_year: int) -> list[Column]:
    """The newer attributes that the available older columns determine, as one select list."""
    have = set(available)
    col = lambda name: F.col(f"`{name}`") if name in have else F.lit(None).cast("int")
    out = [F.col(f"`{old}`").alias(new) for old, new in RENAMES.items() if old in have]
    for old, new, options in (
        (FLOOD_GAS, "flood_gas_type", FLOOD_GASES),
        (CO2_SOURCE, "co2_source", CO2_SOURCES),
        (UPGRADER, "upgrader_type", UPGRADERS),
        (GAS_PATH, "gas_processing_path", GAS_PATHS),
    ):
        if old in have:
            out.append(option(col(old), options).alias(new))
    if START_YEAR in have:
        out.append((F.lit(as_of_year) - col(START_YEAR)).alias("age"))
    if have & set(MINE_FLAGS):
        out.append(mine_type(*[col(c) for c in MINE_FLAGS]).alias("oil_sands_mine_type"))
    if have & set(RICHNESS_FLAGS):
        out.append(first_set([col(c) for c in RICHNESS_FLAGS], RICHNESS).alias("ecosystem_richness"))
    if have & set(INTENSITY_FLAGS):
        out.append(first_set([col(c) for c in INTENSITY_FLAGS], INTENSITY).alias("field_development_intensity"))
    return out
