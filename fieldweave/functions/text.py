"""Names, flags and codes taken from text."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a Unicode decomposition (fixed values).
SINGLE_LETTERS = {"ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t"}
LETTER_GROUPS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ŋ": "ng"}


def latin_letter_pairs() -> tuple[str, str]:
    """Accented lower-case Latin letters and their plain forms, position by position."""
    accented, plain = [], []
    for code in range(0x00C0, 0x0180):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter.islower() and base.isascii():
            accented.append(letter)
            plain.append(base)
    accented += list(SINGLE_LETTERS)
    plain += list(SINGLE_LETTERS.values())
    return "".join(accented), "".join(plain)


def normalize_name(name: Column) -> Column:
    """Lower-case ASCII form of a Latin-script name; null stays null."""
    accented, plain = latin_letter_pairs()
    out = F.translate(F.lower(name), accented, plain)
    for letter, letters in LETTER_GROUPS.items():
        out = F.replace(out, F.lit(letter), F.lit(letters))
    return out


def code_from_text(text: Column, codes: Mapping[str, object]) -> Column:
    """Value of ``codes`` for the normalized text, null for anything else."""
    norm = normalize_name(text)
    out = F.lit(None)
    for word, code in reversed(list(codes.items())):
        out = F.when(norm == word, F.lit(code)).otherwise(out)
    return out


# Words of the sources (fixed values).
UNIT_WORDS = {"oil": "oil", "gas": "gas"}
UNIT_WORDS_PT = {"oleo": "oil", "gas": "gas"}
SHORE_WORDS = {"onshore": 0, "offshore": 1}
LOCATION_WORDS = {"earth": 0, "sea": 1}


def unit_from_text(text: Column, words: Mapping[str, str] = UNIT_WORDS) -> Column:
    return code_from_text(text, words)


def offshore_flag(text: Column, words: Mapping[str, int] = SHORE_WORDS) -> Column:
    return code_from_text(text, words)


# Method words of the commercial source and the target flag each one sets (fixed values).
METHOD_TARGETS = {
    "artificiallift": "downhole_pump",
    "co2flooding": "gas_flooding",
    "nitrogenflooding": "gas_flooding",
    "waterdrive": "water_flooding",
    "steamflooding": "steam_flooding",
    "waterinjection": "water_reinjection",
}


def method_tokens(columns: Sequence[Column]) -> Column:
    cleaned = [F.lower(F.replace(c, F.lit(" "), F.lit(""))) for c in columns]
    return F.split(F.concat_ws(",", *cleaned), ",")


def multi_hot_methods(columns: Sequence[Column], targets: Mapping[str, str] = METHOD_TARGETS) -> dict[str, Column]:
    """One 0/1 column per target flag, from the words of several method columns."""
    tokens = method_tokens(columns)
    flags: dict[str, Column] = {}
    for target in dict.fromkeys(targets.values()):
        words = F.array(*[F.lit(w) for w, t in targets.items() if t == target])
        flags[target] = F.coalesce(F.arrays_overlap(tokens, words), F.lit(False)).cast("int")
    return flags


def strip_suffix(text: Column, suffixes: Sequence[str]) -> Column:
    return F.regexp_replace(text, f"({'|'.join(suffixes)})$", "")


def rename_suffix(text: Column, pairs: Mapping[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.regexp_replace(text, f"{old}$", new)
    return text


def month_number(text: Column) -> Column:
    """First one or two digits of a month text."""
    return F.regexp_extract(text.cast("string"), r"(\d{1,2})", 1).try_cast("int")


def year_from_text(text: Column) -> Column:
    """Characters 7 to 10 of a day-first date text."""
    return F.substring(text, 7, 4)


def coerce_number(text: Column, default: float | None = None) -> Column:
    number = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    return number if default is None else F.coalesce(number, F.lit(default))


# Accepted upload kinds (fixed values).
FILE_KINDS = ("csv", "json", "geojson", "shp", "xls", "xlsx", "txt", "zip", "gdb", "gpkg", "kml", "other")


def file_kind(file_name: Column) -> Column:
    """Lower-cased extension, ``other`` for an unknown one, null (a reject) where a name has none."""
    ext = F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1))
    return F.when(ext == "", F.lit(None)).when(ext.isin(*FILE_KINDS), ext).when(ext.isNotNull(), F.lit("other"))
