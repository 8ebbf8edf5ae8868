"""Acceleration units as Column expressions: gal, m/s^2 and g."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD_GRAVITY = 9.80665
#: Metres per second squared in each unit.
FACTORS = {"gal": 0.01, "m/s^2": 1.0, "g": STANDARD_GRAVITY}
#: Accepted spellings, in lower case without spaces.
ALIASES = {
    "gal": "gal", "gals": "gal", "cm/s^2": "gal", "cm/s2": "gal", "cm/s/s": "gal", "gal(cm/s/s)": "gal", "gal(cm/s^2)": "gal", "gal(cm/s2)": "gal",
    "m/s^2": "m/s^2", "m/s2": "m/s^2", "m/s/s": "m/s^2", "mps2": "m/s^2",
    "g": "g", "standardgravity": "g",
}


def parse_unit(text: str) -> str:
    """The canonical unit of a spelling; ValueError for others."""
    key = str(text).strip().lower().replace("²", "2").replace(" ", "")
    if key not in ALIASES:
        raise ValueError(f"Unknown acceleration unit {text!r}; use one of {', '.join(FACTORS)}.")
    return ALIASES[key]


def unit_column(text: Column) -> Column:
    """parse_unit for a column; an unknown spelling stops the query, null stays null."""
    key = F.replace(F.replace(F.lower(F.trim(text)), F.lit("²"), F.lit("2")), F.lit(" "), F.lit(""))
    out = F.when(key.isNull(), F.lit(None).cast("string"))
    for name in FACTORS:
        out = out.when(key.isin([k for k, v in ALIASES.items() if v == name]), F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("Unknown acceleration unit "), text)))


def conversion_factor(source: str, target: str) -> float:
    return FACTORS[parse_unit(source)] / FACTORS[parse_unit(target)]


def factor_column(unit: Column) -> Column:
    """Gal per unit, for a column of canonical unit names."""
    out = F.when(unit == "gal", F.lit(1.0))
    for name, factor in FACTORS.items():
        if name != "gal":
            out = out.when(unit == name, F.lit(factor / FACTORS["gal"]))
    return out


def convert(value: Column, source: str, target: str) -> Column:
    factor = conversion_factor(source, target)
    return value.cast("double") if factor == 1.0 else value.cast("double") * F.lit(factor)


def to_gal(value: Column, unit: str = "gal") -> Column:
    return convert(value, unit, "gal")
