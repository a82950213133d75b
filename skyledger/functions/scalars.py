"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The population names.
DIA, SSO, AMBIGUOUS = "DIA", "SSO", "AMBIGUOUS"


def population(is_sso: Column, object_id: Column) -> Column:
    """DIA: not solar-system and a positive object id. SSO: solar-system and no object (null or 0). All else,
    null flags and negative ids among it, is ambiguous."""
    dia = ~is_sso & (object_id > 0)
    sso = is_sso & (object_id.isNull() | (object_id == 0))
    return F.when(dia, F.lit(DIA)).when(sso, F.lit(SSO)).otherwise(F.lit(AMBIGUOUS))


def number(column: Column) -> Column:
    """A double, or null where there is none; NaN is missing too, as in data frames."""
    return F.nanvl(column.cast("string").try_cast("double"), F.lit(None).cast("double"))


def sky_cell(ra: Column, dec: Column, ra_bins: int, dec_bins: int) -> Column:
    """``ra_bin-dec_bin`` of a grid over the sky; the upper edges belong to the last bins."""
    i = F.least(F.floor(ra * ra_bins / F.lit(360.0)), F.lit(ra_bins - 1))
    j = F.least(F.floor((dec + 90) * dec_bins / F.lit(180.0)), F.lit(dec_bins - 1))
    return F.concat_ws("-", i.cast("string"), j.cast("string"))


def angular_distance(ra: Column, dec: Column, ra0: float, dec0: float) -> Column:
    """Arc seconds between two directions in degrees (haversine)."""
    a = F.pow(F.sin(F.radians(dec - dec0) / 2), 2) + F.cos(F.radians(dec)) * F.cos(F.radians(F.lit(dec0))) * F.pow(F.sin(F.radians(ra - ra0) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))) * 3600


def slug(text: Column) -> Column:
    """A safe column name: lower case, other characters than letters and digits as single underscores."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def canonical_map_json(m: Column) -> Column:
    """JSON of a map with its keys in order, so that equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def text_of_bytes(b: Column) -> Column:
    """Bytes for JSON: as text where they are UTF-8, else in base 64, on one line."""
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.translate(F.base64(b), "\r\n", ""))


def packet_type(content: Column) -> Column:
    """``full``, ``medium``, ``light_static`` or ``unknown`` from a run's content text; the first of them that it speaks of."""
    text = F.lower(F.coalesce(content, F.lit("")))
    light = text.contains("light") | text.contains("static")
    return F.when(text.contains("full"), F.lit("full")).when(text.contains("medium"), F.lit("medium")).when(light, F.lit("light_static")).otherwise(F.lit("unknown"))
