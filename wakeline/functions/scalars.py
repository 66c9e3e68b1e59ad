"""Column-level parsing, formatting and classification rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline import schema as S

MICROS = 1_000_000


# --- time -----------------------------------------------------------------------------------------


# Times are TIMESTAMP values and the session time zone is UTC (see ``session.configure``): comparisons with
# literals then reach the Parquet scan, which the type without zone does not offer.


def at(text: str) -> Column:
    """A UTC time literal; ``T`` or a blank between date and time, seconds optional."""
    return F.lit(text.replace("T", " ")).cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def floor_div(value: Column, step: int) -> Column:
    """Exact integer division rounding towards minus infinity."""
    return ((value - F.pmod(value, F.lit(step))) / F.lit(step)).cast("bigint")


def epoch_second(ts: Column) -> Column:
    return floor_div(micros(ts), MICROS)


def to_millis(ts: Column) -> Column:
    """Stored times keep milliseconds."""
    return F.date_trunc("MILLISECOND", ts)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


# Accepted zone-less time formats, tried in this order.
LOCAL_TIME_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
]
# An ISO instant, with Z or a numeric offset and optional fraction.
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{0,9})?(Z|\+\d{2}:\d{2})$"


def _shape(time_format: str) -> str:
    """LIKE pattern with a placeholder for each digit."""
    return re.sub("[yMdHms]", "_", time_format.replace("'", ""))


def parse_time(text: Column) -> Column:
    """Text to UTC time; null when no format fits.

    Text that ends in ``Z`` or holds a ``+`` must be an ISO instant. Anything else is read as UTC
    without zone. Impossible dates such as February 30 give null.
    """
    zoned = text.endswith("Z") | text.contains("+")
    instant = F.when(text.rlike(ISO_INSTANT), F.try_to_timestamp(text))
    # A failed attempt costs an exception, so a format is only tried on text of its shape.
    local = F.coalesce(
        *[F.when(text.like(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in LOCAL_TIME_FORMATS]
    )
    return F.when(zoned, instant).otherwise(local)


# --- numbers and text -----------------------------------------------------------------------------

# Markers that stand for an absent text value.
UNKNOWN_MARKERS = ["unknown", "undefined", "n/a"]


def strip(text: Column) -> Column:
    """Remove blanks, tabs and line ends on both sides; most text has none and is passed on untouched."""
    edges = (F.substring(text, 1, 1) <= " ") | (F.substring(text, -1, 1) <= " ")
    return F.when(edges, F.trim(text, F.lit(" \t\n\r\f\v"))).otherwise(text)


def strict_long(text: Column) -> Column:
    return text.try_cast("bigint")


def strict_double(text: Column) -> Column:
    return text.try_cast("double")


def lenient_float(text: Column) -> Column:
    return text.try_cast("float")


def lenient_int(text: Column) -> Column:
    """Whole part of a number given as text (``'1.0'`` is 1); null for anything else."""
    return text.try_cast("double").try_cast("int")


def null_if_unknown(text: Column) -> Column:
    return F.when((text != "") & ~F.lower(text).isin(UNKNOWN_MARKERS), text)


def trim_padding(text: Column) -> Column:
    """Strip blanks and the ``@`` padding of broadcast text fields; empty becomes null."""
    clean = F.trim(F.translate(text, "@", " "))
    return F.when(clean != "", clean)


def dimension_sum(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, (a + b).cast("float"))


# --- vessel and position display values -------------------------------------------------------------


def _category_of_code(code: Column) -> Column:
    # Ship type code groups. 36 and 37 come before the 30s.
    return (
        F.when(code.isin(36, 37), "sailing_pleasure")
        .when(code.between(70, 79), "cargo")
        .when(code.between(80, 89), "tanker")
        .when(code.between(60, 69), "passenger")
        .when(code.between(30, 39), "fishing")
        .when(code.between(50, 59), "special")
        .when(code.between(40, 49), "high_speed")
        .otherwise("other")
    )


def ship_category(ship_type: Column, ship_type_desc: Column) -> Column:
    """Ship category: the numeric code wins, then a number given as text, then words in the text."""
    text = F.lower(ship_type_desc)
    as_number = ship_type_desc.try_cast("double")
    as_number = F.when(~F.isnan(as_number), as_number)
    by_words = (
        F.when(text.contains("cargo"), "cargo")
        .when(text.contains("tanker"), "tanker")
        .when(text.contains("passenger"), "passenger")
        .when(text.contains("fishing"), "fishing")
        .when(text.contains("sailing") | text.contains("pleasure"), "sailing_pleasure")
        .when(text.contains("tug") | text.contains("sar") | text.contains("pilot"), "special")
        .when(text.contains("high") & text.contains("speed"), "high_speed")
        .otherwise("other")
    )
    return (
        F.when(ship_type.isNotNull(), _category_of_code(ship_type))
        .when(as_number.isNotNull(), _category_of_code(as_number))
        .otherwise(by_words)
    )


def length_class(length_m: Column) -> Column:
    return (
        F.when(length_m.isNull(), "unknown")
        .when(length_m < 50, "small")
        .when(length_m < 200, "medium")
        .otherwise("large")
    )


def display_bearing(cog: Column, heading: Column) -> Column:
    """Course over ground, else a known heading, else 0."""
    course = F.when(~F.isnan(cog), cog.cast("double"))
    bow = F.when(heading != S.HEADING_UNAVAILABLE, heading.cast("double"))
    return F.coalesce(course, bow, F.lit(0.0))


# Navigation status labels.
NAV_STATUS_LABELS = {
    0: "Under way (engine)",
    1: "At anchor",
    2: "Not under command",
    3: "Restricted maneuverability",
    4: "Constrained by draught",
    5: "Moored",
    6: "Aground",
    7: "Engaged in fishing",
    8: "Under way (sailing)",
    15: "Undefined",
}


def nav_status_label(nav_status: Column) -> Column:
    label = F.when(nav_status.isNull(), "—")
    for code, text in NAV_STATUS_LABELS.items():
        label = label.when(nav_status == code, text)
    return label.otherwise(F.concat(F.lit("Status "), nav_status.cast("string")))


def _one_decimal(value: Column, unit: str) -> Column:
    # The decimal rounds half up on the exact value, as the display does.
    return F.concat(value.cast("double").cast("decimal(38,20)").cast("decimal(20,1)").cast("string"), F.lit(unit))


def display_name(vessel_name: Column, mmsi: Column) -> Column:
    return F.coalesce(vessel_name, F.concat(F.lit("MMSI "), mmsi.cast("string")))


def sog_label(sog: Column) -> Column:
    return _one_decimal(sog, " kn")


def cog_label(cog: Column) -> Column:
    return _one_decimal(cog, "°")


def summary_label(ship_type_desc: Column, sog: Column) -> Column:
    """The non-empty parts joined by a middle dot."""
    return F.concat_ws(" · ", F.when(ship_type_desc != "", ship_type_desc), sog_label(sog))


def voyage_id(mmsi: Column, start: Column) -> Column:
    return F.concat_ws("_", mmsi.cast("string"), epoch_second(start).cast("string"))
