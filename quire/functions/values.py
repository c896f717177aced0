"""Text to number, time and truth value and back, by invariant-culture rules.

The plain-Python functions define the accepted forms for the literals of a
pipeline spec; the Column functions apply the same forms to cells.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: accepted forms -------------------------------------------
# A number: blanks around, one sign before or after, or parentheses for minus,
# thousands commas, decimal point, exponent.
_MAGNITUDE = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_BLANK = r"[ \t\n\x0B\f\r]*"
NUMBER = (
    rf"^{_BLANK}(?:[+-]?{_MAGNITUDE}{_BLANK}|{_MAGNITUDE}{_BLANK}[+-]{_BLANK}|"
    rf"\({_MAGNITUDE}{_BLANK}\){_BLANK})$"
)
_NEGATIVE = rf"^{_BLANK}[-(]|-{_BLANK}$"
SPECIAL_NUMBER = rf"(?i)^{_BLANK}([+-]?infinity|[+-]?nan){_BLANK}$"
INTEGER = rf"^{_BLANK}[+-]?[0-9]+{_BLANK}$"

# A date with an optional time, as year-month-day (with an optional zone, else
# UTC) or as month/day/year.
ISO_TIME = (
    r"^\s*([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[T ]([0-9]{1,2}):([0-9]{2})"
    r"(?::([0-9]{2})(?:\.([0-9]{1,7}))?(Z|[+-][0-9]{2}:[0-9]{2})?)?)?\s*$"
)
US_TIME = (
    r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    r"(?: ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,7}))?)?)?\s*$"
)
US_HALF_DAY = (
    r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{2}):([0-9]{2}) ([AaPp][Mm])\s*$"
)
# -----------------------------------------------------------------------------


# ---- literals (driver side) ---------------------------------------------------
def parse_number(text: str) -> float | None:
    if match := re.match(SPECIAL_NUMBER, text):
        word = match.group(1).lower()
        if word.endswith("nan"):
            return math.nan
        return -math.inf if word.startswith("-") else math.inf
    if not re.match(NUMBER, text):
        return None
    value = float(re.search(_MAGNITUDE, text).group(0).replace(",", ""))
    return -value if re.search(_NEGATIVE, text) else value


def parse_time(text: str) -> datetime | None:
    """UTC time without zone, microseconds kept."""
    try:
        fraction = zone = None
        if match := re.match(ISO_TIME, text):
            year, month, day, hour, minute, second, fraction, zone = match.groups()
        elif match := re.match(US_TIME, text):
            month, day, year, hour, minute, second, fraction = match.groups()
        elif match := re.match(US_HALF_DAY, text):
            month, day, year, hour, minute, second, half = match.groups()
            if not 1 <= int(hour) <= 12:
                return None
            hour = int(hour) % 12 + (12 if half.lower() == "pm" else 0)
        else:
            return None
        micros = int((fraction or "0").ljust(6, "0")[:6])
        value = datetime(
            int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0), micros
        )
        if zone and zone != "Z":
            offset = timedelta(hours=int(zone[1:3]), minutes=int(zone[4:6]))
            if offset > timedelta(hours=18) or int(zone[4:6]) > 59:
                return None
            value -= offset if zone[0] == "+" else -offset
        return value
    except (ValueError, OverflowError):
        return None


def parse_bool(text: str) -> bool | None:
    return {"true": True, "false": False}.get(text.strip().lower())


# ---- cells --------------------------------------------------------------------
def number_of(text: Column) -> Column:
    """Number a text stands for, else null."""
    digits = F.replace(F.regexp_extract(text, _MAGNITUDE, 0), F.lit(","), F.lit(""))
    value = digits.try_cast("double")
    signed = F.when(text.rlike(_NEGATIVE), -value).otherwise(value)
    word = F.lower(F.regexp_extract(text, SPECIAL_NUMBER, 1))
    special = (
        F.when(word.endswith("nan"), F.lit(math.nan))
        .when(word.startswith("-"), F.lit(-math.inf))
        .otherwise(F.lit(math.inf))
    )
    return F.when(text.rlike(NUMBER), signed).when(text.rlike(SPECIAL_NUMBER), special)


def time_of(text: Column) -> Column:
    """Time a text stands for (UTC, without zone), else null.

    The session must run in UTC, which ``session.configure`` sees to.
    """
    iso = F.replace(F.trim(text), F.lit("/"), F.lit("-")).try_cast("timestamp")
    american = F.regexp_replace(text, r"^\s*(\d+)/(\d+)/(\d+)(.*?)\s*$", "$3-$1-$2$4").try_cast("timestamp")
    half_day = F.try_to_timestamp(F.trim(text), F.lit("M/d/yyyy h:mm:ss a"))
    return (
        F.when(text.rlike(ISO_TIME), iso)
        .when(text.rlike(US_TIME), american)
        .when(text.rlike(US_HALF_DAY), half_day)
        .cast("timestamp_ntz")
    )


def real_text(value: Column) -> Column:
    """A floating-point number as text, without ``.0`` and exponents where short.

    Spark writes ``1.0E7`` and ``1.0``, where the invariant form is ``10000000``
    and ``1``; from 1E+15 up and below 1E-04 that form has an exponent too.
    """
    raw = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(
        F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    exponent = F.substring_index(raw, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, "E-").otherwise("E+"), F.format_string("%02d", F.abs(exponent)))
    # Spark only uses an exponent from 1E7 up or below 1E-3, so one is there when needed.
    return (
        F.when(F.isnan(value) | (size == math.inf), raw)
        .when((value == 0) | ((size >= 1e-4) & (size < 1e15)), plain)
        .otherwise(scientific)
    )


def text_of(value: Column, dtype: str) -> Column:
    """Any cell as invariant text."""
    if dtype in ("float", "double"):
        return real_text(value)
    if dtype == "boolean":
        return F.when(value, "True").when(~value, "False")
    if dtype.startswith("timestamp") or dtype == "date":
        return F.date_format(value, "MM/dd/yyyy HH:mm:ss")
    return value.cast("string")
