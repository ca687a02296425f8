"""Cleaning of vendor texts, times and figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_padding(x) -> Column:
    """Trailing '@' padding and blanks go; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(_col(x)), r"[@\s]+$", "")), F.lit(""))


def blank_to_null(x) -> Column:
    """Null for '', 'nan' and 'none' in any case."""
    clean = F.trim(_col(x))
    return F.when(~F.lower(clean).isin("", "nan", "none"), clean)


def vendor_time(x) -> Column:
    """'2026-07-28 17:13:08.621081171 +0000 UTC' to a timestamp, cut to microseconds; null where it does not parse."""
    x = F.trim(_col(x))
    whole = F.regexp_extract(x, r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)", 1)
    part = F.regexp_extract(x, r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\.(\d{1,6})", 1)
    zone = F.regexp_extract(x, r"([+-]\d\d):?(\d\d)(?: [A-Z]+)?$", 0)
    offset = F.when(zone != "", F.concat(F.substring(zone, 1, 3), F.lit(":"), F.regexp_extract(zone, r"^[+-]\d\d:?(\d\d)", 1))).otherwise("+00:00")
    text = F.concat(F.translate(whole, "T", " "), F.lit("."), F.rpad(F.when(part != "", part).otherwise("0"), 6, "0"), offset)
    return F.when(whole != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSXXX")))


def iso_utc(x) -> Column:
    """ISO-8601 text in UTC; the fraction is left out where it is zero."""
    micros = F.date_format(_col(x), "SSSSSS")
    return F.concat(F.date_format(_col(x), "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def event_time(x) -> Column:
    """Event time of a contract's ISO text: its first 19 characters, T as a blank."""
    return F.try_to_timestamp(F.replace(F.substring(_col(x), 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))


def figure(x) -> Column:
    """A number from a cell with thousands separators or words ('Division by zero!' is null); plain scientific notation holds."""
    plain = F.expr(f"try_cast({_name(x)} AS double)")
    scrubbed = F.regexp_replace(_col(x).cast("string"), r"[^0-9.\-]", "")
    return F.coalesce(plain, scrubbed.try_cast("double"))


def _name(x) -> str:
    if not isinstance(x, str):
        raise TypeError("a column name is needed")
    return "`" + x.replace("`", "``") + "`"


def first_figure(x) -> Column:
    """The first number within a text."""
    return F.nullif(F.regexp_extract(_col(x).cast("string"), r"([0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")


def plain_destination(x) -> Column:
    """Upper case, A-Z and 0-9 only; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(_col(x)), "[^A-Z0-9]", ""), F.lit(""))


def age_text(minutes) -> Column:
    m = _col(minutes)
    return (
        F.when(m < 1, "ahora mismo")
        .when(m < 60, F.concat(F.lit("hace "), F.floor(m + 0.5).cast("string"), F.lit(" min")))
        .when(m < 48 * 60, F.format_string("hace %.1f h", m / 60))
        .otherwise(F.concat(F.lit("hace "), F.floor(m / 1440 + 0.5).cast("string"), F.lit(" d")))
    )


def clock_utc(x) -> Column:
    return F.coalesce(F.date_format(_col(x), "HH:mm 'UTC'"), F.lit("—"))
