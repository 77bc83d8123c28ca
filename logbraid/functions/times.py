"""Timestamps: parsing, text form, tiles."""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the two timestamp shapes of application server logs.
TOMCAT_TS = r"\d{2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2}:\d{2}\.\d{3}|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"

# A zone given by name only (other than UTC, GMT and Z) carries no offset; it is read as UTC.
_NAMED_ZONE = r"\s*(?!(?:UTC|GMT)$)[A-Z]{3,5}$"


def utc(moment: datetime) -> datetime:
    """A moment without a zone is UTC."""
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment


def epoch_ms_or_now(ms: Column, now: Column) -> Column:
    return F.coalesce(F.timestamp_millis(ms), now)


def parse_tomcat_ts(text: Column) -> Column:
    """First timestamp anywhere in the text; null if there is none or it is no valid time."""
    found = F.regexp_extract(text, f"({TOMCAT_TS})", 1)
    return F.coalesce(
        F.try_to_timestamp(found, F.lit("dd-MMM-yyyy HH:mm:ss.SSS")),
        F.try_to_timestamp(found, F.lit("yyyy-MM-dd HH:mm:ss")),
    )


#: Further forms of timestamps, tried in this order, and what a text of each form looks like: other texts don't reach the parser.
OTHER_FORMS = (
    ("yyyy-MM-dd HH:mm:ss,SSS", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}$"),
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d{2}/\d{2} "),
    ("MMM d yyyy HH:mm:ss", r"^[A-Za-z]{3} \d{1,2} \d{4} "),
    ("yyyyMMdd'T'HHmmssX", r"^\d{8}T\d{6}"),
    ("dd-MMM-yy hh.mm.ss.SSSSSS a", r"^\d{2}-[A-Za-z]{3}-\d{2} "),
)
#: What a cast can read begins with a year.
_CASTABLE = r"^[+-]?\d{4,6}(?:$|-)"


def parse_ts_or_now(text: Column, now: Column) -> Column:
    """Missing text gives `now`; text that is no timestamp gives null, as does a time of day alone."""
    missing = text.isNull() | (text == "")
    trimmed = F.trim(text)
    # A name of a zone ends in a capital letter.
    plain = F.when(trimmed.rlike("[A-Z]$"), F.regexp_replace(trimmed, _NAMED_ZONE, "")).otherwise(trimmed)
    cast = F.when(plain.rlike(_CASTABLE), plain.try_cast("timestamp"))
    forms = [F.when(plain.rlike(like), F.try_to_timestamp(plain, F.lit(form))) for form, like in OTHER_FORMS]
    return F.when(missing, now).otherwise(F.coalesce(cast, *forms))


def iso_text(ts: Column) -> Column:
    """ISO text with offset; microseconds appear only when they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(whole, fraction, F.date_format(ts, "xxx"))


def floor_tile(us: Column, width_us: int) -> Column:
    """Number of the tile of `width_us` microseconds that holds `us`; exact for negative values."""
    width = F.lit(width_us)
    return F.call_function("div", us - F.pmod(us, width), width)
