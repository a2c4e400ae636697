"""Time columns. Every function takes ``as_of`` explicitly, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def raw_age_hours(as_of, c: Column) -> Column:
    return (F.unix_micros(ts(as_of)) - F.unix_micros(c)) / F.lit(3.6e9)


def age_hours(as_of, c: Column) -> Column:
    """Never negative; null dates count as age 0."""
    return F.coalesce(F.greatest(F.lit(0.0), raw_age_hours(as_of, c)), F.lit(0.0))


def hours_before(as_of, hours) -> Column:
    return F.timestamp_micros(F.unix_micros(ts(as_of)) - F.lit(int(hours * 3_600_000_000)))


def start_of_day(c) -> Column:
    return F.date_trunc("DAY", ts(c))


def end_of_day(c) -> Column:
    return F.timestamp_micros(F.unix_micros(start_of_day(c)) + F.lit(86_400_000_000 - 1))


def format_iso(c: Column) -> Column:
    """ISO 8601 with offset; the fraction appears only when it is not zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(c) % 1_000_000
    frac = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, frac, F.lit("+00:00"))


_ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ]\s*(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?\s*([+-]\d{2}(?::?\d{2})?)?$"
_RFC = r"^(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -](\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?\s*([+-]\d{2}(?::?\d{2})?)?$"


def parse_datetime(c: Column) -> Column:
    """ISO 8601 or RFC 2822, leniently: seconds, fractions of any length and offsets may be missing, years may have two
    digits. No offset, and a named zone other than an offset, means UTC; anything else is null."""
    # The weekday is redundant; zone names do not shift the time.
    s = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    s = F.regexp_replace(s, r"(?<=\d)\s*(Z|z)$|\s+[A-Z]{2,5}$", "")
    # Bound once: the forms below name the text many times.
    return F.get(F.transform(F.array(s), _read_datetime), F.lit(0))


def _read_datetime(s: Column) -> Column:
    def read(pattern: str, day: Column) -> Column:
        part = lambda i: F.regexp_extract(s, pattern, i)
        two = lambda i: F.lpad(part(i), 2, "0")
        zone = F.rpad(F.replace(part(8), F.lit(":"), F.lit("")), 5, "0")
        text = F.concat(day, F.lit(" "), two(4), F.lit(":"), two(5), F.lit(":"), two(6), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"),
                        F.when(part(8) == "", "+0000").otherwise(zone))
        return F.when(s.rlike(pattern), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSZ")))

    year = F.regexp_extract(s, _RFC, 3)
    full = F.when(F.length(year) == 4, year).when(year < "70", F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    names = "janfebmaraprmayjunjulaugsepoctnovdec"
    place = F.instr(F.lit(names), F.lower(F.regexp_extract(s, _RFC, 2)))
    month = F.lpad(F.floor((place + 2) / 3).cast("string"), 2, "0")
    iso_day = F.concat_ws("-", *[F.regexp_extract(s, _ISO, i) for i in (1, 2, 3)])
    rfc_day = F.concat_ws("-", full, month, F.lpad(F.regexp_extract(s, _RFC, 1), 2, "0"))
    return F.coalesce(read(_ISO, iso_day), read(_RFC, rfc_day))


def exponential_freshness(as_of, c: Column, hours: float = 24.0) -> Column:
    return F.exp(-age_hours(as_of, c) / F.lit(hours))
