"""Dates and times by named patterns, as column expressions: lenient reading, mandatory reading, writing, XSD, durations.

Reading by a pattern is lenient: the text may go on after it, and a month 13 or a day 31 of April rolls over. A text that
doesn't begin as the pattern says is null, or an error where the value is mandatory. Zones are the session's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named patterns.
FORMATS = {
    "XMLDATETIME": "yyyy-MM-dd'T'HH:mm:ss",
    "FULLXMLDATETIME": "yyyy-MM-dd'T'HH:mm:ss.SSSZ",
    "JAVAFULLXMLDATETIME": "yyyy-MM-dd'T'HH:mm:ss.SSSZ",
    "DATETIMEMS": "yyyyMMdd-HHmmss.SSS",
    "DATE": "yyyy-MM-dd",
    "SHORTDATE": "yyyyMMdd",
    "DATETIME": "yyyyMMdd-HHmmss",
    "UNREADABLEDATETIME": "yyyyMMddHHmmss",
    "DATETIME_AS_FOLDERNAME": "yyyyMMdd_HHmmss",
    "READABLEDATETIME": "yyyy-MM-dd' 'HH:mm:ss",
    "DAYFIRSTDATE": "dd-MM-yyyy",
    "DMY_HM": "dd-MM-yyyy HH:mm",
    "SHORT_TIME": "HH:mm",
    "TIME": "HH:mm:ss",
}
ISO = r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,9}(Z|[+-]\d\d:?\d\d)$"
XSD_DATETIME = r"^[+-]?\d{4,}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d(:\d\d(:\d\d)?)?)$"


def _fields(pattern: str) -> list[tuple[str, str]]:
    """("field", its letters) and ("text", characters), in order."""
    out = []
    for m in re.finditer(r"'((?:[^']|'')*)'|([A-Za-z])\2*|[^A-Za-z']+", pattern):
        out.append(("field", m[0]) if m[2] else ("text", m[1] if m[1] is not None else m[0]))
    return out


def _regex(pattern: str) -> tuple[str, list[str]]:
    """A regular expression with a group for each field. A field that another follows at once has its own width."""
    fields, said, names = _fields(pattern), ["^"], []
    for i, (kind, x) in enumerate(fields):
        if kind == "text":
            said.append(re.escape(x))
            continue
        next_ = i + 1 < len(fields) and fields[i + 1][0] == "field" and fields[i + 1][1][0] != "Z"
        said.append(r"([+-]\d{4})" if x[0] == "Z" else r"\s*(-?\d{" + str(len(x)) + "})" if next_ else r"\s*(-?\d{1,9})")
        names.append(x[0])
    return "".join(said), names


def parse(text: Column, name: str) -> Column:
    """The time that a text says by a named pattern; null where it says none."""
    if name == "FULLXMLDATETIME":
        return F.when(text.rlike(ISO), F.try_to_timestamp(text))
    regex, names = _regex(FORMATS[name])
    part = {x: F.regexp_extract(text, regex, i + 1) for i, x in enumerate(names)}
    number = lambda x, other: part[x].cast("int") if x in part else F.lit(other)
    month = F.add_months(F.make_date(number("y", 1970), F.lit(1), F.lit(1)), number("M", 1) - 1)
    day = F.date_add(month, number("d", 1) - 1)
    seconds = number("H", 0).cast("long") * 3600 + number("m", 0) * 60 + number("s", 0)
    zone = F.lit(0) if "Z" not in part else F.concat(F.substring(part["Z"], 1, 1), F.lit("1")).cast("int") * (F.substring(part["Z"], 2, 2).cast("int") * 3600 + F.substring(part["Z"], 4, 2).cast("int") * 60)
    days = F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("long")
    there = F.timestamp_millis((days * 86_400 + seconds - zone) * 1000 + number("S", 0))  # as if the session's zone were UTC
    if "Z" not in part:
        there = F.to_utc_timestamp(there, F.current_timezone())
    return F.when(text.rlike(regex), there)


def parse_mandatory(text: Column, name: str) -> Column:
    """parse(), an error where a text can't be read (null texts too)."""
    said = F.concat(F.lit("can't be read as "), F.lit(FORMATS[name]), F.lit(": "), F.coalesce(text, F.lit("null")))
    return F.coalesce(parse(text, name), F.raise_error(said).cast("timestamp"))


def parse_trimmed_date(text: Column) -> Column:
    """The date in the first ten characters; null for shorter texts."""
    return F.when(F.length(text) >= 10, parse(F.substring(text, 1, 10), "DATE"))


def format(time: Column, name: str) -> Column:  # noqa: A001
    """A time by a named pattern; null is the empty text."""
    pattern = FORMATS[name].replace("Z", "xx" if name != "FULLXMLDATETIME" else "XXX")
    return F.coalesce(F.date_format(time, pattern), F.lit(""))


def format_ms(time: Column, before: str = "") -> Column:
    """DATETIME with `before` and three digits of milliseconds."""
    return F.coalesce(F.concat(F.date_format(time, FORMATS["DATETIME"]), F.lit(before), F.date_format(time, "SSS")), F.lit(""))


def parse_xsd(text: Column) -> Column:
    """An xsd:dateTime with a zone; without one by XMLDATETIME in the session's; others are an error. Null stays null."""
    other = F.raise_error(F.concat(F.lit("no date and time: "), text)).cast("timestamp")
    full = F.regexp_replace(text, r"T(\d\d:\d\d)(Z|[+-])", "T$1:00$2")
    return F.when(text.isNull(), None).when(text.rlike(XSD_DATETIME), F.try_to_timestamp(full)).otherwise(F.coalesce(parse(text, "XMLDATETIME"), other))


def format_xsd(time: Column) -> Column:
    """An xsd:dateTime with milliseconds and the session's zone, Z for UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def duration(ms: Column) -> Column:
    """Milliseconds as HH:mm:ss:ms; hours have two digits or more, milliseconds aren't padded."""
    second, minute, hour = (F.floor(ms / k) for k in (1000, 60_000, 3_600_000))
    return F.format_string("%02d:%02d:%02d:%d", hour, minute - hour * 60, second - minute * 60, (ms - second * 1000).cast("long"))
