"""XML Schema values as column expressions.

``canonical(text, datatype)`` is a string that two texts share exactly if they are valid and mean the same
value; it is null for texts that are no valid form.  Everything stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"
_ZONE = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_YEAR4 = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_DATE = r"(-?(?:[1-9][0-9]{3,}|0[0-9]{3}))-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_TIME = r"(?:([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])(\.[0-9]+)?|(24):00:00(?:\.0+)?)"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def _plain_decimal(t: Column) -> Column:
    whole = F.regexp_extract(t, r"^[+-]?0*([0-9]*)", 1)
    frac = F.regexp_replace(F.regexp_extract(t, r"\.([0-9]*)$", 1), "0+$", "")
    sign = F.when(t.startswith("-"), "-").otherwise("")
    body = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)))
    return F.when(body == "0", "0").otherwise(F.concat(sign, body))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 in the proleptic Gregorian calendar, for any year."""
    y = y - (m <= 2).cast("long")
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _shift(t: Column) -> Column:
    """Seconds that the zone at the end of a valid date or time is ahead of UTC."""
    zone = F.right(t, F.lit(6))
    minutes = F.substring(zone, 2, 2).try_cast("long") * 60 + F.substring(zone, 5, 2).try_cast("long")
    return F.when(F.substring(zone, 4, 1) == ":", F.when(zone.startswith("-"), minutes * -60).when(zone.startswith("+"), minutes * 60).otherwise(0)).otherwise(0)


def _frac(t: Column) -> Column:
    return F.when(t.contains("."), F.regexp_replace(F.regexp_extract(t, r"(\.[0-9]+)", 1), r"\.?0*$", "")).otherwise("")


def _far(t: Column, timed: bool) -> Column:
    """Years before 0 or of more than four digits: the parts lie at fixed distances from the hyphen after the year.  Each is bound once."""
    num = lambda at, first: F.coalesce(F.substr(t, at + first, F.lit(2)).try_cast("long"), F.lit(0))

    def parts(at: Column) -> Column:
        clock = num(at, 7) * 3600 + num(at, 10) * 60 + num(at, 13) if timed else F.lit(0).cast("long")
        year = F.coalesce(F.substr(t, F.lit(1), at - 1).try_cast("long"), F.lit(0))
        return F.struct(at.alias("at"), year.alias("y"), num(at, 1).alias("m"), num(at, 4).alias("d"), (clock - _shift(t)).alias("s"), (_frac(t) if timed else F.lit("")).alias("f"))

    def value(x: Column) -> Column:
        text = F.concat((_days(x["y"], x["m"], x["d"]) * 86400 + x["s"]).cast("string"), x["f"])
        # years of more than 12 digits are compared as they are written
        return F.when(x["d"] <= _month_days(x["y"], x["m"]), F.when(x["at"] > 14, t).otherwise(text))

    return F.transform(F.transform(F.array(F.locate("-", t, 2)), parts), value)[0]


def _instant(t: Column, timed: bool) -> Column:
    """Seconds from 1970 and, for times, their fraction.  24:00:00 is the next day's first second."""
    tail = f"T{_TIME}{_ZONE}" if timed else _ZONE
    seconds = F.unix_date(F.substring(t, 1, 10).try_cast("date")).cast("long") * 86400 - _shift(t)
    if timed:
        num = lambda first: F.substring(t, first, 2).try_cast("long")
        seconds = seconds + num(12) * 3600 + num(15) * 60 + num(18)
    text = F.concat(seconds.cast("string"), _frac(t)) if timed else seconds.cast("string")
    return F.when(t.rlike(f"^{_YEAR4}{tail}\\z"), text).when(t.rlike(f"^{_DATE}{tail}\\z"), _far(t, timed))


def written_day(text: Column) -> Column:
    """The day of a valid date as it is written, without its zone."""
    t = trimmed(text)
    return F.when(t.rlike("^" + _YEAR4), F.substring(t, 1, 10)).otherwise(F.regexp_extract(t, "^" + _DATE, 0))


def canonical(text: Column, datatype: str) -> Column:
    t = trimmed(text)
    match datatype:
        case "xsd:string":
            return text
        case "xsd:boolean":
            return F.when(t.isin("true", "1"), "true").when(t.isin("false", "0"), "false")
        case "xsd:integer":
            return F.when(t.rlike(r"^[+-]?[0-9]+\z"), t.try_cast("long").cast("string"))
        case "xsd:decimal":
            return F.when(t.rlike(rf"^{_NUMBER}\z"), _plain_decimal(t))
        case "xsd:double":
            return (
                F.when(t.rlike(rf"^{_NUMBER}([eE][+-]?[0-9]+)?\z"), (t.try_cast("double") + F.lit(0.0)).cast("string"))
                .when(t.isin("INF", "+INF"), "Infinity")
                .when(t == "-INF", "-Infinity")
                .when(t == "NaN", "NaN")
            )
        case "xsd:date":
            return _instant(t, timed=False)
        case "xsd:dateTime":
            return _instant(t, timed=True)
    raise ValueError(f"unknown datatype {datatype}")


def typed(canon: Column, datatype: str) -> Column:
    """The typed value of a canonical string, or of the written day for dates, which keep their day whatever their zone.  Null
    outside the type: decimals beyond DECIMAL(38, 18), dates and times outside the years 1 to 9999."""
    match datatype:
        case "xsd:string":
            return canon
        case "xsd:boolean":
            return canon == "true"
        case "xsd:integer":
            return canon.try_cast("long")
        case "xsd:decimal":
            return canon.try_cast("decimal(38,18)")
        case "xsd:double":
            return canon.try_cast("double")
        case "xsd:date":
            return F.when(canon.rlike(r"^[0-9]{4}-") & ~canon.startswith("0000"), canon.try_cast("date"))
        case "xsd:dateTime":
            sec = F.regexp_extract(canon, r"^(-?[0-9]+)", 1).try_cast("long")
            micro = F.rpad(F.regexp_extract(canon, r"\.([0-9]+)", 1), 6, "0").try_cast("long")
            ok = sec.between(-62135596800, 253402300799)
            return F.when(ok, F.timestamp_micros(sec * 1_000_000 + micro).cast("timestamp"))
    raise ValueError(f"unknown datatype {datatype}")


def inexact(canon: Column, datatype: str) -> Column:
    """Whether ``typed`` gives null for a canonical string, or drops digits: decimals keep 18 places, times 6."""
    places = {"xsd:decimal": 18, "xsd:dateTime": 6}.get(datatype)
    none = typed(canon, datatype).isNull()
    return none if places is None else none | canon.rlike(rf"\.[0-9]{{{places + 1}}}")
