"""Problem 4: dates in many notations, precisions, calendars and clock zones as one start, one end and one flag.

A raw string is parsed once, ever: ``DateDictionary`` keeps every distinct (source, zone, raw) in a table of the
shared folder, a run parses only strings that are not in it yet, and the results are joined back to the rows. The
dictionary is pre-aggregated by ``distinct``, so a raw value that holds a third of all rows is one entry.

Results at the edges: null, empty and undated strings have no reading (starts and ends null); a date that does not
exist in its calendar has none either; a null flag counts as false.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.session import cut, shared_base

#: Raised when the parser changes, so that entries of an older one are not used.
PARSER_VERSION = 2

# Stems of month names in the languages of the archive, by number.
MONTH_STEMS = [
    (1, "янв", "jan"), (2, "фев", "feb", "fév", "fev"), (3, "мар", "mar", "mär"), (4, "апр", "apr", "avr"), (5, "май", "мая", "мае", "may", "mai"),
    (6, "июн", "іюн", "jun", "juin"), (7, "июл", "іюл", "jul", "juil"), (8, "авг", "aug", "août", "aou"), (9, "сен", "sep"), (10, "окт", "oct", "okt"),
    (11, "ноя", "nov"), (12, "дек", "dec", "dez", "déc"),
]
# Roman numerals of months and quarters.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
# Clock zones by name, in minutes east of Greenwich.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "мск": 180, "msk": 180, "mez": 60, "cet": 60, "mesz": 120, "cest": 120, "oez": 120, "eet": 120, "wet": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "bst": 60,
}

_MONTHS = {stem: n for n, *stems in MONTH_STEMS for stem in stems}
_M = "(?:" + "|".join(sorted(_MONTHS, key=len, reverse=True)) + r")[^\W\d_]*\.?"
_R = "(?:xii|xi|x|ix|viii|vii|vi|v|iv|iii|ii|i)"
_D, _Y = r"\d{1,2}", r"(?:1[5-9]|20)\d\d"
_CONJ = re.compile(r"[\[\]?]|предп|около|\bок\.|\bca?\.|circa|датируется|вероятно|приблиз|по содержанию|по почерку|не ранее|не позднее|um ")
_OLD = re.compile(r"\(?\s*(?:ст\.?\s*ст\.?|по ст(?:арому)?\.?\s*ст(?:илю)?\.?|старый стиль|старого стиля|o\.?\s*s\.)\s*\)?")
_NEW = re.compile(r"\(?\s*(?:н\.?\s*ст\.?|по н(?:овому)?\.?\s*ст(?:илю)?\.?|новый стиль|нового стиля|n\.?\s*s\.)\s*\)?")
_YEARWORD = re.compile(rf"({_Y})\s*(?:года|году|годы|год|гг\.|гг|г\.|г)(?![^\W\d_])")
_LABEL = re.compile(r"\((?:предп|датируется)[^)]*\)|\b(?:предположительно|предп\.|около|ок\.|датируется по содержанию|вероятно|circa|ca\.)")


def _month(word: str) -> int:
    for size in (4, 3):
        if word[:size] in _MONTHS:
            return _MONTHS[word[:size]]
    raise ValueError(word)


def _last(y: int, m: int) -> dt.date:
    return dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(1)


def julian(y: int, m: int, d: int) -> dt.date:
    """The Gregorian day of an old-style date."""
    if not (1 <= m <= 12 and 1 <= d <= (29 if m == 2 and y % 4 == 0 else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1])):
        raise ValueError((y, m, d))
    a = (14 - m) // 12
    number = d + (153 * (m + 12 * a - 3) + 2) // 5 + 365 * (y + 4800 - a) + (y + 4800 - a) // 4 - 32083
    return dt.date.fromordinal(number - 1721425)


# One pattern for a date of any precision; each alternative has its own group names.
_POINT = "|".join([
    rf"(?P<y1>{_Y})[-./](?P<m1>{_D})[-./](?P<d1>{_D})(?!\d)",  # year first
    rf"(?P<d2>{_D})[./-](?P<m2>{_D})[./-](?P<y2>{_Y})",  # day first
    rf"(?P<d3>{_D})[. ](?P<r3>{_R})[. ](?P<y3>{_Y})",  # Roman month
    rf"(?P<d4>{_D})\.?\s+(?P<n4>{_M})\s*,?\s*(?P<y4>{_Y})",  # named month
    rf"(?P<n5>{_M})\s+(?P<d5>{_D})(?:st|nd|rd|th)?,?\s+(?P<y5>{_Y})",  # month, day, year
    rf"(?P<y6>{_Y}),?\s+(?P<n6>{_M})\s+(?P<d6>{_D})(?!\d)",  # year, month, day
    rf"(?P<y7>{_Y}),?\s+(?P<n7>{_M})",
    rf"(?P<n8>{_M})\s*,?\s*(?P<y8>{_Y})",
    rf"(?P<r9>{_R})[. ](?P<y9>{_Y})",
    rf"(?P<m10>{_D})[./](?P<y10>{_Y})",
    rf"(?P<y11>{_Y})[-./](?P<m11>0[1-9]|1[0-2])(?!\d)",
    rf"(?P<y12>{_Y})",
])
_POINT_RE = re.compile(_POINT)
_DASH = r"\s*[-–—]\s*"
_DECADE = re.compile(rf"({_Y})[-–]?е")
_HALF = re.compile(rf"([12]|первая|вторая|i{{1,2}})(?:[-–]?я)?\s*(?:пол\.|половина|половины)\s*({_Y})")
_QUARTER = re.compile(rf"(iv|iii|ii|i|[1-4])(?:[-–]?й)?\s*(?:кв\.|квартал)\s*({_Y})")
_THIRD = re.compile(rf"(начало|середина|конец)\s*({_Y})")
_SHORT_YEARS = re.compile(rf"({_Y}){_DASH}(\d\d|{_Y})\s*(гг\.?|годы|года)?")
_DAY_RANGE = re.compile(rf"({_D}){_DASH}({_D})\s+({_M})\s*,?\s*({_Y})")
_MONTH_RANGE = re.compile(rf"({_M}){_DASH}({_M})\s*,?\s*({_Y})")
_ROMAN_RANGE = re.compile(rf"({_D})\.({_R}){_DASH}({_D})\.({_R})\.({_Y})")
_NUMBER_RANGE = re.compile(rf"({_D})\.({_D}){_DASH}({_D})\.({_D})\.({_Y})")
_NAMED_RANGE = re.compile(rf"({_D})\s+({_M}){_DASH}({_D})\s+({_M})\s*,?\s*({_Y})")
_DOUBLE_NUMERIC = re.compile(rf"({_D})\.({_D}|{_R})\s*\(\s*({_D})\.({_D}|{_R})\s*\)\.?\s*({_Y})")
_DOUBLE_NAMED = re.compile(rf"({_D})\s*(?:/\s*({_D})|\(\s*({_D})\s*\))\s*({_M})\s*,?\s*({_Y})")
_DOUBLE_TWO = re.compile(rf"({_D})\s+({_M})\s*\(\s*({_D})\s+({_M})\s*\)\s*,?\s*({_Y})")
_CLOCK = re.compile(r"[t,\s]*(?<!\d)(\d{1,2})(?::|\s*(?:ч\.?|час\.?|часов|uhr|h)\s*)(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(?:мин\.?|min\.?|uhr)?\s*((?:am|pm)(?![^\W\d_])|a\.m\.|p\.m\.)?\s*([+-]\d\d:?\d\d|[a-z]+/[a-z_/]+|[^\W\d_]+)?\s*$")


def _number(word: str) -> int:
    return ROMAN[word] if word in ROMAN else int(word)


def _point(text: str, old: bool) -> tuple[dt.date, dt.date]:
    """First and last day of one date."""
    found = _POINT_RE.fullmatch(text)
    if not found:
        raise ValueError(text)
    part = {k.rstrip("0123456789"): v for k, v in found.groupdict().items() if v is not None}
    year = int(part["y"])
    month = _month(part["n"]) if "n" in part else ROMAN[part["r"]] if "r" in part else int(part["m"]) if "m" in part else 0
    if "d" in part:
        day = julian(year, month, int(part["d"])) if old else dt.date(year, month, int(part["d"]))
        return day, day
    if old:
        return (julian(year, month, 1), julian(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)) if month else (julian(year, 1, 1), julian(year + 1, 1, 1) - dt.timedelta(1))
    return (dt.date(year, month, 1), _last(year, month)) if month else (dt.date(year, 1, 1), dt.date(year, 12, 31))


def _new_style(y: int, d1: int, m1: int, d2: int, m2: int) -> dt.date:
    """The new-style day of a double date. The year belongs to the old-style day, as on the document, unless only the
    new-style one fits it."""
    if (day := julian(y, m1, d1)) and (day.day, day.month) == (d2, m2):
        return day
    return dt.date(y + (m2 == 1 and m1 == 12), m2, d2)


def _span(text: str, old: bool) -> tuple[dt.date, dt.date]:
    """First and last day meant by a text without clock time, marks of conjecture and marks of style."""
    if m := _DOUBLE_NUMERIC.fullmatch(text):
        d1, m1, d2, m2, y = (_number(x) for x in m.groups())
        day = _new_style(y, d1, m1, d2, m2)
        return day, day
    if m := _DOUBLE_TWO.fullmatch(text):
        day = _new_style(int(m[5]), int(m[1]), _month(m[2]), int(m[3]), _month(m[4]))
        return day, day
    if m := _DOUBLE_NAMED.fullmatch(text):
        d1, d2, month, y = int(m[1]), int(m[2] or m[3]), _month(m[4]), int(m[5])
        # the month is that of the new-style day if the old-style one lies in the month before
        before = (y - (month == 1), 12 if month == 1 else month - 1)
        for old_year, old_month in ((y, month), before):
            try:
                day = julian(old_year, old_month, d1)
            except ValueError:
                continue
            if day.day == d2:
                return day, day
        day = dt.date(y, month, d2)
        return day, day
    if m := _DECADE.fullmatch(text):
        return dt.date(int(m[1]), 1, 1), dt.date(int(m[1]) + 9, 12, 31)
    if m := _HALF.fullmatch(text):
        first = m[1] in ("1", "первая", "i")
        return dt.date(int(m[2]), 1 if first else 7, 1), _last(int(m[2]), 6 if first else 12)
    if m := _QUARTER.fullmatch(text):
        q = _number(m[1])
        return dt.date(int(m[2]), 3 * q - 2, 1), _last(int(m[2]), 3 * q)
    if m := _THIRD.fullmatch(text):
        q = ("начало", "середина", "конец").index(m[1])
        return dt.date(int(m[2]), 4 * q + 1, 1), _last(int(m[2]), 4 * q + 4)
    if m := _DAY_RANGE.fullmatch(text):
        month = _month(m[3])
        return _point(f"{m[1]}.{month}.{m[4]}", old)[0], _point(f"{m[2]}.{month}.{m[4]}", old)[1]
    if m := _MONTH_RANGE.fullmatch(text):
        a, b, y = _month(m[1]), _month(m[2]), int(m[3])
        return _point(f"{a}.{y - (a > b)}", old)[0], _point(f"{b}.{y}", old)[1]
    if m := _ROMAN_RANGE.fullmatch(text) or _NUMBER_RANGE.fullmatch(text):
        a, b, y = _number(m[2]), _number(m[4]), int(m[5])
        return _point(f"{m[1]}.{a}.{y - (a > b)}", old)[0], _point(f"{m[3]}.{b}.{y}", old)[1]
    if m := _NAMED_RANGE.fullmatch(text):
        a, b, y = _month(m[2]), _month(m[4]), int(m[5])
        return _point(f"{m[1]}.{a}.{y - (a > b)}", old)[0], _point(f"{m[3]}.{b}.{y}", old)[1]
    if (m := _SHORT_YEARS.fullmatch(text)) and (m[3] or len(m[2]) == 4 or not 1 <= int(m[2]) <= 12):
        a, b = int(m[1]), int(m[2])
        if len(m[2]) == 2:
            b += a // 100 * 100
            b += 100 * (b < a)
        if b < a:
            raise ValueError(text)
        return dt.date(a, 1, 1), dt.date(b, 12, 31)
    if _POINT_RE.fullmatch(text):
        return _point(text, old)
    if m := re.fullmatch(r"(?:с|от|from|vom)\s+(.+?)\s+(?:по|до|to|bis)\s+(.+)", text):
        return _pair(m[1], m[2], old)
    for m in re.finditer(_DASH, text):
        try:
            return _pair(text[: m.start()], text[m.end() :], old)
        except ValueError:
            continue
    raise ValueError(text)


def _pair(a: str, b: str, old: bool) -> tuple[dt.date, dt.date]:
    start, end = _point(a.strip(), old)[0], _point(b.strip(), old)[1]
    if end < start:
        raise ValueError((a, b))
    return start, end


def _instant(day: dt.date, clock: re.Match, default_zone: str, regions: dict[str, str]) -> tuple[str, str | None]:
    """A clock time in UTC and None, or the local time and the name of the region whose rules give the offset."""
    hour, minute, second, half, zone = int(clock[1]), int(clock[2]), int(clock[3] or 0), clock[4], clock[5]
    if hour > 24 or minute > 59 or second > 59:
        raise ValueError(clock[0])
    if half:
        hour = hour % 12 + 12 * half.startswith("p")
    at, region = dt.datetime(day.year, day.month, day.day) + dt.timedelta(hours=hour, minutes=minute, seconds=second), None
    zone = zone or default_zone.lower()
    if zone in ZONES:
        at -= dt.timedelta(minutes=ZONES[zone])
    elif zone[0] in "+-":
        offset = int(zone[1:3]) * 60 + int(zone[-2:])
        at -= dt.timedelta(minutes=offset if zone[0] == "+" else -offset)
    else:
        region = regions[zone]
    return at.strftime("%Y-%m-%dT%H:%M:%SZ"), region


def parse_dates(raw: str | None, zone: str = "МСК", regions: dict[str, str] | None = None) -> tuple[str | None, str | None, bool, str | None]:
    """(starts, ends, whether the text marks the date as conjectural, region); nulls if there is no readable date.

    ``regions`` maps names of time zone regions in lower case to their proper ones. Where the text names a region,
    starts and ends are local times, still to be converted by that region's rules (``DateDictionary`` does it).
    """
    if not raw:
        return None, None, False, None
    text = " ".join(unicodedata.normalize("NFKC", raw).lower().replace("−", "-").split())
    conjectural = bool(_CONJ.search(text))
    text = _LABEL.sub(" ", text)
    text = re.sub(r"\(\s*\?\s*\)|[\[\]?]", " ", text)
    old = False
    if _OLD.search(text):
        old, text = True, _OLD.sub(" ", text)
    elif _NEW.search(text):
        text = _NEW.sub(" ", text)
    text = _YEARWORD.sub(r"\1 ", text) if not re.search(r"\bгг", text) else text
    text = " ".join(text.split()).strip(" ,;.")
    try:
        if clock := _CLOCK.search(text):
            day = text[: clock.start()].strip(" ,")
            try:
                start, _ = _point(day, old)
                at, region = _instant(start, clock, zone, regions or {})
                return at, at, conjectural, region
            except (ValueError, KeyError):
                pass
        text = re.sub(r"\s*гг\.?$", " гг", text)
        text = re.sub(r"(?<=е) гг$", "", text)
        start, end = _span(text, old)
        return start.isoformat(), end.isoformat(), conjectural, None
    except (ValueError, KeyError, OverflowError):
        return None, None, conjectural, None


_ENTRY = T.StructType([T.StructField(n, t) for n, t in (("starts", T.StringType()), ("ends", T.StringType()), ("marked", T.BooleanType()), ("region", T.StringType()))])


def _parser(regions: dict[str, str]):
    @F.pandas_udf(_ENTRY)
    def parse(raw: pd.Series, zone: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_dates(r, z, regions) for r, z in zip(raw, zone, strict=True)], columns=["starts", "ends", "marked", "region"])

    return parse


class DateDictionary:
    """The persisted dictionary of distinct raw strings, in a folder that all executors share.

    ``folder`` None keeps it under the session's ``spark.checkpoint.dir``. Entries are only ever added; two runs that
    add the same string at the same time leave two equal entries, of which reading takes one.
    """

    schema = "source string, zone string, raw string, starts string, ends string, marked boolean, part string"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.path = f"{folder or shared_base(spark)}/papyrine-date-dictionary-v{PARSER_VERSION}-parts"

    @staticmethod
    def part(source: Column, zone: Column) -> Column:
        """The folder in which the entries of a source and zone are, named alike on every file system."""
        return F.hex(F.xxhash64(source, zone))

    def read(self, source: str | None = None, zone: str | None = None) -> DataFrame:
        """The dictionary, or of it only the folder of one source and zone."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        if not there:
            return self.spark.createDataFrame([], self.schema)
        whole = self.spark.read.schema(self.schema).parquet(self.path)
        if source is None or zone is None:
            return whole
        name = self.spark.range(1).select(self.part(F.lit(source), F.lit(zone))).first()[0]
        return whole.filter((F.col("part") == name) & (F.col("source") == source) & (F.col("zone") == zone))

    def extend(self, raw: DataFrame, source: str, zone: str) -> DataFrame:
        """Parses the strings of ``raw`` that the dictionary lacks for a source and zone, adds them, and returns what it
        has for these. Only their folder is read; where nothing is new, nothing is written."""
        new = cut(raw.select("raw").dropna().distinct().join(self.read(source, zone).select("raw"), "raw", "left_anti"))
        if new.isEmpty():
            return self.read(source, zone).dropDuplicates(["raw"])
        new = new.select(F.lit(source).alias("source"), F.lit(zone).alias("zone"), "raw")
        key = ["source", "zone", "raw"]
        # the JVM's list of regions (some 600 names) and its rules for their clocks, daylight saving included
        regions = {name.lower(): name for name in self.spark._jvm.java.time.ZoneId.getAvailableZoneIds()}
        parsed = new.select(*key, _parser(regions)("raw", "zone").alias("e")).select(*key, "e.*")
        local = F.to_timestamp_ntz(F.col("starts"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        utc = F.date_format(F.convert_timezone(F.col("region"), F.lit("UTC"), local), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        at = {c: F.when(F.col("region").isNotNull(), utc).otherwise(F.col(c)) for c in ("starts", "ends")}
        parsed = parsed.select(*key, at["starts"].alias("starts"), at["ends"].alias("ends"), "marked", self.part(F.col("source"), F.col("zone")).alias("part"))
        parsed.write.mode("append").partitionBy("part").parquet(self.path)
        return self.read(source, zone).dropDuplicates(["raw"])

    def compact(self) -> None:
        """Rewrites every folder with one row for each entry, in few files; the old files go once the new ones stand."""
        whole = cut(self.read().dropDuplicates(["source", "zone", "raw"]))
        whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)


def with_dates(
    df: DataFrame, raw: str = "dates_raw", flag: str = "conjectural", source: str = "delo_dates", zone: str = "МСК", folder: str | None = None
) -> DataFrame:
    """``df`` with starts, ends and conj (0 or 1; columns of these names are replaced). Every row stays, and so does
    every other column, whatever its name."""
    entries = DateDictionary(df.sparkSession, folder).extend(df.select(F.col(raw).alias("raw")), source, zone)
    mine = {"raw": "__date_raw", "starts": "__date_starts", "ends": "__date_ends", "marked": "__date_marked"}
    joined = df.join(entries.select(*(F.col(a).alias(b) for a, b in mine.items())), df[raw] == F.col("__date_raw"), "left")
    conj = F.coalesce(F.col("__date_marked"), F.lit(False)) | F.coalesce(F.col(flag), F.lit(False))
    added = {"starts": F.col("__date_starts"), "ends": F.col("__date_ends"), "conj": conj.cast("bigint")}
    return joined.withColumns(added).drop(*mine.values())


def dated_cards(dates: DataFrame, folder: str | None = None) -> DataFrame:
    """(portal_id, starts, ends, conj) of each card with a readable date; rows delivered twice count once, rows with a
    null portal_id are left out."""
    kept = dates.select("portal_id", "dates_raw", "conjectural").filter("portal_id is not null")
    return (
        with_dates(kept, folder=folder).filter("starts is not null").select(F.col("portal_id").cast("bigint").alias("portal_id"), "starts", "ends", "conj").distinct()
    )
