"""Event time functions: epoch detection, date strings, zone abbreviations.

Times travel in two forms: ``time_wire`` (the epoch text as detected, e.g.
``'1545407742.757'``) and ``event_time`` (a TIMESTAMP instant, microseconds).
Sessions run in UTC.

Quirk Q4: the reference reads the wall clock of a parsed zone as *local* time,
losing the offset unless both agree.  We compute true UTC instants by default;
``legacy_wall_clock=True`` keeps the quirk.
"""

from __future__ import annotations

import re
import zoneinfo
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: epoch detection, anchored at the start (not the whole value):
# optional spaces, 7 to 10 digits, then any further digits as the fraction.
EPOCH_RX = r"(?U)^\s*(\d{7,10})(\d*)"

# Fixed value: zones whose abbreviations are loaded by default.
DEFAULT_ZONE_RX = "^(GMT|UTC)|^(US|Europe|Asia)/"

# Default date formats; of the parts in brackets a text has one or none.  Each format has shapes (see ``shapes_of``); a text
# is parsed by the one format that has its shape, the first where several do.  A format without a year takes it from ``year``.
_TIMES = "[ h:mm:ss a][ h:mm a][ H:mm:ss][ H:mm]"
DEFAULT_DATE_FORMATS = (
    f"yyyy-M-d{_TIMES}['T'H:mm:ss]['T'H:mm]",
    f"yyyy/M/d{_TIMES}",
    f"M/d/yyyy{_TIMES}",
    f"M/d/yy{_TIMES}",
    f"MMM d, yyyy{_TIMES}",
    f"MMM d yyyy{_TIMES}",
    f"d MMM yyyy{_TIMES}",
    f"d-MMM-yyyy{_TIMES}",
    f"d/MMM/yyyy{_TIMES}[:H:mm:ss]",
    "MMM d H:mm:ss yyyy",
    "MMM d[ H:mm:ss][ H:mm]",
    "d MMM[ H:mm:ss][ H:mm]",
    "yyyyMMdd['T'HHmmss]['T'HHmm][HHmmss]",
)


def detect_epoch(c: Column) -> Column:
    """Epoch text found at the start of ``c`` (``ts[.frac]``), else NULL."""
    whole = F.regexp_extract(c, EPOCH_RX, 1)
    frac = F.regexp_extract(c, EPOCH_RX, 2)
    wire = F.when(frac != "", F.concat(whole, F.lit("."), frac)).otherwise(whole)
    return F.when(c.rlike(EPOCH_RX), wire)


def wire_to_timestamp(wire: Column) -> Column:
    """``'1545407742.757'`` -> TIMESTAMP (fraction truncated to microseconds)."""
    secs = F.split_part(wire, F.lit("."), F.lit(1)).try_cast("bigint")
    frac = F.split_part(wire, F.lit("."), F.lit(2))
    micros = F.rpad(F.substring(frac, 1, 6), 6, "0").try_cast("bigint")
    return F.timestamp_micros(secs * F.lit(1_000_000) + F.coalesce(micros, F.lit(0)))


def timestamp_to_wire(ts: Column) -> Column:
    """TIMESTAMP -> epoch text with the fraction as given (no trailing zeros cut)."""
    us = F.unix_micros(ts.cast("timestamp"))
    secs = F.floor(us / 1_000_000)
    frac = us - secs * 1_000_000
    return F.when(frac == 0, secs.cast("string")).otherwise(
        F.concat(secs.cast("string"), F.lit("."), F.lpad(frac.cast("string"), 6, "0")))


def epoch_seconds(c: Column) -> Column:
    """Integer epoch seconds of a time value: text cut at ``.``, numbers truncated,
    timestamps to seconds; NULL when not numeric (the reference raises)."""
    s = F.trim(c.cast("string"))
    exponent = s.rlike("^[+-]?[0-9.]+[eE][+-]?[0-9]+$")
    return F.when(exponent, s.try_cast("double").cast("decimal(38,6)").try_cast("bigint")) \
        .otherwise(F.trim(F.split_part(s, F.lit("."), F.lit(1))).try_cast("bigint"))


def ts_epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


#: A zone's rule for an abbreviation: from this year on it is read in this zone, where it means this offset in seconds.
ZoneRule = tuple[int, str, int | None]


@lru_cache(maxsize=8)
def zone_abbreviations(load_re: str = DEFAULT_ZONE_RX, years: tuple[int, ...] = tuple(range(1970, 2038))) -> dict[str, list[ZoneRule]]:
    """Abbreviation -> the zones it stands for, by year, among those whose name matches ``load_re``.

    Built from the system zone database by a rule: in each year an abbreviation stands for the last zone (in name
    order) that uses it in that year and has a name, not just a number, for each of its offsets then; a year in which no zone
    does keeps the zone of the year before.  The zone's own rules then tell the offset of a date.
    """
    rx = re.compile(load_re.strip())
    used: dict[tuple[str, int], tuple[bool, str, int]] = {}
    for name in sorted(zoneinfo.available_timezones()):
        if not rx.search(name):
            continue
        zone = zoneinfo.ZoneInfo(name)
        for y in years:
            here = {}
            for month in range(1, 13):
                d = datetime(y, month, 15, 12, tzinfo=timezone.utc).astimezone(zone)
                here[d.tzname()] = int(d.utcoffset().total_seconds())
            named = all(a.isalpha() for a in here)
            for abbr, offset in here.items():
                if abbr.isalpha() and (named, name) >= used.get((abbr, y), (False, ""))[:2]:
                    used[abbr, y] = (named, name, offset)
    table: dict[str, list[ZoneRule]] = {}
    for (abbr, y), (_, name, offset) in sorted(used.items()):
        rules = table.setdefault(abbr, [])
        if not rules or rules[-1][1:] != (name, offset):
            rules.append((y if rules else 0, name, offset))
    return table


NUMERIC_OFFSET = r"(:\d{2}|\dT\d{4}|\dT\d{6}) ?(Z|[+-]\d{2}(?::?\d{2})?)(?: \([A-Za-z]+\))?$"
NAMED_ZONE = r"(:\d{2}(?: [AaPp][Mm])?) (?![AaPp][Mm]\b)([A-Za-z]{2,6})( \d{4})?$"


def _clean_date(c: Column) -> Column:
    """Date text with single blanks, without a day name in front or fractions of a second, month names in three
    letters and a blank before am or pm."""
    body = F.trim(F.regexp_replace(c, r"\s+", " "))
    body = F.regexp_replace(body, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    body = F.regexp_replace(body, r"(:\d{2})[.,]\d+", "$1")
    body = F.regexp_replace(body, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1")
    return F.regexp_replace(body, r"(?i)(:\d{2}) ?([ap])\.?m\b\.?", "$1 $2m")


def _given_offset(body: Column) -> Column:
    given = F.regexp_extract(body, NUMERIC_OFFSET, 2)
    return F.when(given == "Z", "+00:00").when(F.length(given) == 3, F.concat(given, F.lit(":00"))) \
        .when(given != "", F.concat(F.substring(given, 1, 3), F.lit(":"), F.right(given, F.lit(2))))


def _zone_rules(body: Column, zones: dict) -> Column:
    """The rules of the abbreviation in the text, NULL without a known one; a plain offset (``'+01:00'``) is a rule for all years."""
    table = {a: [(0, r, None)] if isinstance(r, str) else r for a, r in sorted(zones.items())}
    if not table:
        return F.lit(None).cast("array<struct<from:int,zone:string,own:int>>")
    known = ", ".join("'%s', array(%s)" % (a, ", ".join(
        f"named_struct('from', {y}, 'zone', '{z}', 'own', cast({'null' if own is None else own} as int))" for y, z, own in rules)) for a, rules in table.items())
    abbr = F.regexp_extract(body, NAMED_ZONE, 2)
    return F.when(abbr != "", F.try_element_at(F.expr(f"map({known})"), abbr))


def _without_zone(body: Column, given: Column, rules: Column) -> Column:
    return F.when(given.isNotNull(), F.regexp_replace(body, NUMERIC_OFFSET, "$1")) \
        .when(rules.isNotNull(), F.regexp_replace(body, NAMED_ZONE, "$1$3")).otherwise(body)


def _rule_of(rules: Column, wall: Column) -> Column:
    return F.element_at(F.filter(rules, lambda r: r["from"] <= F.year(wall)), -1)


def _instant(wall: Column, given: Column, rule: Column, local_zone: str, legacy_wall_clock: bool) -> Column:
    """The instant of a wall time.  A named zone's rules count for its date; where the abbreviation's own offset is in force
    then (in the hour that the clocks repeat both are), it decides."""
    if legacy_wall_clock:
        return F.date_trunc("second", F.to_utc_timestamp(wall, F.lit(local_zone)))
    plain = F.to_utc_timestamp(wall, F.coalesce(given, rule["zone"], F.lit(local_zone)))
    own = F.timestamp_micros(F.unix_micros(wall) - rule["own"].cast("bigint") * F.lit(1_000_000))
    fits = rule["own"].isNotNull() & given.isNull() & (F.from_utc_timestamp(own, rule["zone"]) == wall)
    return F.date_trunc("second", F.when(fits, own).otherwise(plain))


def date_shape(body: Column) -> Column:
    """The shape of a text: runs of letters as ``A``, one or two digits as ``n``, other digits as ``0`` each."""
    shape = F.regexp_replace(F.regexp_replace(body, "[A-Za-z]+", "A"), "[0-9]", "0")
    return F.regexp_replace(shape, "(?<!0)00?(?!0)", "n")


def shapes_of(fmt: str) -> list[str]:
    """The shapes of the texts that a format reads."""
    parts = re.findall(r"\[([^\]]*)\]", fmt)
    whole = re.sub(r"(\[[^\]]*\])+", "\0", fmt)
    out = []
    for f in [whole.replace("\0", p) for p in ["", *parts]]:
        f = re.sub(r"'([A-Za-z]+)'|MMM|a", "A", f)
        f = re.sub(r"yyyyMMdd|HHmmss|HHmm", lambda m: "0" * len(m.group()), f)
        out.append(re.sub(r"yy|M|d|H|h|mm|ss", "n", f.replace("yyyy", "0000")))
    return out


def format_number(body: Column, formats) -> Column:
    """Place of the first format that has the text's shape, NULL if none has."""
    first: dict[str, int] = {}
    for k, f in enumerate(formats):
        for shape in shapes_of(f):
            first.setdefault(shape, k)
    if not first:
        return F.lit(None).cast("int")
    return F.try_element_at(F.expr(f"map({', '.join(f"'{shape}', {k}" for shape, k in first.items())})"), date_shape(body))


def _parsed(body: Column, number: Column, formats, year: Column | int | None) -> Column:
    """The text parsed by its format; two digits of a year are taken within fifty years of ``year``."""
    this_year = F.year(F.current_timestamp()) if year is None else F.lit(year) if isinstance(year, int) else year
    out = F.lit(None).cast("timestamp")
    for k, f in reversed(list(enumerate(formats))):
        text, f = (body, f) if "y" in f else (F.concat(this_year.cast("string"), F.lit(" "), body), f"yyyy {f}")
        got = F.try_to_timestamp(text, F.lit(f))
        if "yyyy" not in f:
            got = F.when(F.year(got) < this_year + 50, got).otherwise(got - F.expr("INTERVAL 100 YEARS"))
        out = F.when(number == k, got).otherwise(out)
    return out


def _staged_body(df, text: Column, formats, zones: dict | None):
    """``df`` with the cleaned text without its zone, the offset and rules of the zone, and the number of the text's format; and their names."""
    b, g, n, s = (f"__tl_d{x}" for x in "bgns")
    d = df.withColumn(b, _clean_date(text))
    d = d.withColumn(g, _given_offset(F.col(b))).withColumn(n, _zone_rules(F.col(b), zone_abbreviations() if zones is None else zones))
    d = d.withColumn(b, _without_zone(F.col(b), F.col(g), F.col(n)))
    return d.withColumn(s, format_number(F.col(b), formats)), b, g, n, s


def with_parsed_date(df, text: Column, out_col: str, formats=DEFAULT_DATE_FORMATS, zones: dict | None = None,
                     local_zone: str = "UTC", legacy_wall_clock: bool = False, year: Column | int | None = None):
    """Free-form date text -> TIMESTAMP (whole seconds), NULL if no format has its shape and fits.

    A day name in front and fractions of a second are dropped.  A numeric offset or ``Z`` at the end of a time counts; a
    zone abbreviation there (or before the year at the end) is looked up in ``zones``; text without a zone is read in ``local_zone``.
    ``year`` is for texts without one (this year if None).  Each step is a projection of its own, so that it is computed
    once a row and the generated code stays small.
    """
    d, b, g, n, s = _staged_body(df, text, formats, zones)
    d = d.withColumn(out_col, _parsed(F.col(b), F.col(s), formats, year))
    d = d.withColumn(n, _rule_of(F.col(n), F.col(out_col)))
    return d.withColumn(out_col, _instant(F.col(out_col), F.col(g), F.col(n), local_zone, legacy_wall_clock)).drop(b, g, n, s)


def unmatched_shapes(df, text: Column, formats=DEFAULT_DATE_FORMATS, zones: dict | None = None, year: Column | int | None = None):
    """``(shape, n, example)`` of the texts that no format reads, to see which formats are missing: one row a shape,
    the smallest text as its example."""
    t, p, q = "__tl_t", "__tl_p", "__tl_q"
    d, b, _, _, s = _staged_body(df.select(text.alias(t)), F.col(t), formats, zones)
    d = d.withColumn(p, _parsed(F.col(b), F.col(s), formats, year)).withColumn(q, date_shape(F.col(b)))
    unread = F.col(t).isNotNull() & F.col(p).isNull()   # counted, not filtered: a filter would be pushed down with all expressions in it
    return d.groupBy(F.col(q).alias("shape")).agg(F.count_if(unread).alias("n"), F.min(F.when(unread, F.col(t))).alias("example")).where("n > 0")


def with_field_time(df, parse_time: str | Column | None, fields_col: str = "fields", **date_opts):
    """Add ``time_wire`` and ``event_time`` from ``fields[parse_time]`` (O21, O22, O27);
    ``parse_time`` is a name for all rows or a column of names.

    Both are NULL when the field is missing or empty, and when its text is not
    a time, which ``time_unparsed`` reports.  An epoch found at the
    start wins; only otherwise is the date parser run.  Each stage is its own
    projection so the generated code stays small and nothing is computed twice.
    """
    if parse_time is None or isinstance(parse_time, str) and not parse_time:
        return df.withColumn("time_wire", F.lit(None).cast("string")) \
                 .withColumn("event_time", F.lit(None).cast("timestamp")).withColumn("time_unparsed", F.lit(False))
    v, ep, pd_ = "__tl_tv", "__tl_tep", "__tl_tpd"
    d = df.withColumn(v, F.element_at(F.col(fields_col), F.lit(parse_time) if isinstance(parse_time, str) else parse_time))
    d = d.withColumn(v, F.when(F.length(F.col(v)) > 0, F.col(v)))
    d = d.withColumn(ep, detect_epoch(F.col(v)))
    d = with_parsed_date(d, F.when(F.col(ep).isNull(), F.col(v)), pd_, **date_opts)
    d = d.withColumn("time_wire", F.coalesce(F.col(ep), timestamp_to_wire(F.col(pd_))))
    d = d.withColumn("event_time", F.when(F.col(ep).isNotNull(), wire_to_timestamp(F.col(ep))).otherwise(F.col(pd_)))
    d = d.withColumn("time_unparsed", F.col(v).isNotNull() & F.col("time_wire").isNull())
    return d.drop(v, ep, pd_)
