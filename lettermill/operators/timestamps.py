"""Mixed timestamp formats and time zones into one instant.

All formats are one regular expression with named groups. It runs once over a text and gives the components as
integers; the calendar is checked and the instant put together by integer day arithmetic, in the JVM. A text may
allow several instants: day and month may be exchanged, a local time may occur twice or not at all when clocks
change, an abbreviation may name several zones. Each reading is kept; the one nearest to a reference instant holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of months by language, with their first letters as abbreviations where these are in use.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene janeiro gennaio gen januari stycznia styczeń sty января январь янв",
    2: "february feb februar février févr fév febrero fevereiro fev febbraio februari lutego luty lut февраля февраль фев",
    3: "march mar märz mär mars marzo março maart mrt marca marzec марта март мар",
    4: "april apr avril avr abril abr aprile kwietnia kwiecień kwi апреля апрель апр",
    5: "may mai mayo maio maggio mag mei maja maj мая май",
    6: "june jun juni juin junio junho giugno giu czerwca czerwiec cze июня июнь июн",
    7: "july jul juli juillet juil julio julho luglio lug lipca lipiec lip июля июль июл",
    8: "august aug août aout agosto ago augustus sierpnia sierpień sie августа август авг",
    9: "september sep sept septembre septiembre setembro set settembre września wrzesień wrz сентября сентябрь сен",
    10: "october oct oktober okt octobre octubre outubro out ottobre ott października październik paź октября октябрь окт",
    11: "november nov novembre noviembre novembro listopada listopad lis ноября ноябрь ноя",
    12: "december dec dezember dez décembre déc decembre diciembre dic dezembro dicembre grudnia grudzień gru декабря декабрь дек",
}
MONTH_OF = {name: m for m, names in MONTHS.items() for name in names.split()}

# Abbreviations of zones, in minutes from UTC; several where several zones use the letters.
ZONE_MINUTES = {
    "z": [0], "ut": [0], "utc": [0], "gmt": [0], "wet": [0], "west": [60], "bst": [60, 360], "ist": [330, 60, 120], "cet": [60], "mez": [60], "cest": [120], "mesz": [120],
    "eet": [120], "eest": [180], "msk": [180], "trt": [180], "gst": [240], "pkt": [300], "sgt": [480], "hkt": [480], "awst": [480], "jst": [540], "kst": [540],
    "acst": [570], "acdt": [630], "aest": [600], "aedt": [660], "nzst": [720], "nzdt": [780], "est": [-300, 600], "edt": [-240, 660], "cst": [-360, 480], "cdt": [-300],
    "mst": [-420], "mdt": [-360], "pst": [-480, 480], "pdt": [-420], "akst": [-540], "akdt": [-480], "hst": [-600], "ast": [-240, 180], "adt": [-180], "nst": [-210], "ndt": [-150], "brt": [-180], "art": [-180], "sast": [120], "cat": [120], "eat": [180], "wat": [60],
}

_NAME = r"[^\W\d_]+"
_MONTH = "|".join(sorted(map(re.escape, MONTH_OF), key=len, reverse=True))
_TIME = r"(?P<{p}H>\d{{1,2}})(?::|h|\.)(?P<{p}M>\d{{2}})(?:(?::|\.)(?P<{p}S>\d{{2}})(?:[.,](?P<{p}F>\d{{1,9}}))?)?(?:\s*(?P<{p}A>[AaPp])\.?\s?[Mm]\.?)?"
_BODY = [
    ("e", r"(?P<eE>-?\d{{9,19}})"),  # seconds, milliseconds, microseconds or nanoseconds since 1970
    ("b", r"(?P<bY>\d{{4}})(?P<bm>\d{{2}})(?P<bd>\d{{2}})[T ]?(?P<bH>\d{{2}})(?P<bM>\d{{2}})(?:(?P<bS>\d{{2}})(?:[.,](?P<bF>\d{{1,9}}))?)?"),
    ("i", r"(?P<iY>\d{{4}})[-/.](?P<im>\d{{1,2}})[-/.](?P<id>\d{{1,2}})(?:\s*[T,]\s*|\s+)" + _TIME),
    ("n", r"(?P<nd>\d{{1,2}})(?:\.|st|nd|rd|th|º)?[\s-]+(?:de\s+)?(?P<nm>{month})\.?,?[\s-]+(?:de\s+)?(?P<nY>\d{{4}}|\d{{2}})(?:\s*,\s*|\s+)(?:(?:à|at|um|o|às|kl\.?|a\s+las|в)\s+)?" + _TIME),
    ("u", r"(?P<um>{month})\.?\s+(?P<ud>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<uY>\d{{4}})(?:\s*,\s*|\s+)(?:at\s+)?" + _TIME),
    ("c", r"(?P<cm>{month})\.?\s+(?P<cd>\d{{1,2}}),?\s+" + _TIME + r"\s+(?:(?P<cZ>[A-Za-z]{{2,5}})\s+)?(?P<cY>\d{{4}})"),
    ("s", r"(?P<sx>\d{{1,2}})/(?P<sy>\d{{1,2}})/(?P<sY>\d{{4}}|\d{{2}})(?:\s*,\s*|\s+)" + _TIME),
    ("d", r"(?P<dd>\d{{1,2}})[.-](?P<dm>\d{{1,2}})[.-](?P<dY>\d{{4}}|\d{{2}})(?:\s*,\s*|\s+)" + _TIME),
]
_ZONE = r"(?:\s*(?:Uhr|uur|ч\.?|hrs?))?(?:\s*(?P<zname>[A-Za-z]{{1,5}})(?![A-Za-z/]))?(?:\s*(?P<zsign>[+\-−])(?P<zh>\d{{1,2}})(?::?(?P<zm>\d{{2}}))?)?(?:\s*\[(?P<zid>[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)*)\])?(?:\s*\((?P<zc>[^()]*)\))?"
#: Every format as one alternation. White space is folded to single blanks before it is applied.
DATE_RE = re.compile(
    (rf"^(?:{_NAME}\.?,?\s+)?(?:" + "|".join(body.replace("{p}", p) for p, body in _BODY) + ")" + _ZONE + r"\s*\.?$").replace("{{", "{").replace("}}", "}").replace("{month}", _MONTH),
    re.IGNORECASE,
)

COMPONENTS = "y int, m int, d int, swap boolean, secs int, micros int, epoch bigint, offsets array<int>, zone string"
_ALL = [p for p, _ in _BODY]


def components(text: str | None) -> tuple | None:
    """The components of one text, or null if it does not state day and time."""
    if text is None or not (hit := DATE_RE.match(" ".join(text.split()))):
        return None
    g = {k: v for k, v in hit.groupdict().items() if v is not None}
    kind = next(p for p in _ALL if f"{p}E" in g or f"{p}Y" in g)
    of = lambda k: g.get(kind + k)
    if kind == "e":
        digits = len(of("E").lstrip("-"))
        scale = 1_000_000 if digits <= 11 else 1_000 if digits <= 14 else 1 if digits <= 17 else -1_000
        value = int(of("E"))
        return None, None, None, False, None, None, value * scale if scale > 0 else value // -scale, [0], None
    year = int(of("Y"))
    year += (2000 if year < 70 else 1900) if len(of("Y")) == 2 else 0
    swap = False
    if kind == "s":
        day, month = int(of("x")), int(of("y"))
        swap = True
    else:
        day, month = int(of("d")), of("m")
        month = int(month) if month.isdigit() else MONTH_OF[month.lower()]
    hour, minute, second = int(of("H")), int(of("M")), int(of("S") or 0)
    if of("A"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (of("A").lower() == "p")
    if hour > 23 or minute > 59 or second > 60:
        return None
    second = min(second, 59)
    micros = int((of("F") or "").ljust(6, "0")[:6])
    offsets, zone = None, None
    name = (g.get("zname") or of("Z") or "").lower()
    if "zsign" in g:
        minutes = int(g["zh"]) * 60 + int(g.get("zm") or 0)
        if minutes > 18 * 60:
            return None
        offsets = [minutes if g["zsign"] == "+" else -minutes]
    elif name in ZONE_MINUTES:
        offsets = ZONE_MINUTES[name]
    elif "zid" in g:
        zone = g["zid"]
    elif name:
        return None
    return year, month, day, swap, hour * 3600 + minute * 60 + second, micros, None, offsets, zone


def _components_udf():
    @F.pandas_udf(COMPONENTS)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [components(t) or (None,) * 9 for t in texts]
        return pd.DataFrame(rows, columns=["y", "m", "d", "swap", "secs", "micros", "epoch", "offsets", "zone"]).astype(object)

    return parse


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a day in the proleptic Gregorian calendar, by integers alone; null if there is no such day."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    # Months are counted from March, so that the leap day is the last of its year.
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mm = F.pmod(m + 9, F.lit(12))
    quotient = lambda a, b: F.floor(a / F.lit(b)).cast("bigint")
    day = 365 * yy + quotient(yy, 4) - quotient(yy, 100) + quotient(yy, 400) + quotient(153 * mm + 2, 5) + d - 1 - 719468
    return F.when(m.between(1, 12) & (d >= 1) & (d <= longest) & y.between(1, 9999), day.cast("bigint"))


def zone_offset(micros: Column, zone: Column) -> Column:
    """Offset in microseconds of `zone` at the instant `micros`."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone)) - micros


def _local_readings(local: Column, zone: Column) -> Column:
    """The instants at which clocks in `zone` show `local`: two when they go back, the two nearest readings in a gap."""
    day = 86_400_000_000
    early, late = (local - zone_offset(local - shift, zone) for shift in (F.lit(day), F.lit(-day)))
    fits = lambda x: zone_offset(x, zone) == local - x
    both = F.array(early, late)
    good = F.filter(both, fits)
    return F.when(zone.isNull(), F.array().cast("array<bigint>")).otherwise(F.when(F.size(good) > 0, good).otherwise(both))


def instant_string(micros: Column) -> Column:
    """`yyyy-MM-ddTHH:mm:ss.SSSSSSZ`, whatever the zone of the session."""
    day = F.floor(micros / F.lit(86_400_000_000)).cast("bigint")
    day = F.expr("0") + day
    rest = micros - day * 86_400_000_000
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    sec = F.expr("0") + F.floor(rest / 1_000_000).cast("bigint")
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec / 60) % 60), F.lit(":"), two(sec % 60),
        F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )


def normalise_timestamps(df: DataFrame, text: str, keys: list[str], zone: str, reference: str, out: str = "utc") -> DataFrame:
    """Keys and the instant that `text` states, as a string in UTC.

    `zone` names the column with the zone for texts without one (UTC where it is null or unknown), `reference` the
    instant to which the nearest reading is taken; where it is null the earliest reading is. Texts without day and
    time, with an impossible date or null give no row. Extra columns of `df` are dropped.
    """
    parsed = df.select(*keys, F.col(zone).alias("_home"), F.unix_micros(reference).alias("_near"), _components_udf()(F.col(text)).alias("_u"))
    # Through a generator: filters stay above it, so that components are extracted, and readings made, once.
    once = lambda x: F.explode(F.array(x))
    parsed = parsed.select(*keys, "_home", "_near", once(F.col("_u")).alias("_c"))
    c = lambda k: F.col(f"_c.{k}")
    known = F.coalesce(c("zone"), F.col("_home"), F.lit("UTC"))
    safe = F.when(known.rlike(r"^(?:UTC|GMT|[A-Z][A-Za-z_]+/[A-Za-z0-9_+\-]+(?:/[A-Za-z0-9_+\-]+)?)$"), known).otherwise("UTC")
    local = lambda m, d: days_from_civil(c("y"), m, d) * 86_400_000_000 + c("secs").cast("bigint") * 1_000_000 + c("micros")
    locals_ = F.array_compact(F.array(local(c("m"), c("d")), F.when(c("swap"), local(c("d"), c("m")))))
    stated = F.flatten(F.transform(locals_, lambda x: F.transform(c("offsets"), lambda o: x - o.cast("bigint") * 60_000_000)))
    unstated = F.flatten(F.transform(locals_, lambda x: _local_readings(x, F.col("_zone"))))
    readings = F.when(c("epoch").isNotNull(), F.array(c("epoch"))).when(c("offsets").isNotNull(), stated).otherwise(unstated)
    nearest = F.element_at(F.array_sort(F.transform(F.col("_r"), lambda x: F.struct(F.coalesce(F.abs(x - F.col("_near")), F.lit(0)).alias("gap"), x.alias("at")))), 1)["at"]
    return (
        parsed.withColumn("_zone", safe).select(*keys, once(readings).alias("_r"), "_near")
        .where(F.size("_r") > 0).select(*keys, nearest.alias("_at"), F.col("_near")).where(F.col("_at").isNotNull())
        .select(*keys, instant_string(F.col("_at")).alias(out), F.abs(F.col("_at") - F.col("_near")).alias("_gap"))
    )
