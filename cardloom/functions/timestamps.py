"""Time texts of many notations and zones, normalised to one unambiguous form, entirely in column expressions.

An ordered cascade of anchored patterns rewrites a text into ``=kind|Y|M|D|h|m|s|fraction|am|zone``. A rewritten text
starts with ``=``, which no pattern accepts, so the first pattern that matches decides. Strict validation follows; a text
that no pattern accepts or that names an impossible date states nothing.

Local times use the zone given per row. A wall time that occurs twice is its first occurrence; one that was skipped moves
forward by the length of the gap (both are the rules of ``to_utc_timestamp``). Nothing here depends on the session zone.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.steps import step

# Month names in en, de, fr, es.
MONTHS = {
    1: "january jan januar jän jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr fevr febrero",
    3: "march mar märz maerz mär mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre set",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}
# Weekday names in en, de, fr, es.
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tues tue weds wed thurs thur thu fri sat sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim "
    "lunes martes miércoles miercoles jueves viernes sábado sabado domingo mié mie jue vie sáb sab dom"
)
# Zone abbreviations in minutes east of UTC. IST is India's, CST North America's, BST Britain's.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150,
    "ist": 330, "npt": 345, "pkt": 300, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570,
    "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}

_MONTH = r"(\p{L}{3,10})\.?"
_DAY = r"(?:(?:" + "|".join(sorted(WEEKDAYS.split(), key=len, reverse=True)) + r")\.?,?\s+)?"
_AMPM = r"(?:\s*([AaPp])\.?\s?[Mm]\.?)?"
_ZONE = r"(?:\s*\(?([Zz]|[+-]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+-]\d{2}:?\d{2}|\p{L}{2,5})\)?)?"
_CLOCK = r"(\d{1,2})(?:[:.hH](\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?" + _AMPM + r"(?:\s*(?:uhr|h|hrs))?" + _ZONE
_TAIL = r"(?:(?:t|,?\s+(?:(?:à|at|um|a las)\s+)?)" + _CLOCK + r")?"
_NUM_ZONE = r"(?:\s*([Zz]|[+-]\d{2}:?\d{2}|\p{L}{2,5}))?"


def _tail(first: int) -> str:
    return "|".join(f"${first + i}" for i in range(6))


#: (name, anchored pattern, rewritten form), in the order in which they are tried.
CASCADE = [
    ("year first", r"(\d{4})([-/.:])(\d{1,2})\2(\d{1,2})" + _TAIL, "=n|$1|$3|$4|" + _tail(5)),
    ("day first with dots", r"(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4}|\d{2})" + _TAIL, "=n|$3|$2|$1|" + _tail(4)),
    ("order of the site", r"(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})" + _TAIL, "=o|$4|$1|$3|" + _tail(5)),
    ("day, month name, year", _DAY + r"(\d{1,2})(?:st|nd|rd|th|er|\.|º|ª)?[\s-]+(?:de\s+|of\s+)?" + _MONTH + r"(?:\s+de|\s+del|,)?[\s-]+(\d{4}|\d{2})" + _TAIL, "=n|$3|$2|$1|" + _tail(4)),
    ("month name, day, year", _DAY + _MONTH + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TAIL, "=n|$3|$1|$2|" + _tail(4)),
    ("year, month name, day", r"(\d{4})[\s-]+" + _MONTH + r"[\s-]+(\d{1,2})" + _TAIL, "=n|$1|$2|$3|" + _tail(4)),
    ("clock before year", _DAY + _MONTH + r"\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})(?:\s+(\p{L}{2,5}))?\s+(\d{4})", "=n|$7|$1|$2|$3|$4|$5|||$6"),
    ("month name, year", _MONTH + r"(?:\s+de|\s+del|,)?[\s-]+(\d{4})", "=n|$2|$1|||||||"),
    ("year, month", r"(\d{4})[-/.](\d{1,2})", "=n|$1|$2|||||||"),
    ("month, year", r"(\d{1,2})[-/.](\d{4})", "=n|$2|$1|||||||"),
    ("year", r"(\d{4})", "=n|$1||||||||"),
    ("compact with clock", r"(\d{4})(\d{2})(\d{2})(?:t|\s+)(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?" + _NUM_ZONE, "=n|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact digits with clock", r"((?:19|20)\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?", "=n|$1|$2|$3|$4|$5|$6|||"),
    ("compact date", r"(\d{4})(\d{2})(\d{2})", "=n|$1|$2|$3||||||"),
    ("compact month", r"((?:19|20)\d{2})(\d{2})", "=n|$1|$2|||||||"),
    ("unix seconds", r"(\d{9,10})(?:\.(\d+))?", "=u|$1|||||0|$2||"),
    ("unix fractions", r"(\d{10})(\d{3}|\d{6}|\d{9})", "=u|$1|||||0|$2||"),
    ("week date", r"(\d{4})-?w(\d{2})-?([1-7])", "=w|$1|$2|$3||||||"),
    ("day of year", r"(\d{4})-(\d{3})", "=j|$1||$2||||||"),
]

_US = 1_000_000
_DAY_US = 86_400 * _US


def _lookup(entries: dict[str, int], key: str) -> Column:
    """Value of the key column in a literal map, or null; as SQL text, since a call per entry is slow."""
    pairs = ", ".join(f"'{name}', {value}L" for name, value in entries.items())
    return F.expr(f"try_element_at(map({pairs}), {key})")


def _days(ok: Column, y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 where ``ok`` says that the date exists, else null."""
    part = lambda x, other: F.when(ok, x).otherwise(other).cast("int")
    return F.when(ok, F.unix_date(F.make_date(part(y, 1970), part(m, 1), part(d, 1))))


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _month_days(y: Column, m: Column) -> Column:
    return F.when(m == 2, F.when(_leap(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _int(text: Column) -> Column:
    """The number, null for other text; guarded, since a failing try_cast costs an exception per row."""
    return F.when(text.rlike("^[0-9]"), text).cast("long")


def instant_text(micros: Column) -> Column:
    """``YYYY-MM-DDThh:mm:ss.ffffffZ`` of microseconds since 1970, independent of the session zone."""
    day = F.floor(micros / F.lit(_DAY_US)).cast("int")
    rest = F.pmod(micros, F.lit(_DAY_US).cast("long"))
    part = lambda unit, n: _pad(F.pmod(F.floor(rest / F.lit(unit * _US)), F.lit(n)).cast("int"), 2)
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60),
        F.lit("."), _pad(F.pmod(rest, F.lit(_US).cast("long")), 6), F.lit("Z"),
    )


def rewritten(trimmed: Column) -> Column:
    """The trimmed text as its first matching pattern rewrites it, null if none matches."""
    out = F.when(F.lit(False), F.lit(""))
    for _, pattern, form in CASCADE:
        anchored = "(?i)^" + pattern + "$"
        out = out.when(trimmed.rlike(anchored), F.regexp_replace(trimmed, anchored, form))
    return out


def with_normal_form(df: DataFrame, text: str, zone: str, date_order: str) -> DataFrame:
    """Adds ``normal`` (text) and ``micros`` (microseconds since 1970) for the time text in column ``text``.

    Both are null where nothing is stated; micros is also null without a day. ``zone`` names the column with the IANA zone
    of times without zone information (null or unknown zone: such times state nothing); ``date_order`` the column with
    ``DMY`` or ``MDY``, which holds where neither part of a date says which is which (null: ``DMY``). Works in steps, so
    that each intermediate value is computed once and generated code stays small.
    """
    keep = [c for c in df.columns if c not in ("normal", "micros")]
    c = F.col
    p = [c("_p")[i] for i in range(10)]
    out = df.withColumn("_t", F.regexp_replace(c(text), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    out = step(out, keep, rewritten(c("_t")).alias("_r"))
    out = step(out, keep, F.split(F.substring("_r", 2, 2_147_483_647), r"\|", -1).alias("_p"))
    out = step(
        out, keep, p[0].alias("_kind"), p[1].alias("_y"), p[2].alias("_a"), p[3].alias("_b"), p[4].alias("_h"), p[5].alias("_mi"), p[6].alias("_s"), p[7].alias("_f"), F.lower(p[8]).alias("_am"),
        F.regexp_replace(F.lower(p[9]), r"^(?:utc|gmt)(?=[+-])", "").alias("_z"),
        ((p[0] == "o") & (F.upper(F.trim(F.coalesce(c(date_order), F.lit("DMY")))) != "MDY")).alias("_swap"),
    )
    names = {name: number for number, all_names in MONTHS.items() for name in all_names.split()}
    out = step(
        out, keep, "_kind", "_y", "_a", "_b", "_h", "_mi", "_am", "_z",
        (_int(c("_y")) + F.when((c("_kind") != "u") & (F.length("_y") == 2), 2000).otherwise(0)).alias("_year"),
        F.when(c("_swap"), c("_b")).otherwise(c("_a")).alias("_mt"), F.when(c("_swap"), c("_a")).otherwise(c("_b")).alias("_dt"),
        _int(c("_h")).alias("_hour"), F.coalesce(_int(c("_mi")), F.lit(0)).alias("_minute"), F.coalesce(_int(c("_s")), F.lit(0)).alias("_second"),
        F.coalesce(_int(F.rpad(F.substring("_f", 1, 6), 6, "0")), F.lit(0)).alias("_fraction"),
        F.regexp_replace("_z", r"[+:-]", "").alias("_zd"),
    )
    zone_minutes = F.coalesce(_int(F.nullif(F.substring("_zd", 3, 2), F.lit(""))), F.lit(0))
    out = step(
        out, keep, "_kind", "_y", "_a", "_b", "_h", "_mt", "_dt", "_mi", "_am", "_z", "_year", "_hour", "_minute", "_second", "_fraction",
        F.coalesce(_int(c("_mt")), _lookup(names, "lower(_mt)")).alias("_month"), _int(c("_dt")).alias("_day"),
        (_int(F.substring("_zd", 1, 2)) * 60 + zone_minutes).alias("_shift"), (zone_minutes <= 59).alias("_shift_ok"),
    )
    hour24 = F.when(c("_am") == "", c("_hour")).otherwise(c("_hour") % 12 + F.when(c("_am") == "p", 12).otherwise(0))
    east = F.when(
        c("_z").rlike("^[+-]"), F.when(c("_shift_ok") & c("_shift").between(0, 14 * 60), F.when(c("_z").startswith("-"), -c("_shift")).otherwise(c("_shift")))
    ).otherwise(_lookup(ZONES, "_z"))
    calendar = c("_kind").isin("n", "o") & c("_year").between(1, 9999)
    clock_ok = (
        F.when(c("_am") == "", c("_hour").between(0, 23) & (c("_mi") != "")).otherwise(c("_hour").between(1, 12))
        & c("_minute").between(0, 59) & c("_second").between(0, 59)
    )
    out = step(
        out, keep, "_kind", "_y", "_a", "_b", "_h", "_mt", "_dt", "_z", "_year", "_month", "_fraction",
        (calendar & c("_month").between(1, 12)).alias("_month_ok"), calendar.alias("_year_ok"),
        (calendar & c("_month").between(1, 12) & c("_day").between(1, _month_days(c("_year"), c("_month")))).alias("_date_ok"),
        clock_ok.alias("_clock_ok"), east.alias("_east"), "_day",
        ((hour24 * 3600 + c("_minute") * 60 + c("_second")) * _US + c("_fraction")).alias("_of_day"),
    )
    one, four = F.lit(1), F.lit(4)
    out = step(
        out, keep, "_kind", "_y", "_a", "_b", "_h", "_mt", "_dt", "_z", "_year", "_month", "_fraction", "_month_ok", "_year_ok", "_date_ok", "_clock_ok", "_east", "_of_day",
        _days(c("_date_ok"), c("_year"), c("_month"), c("_day")).cast("long").alias("_days"),
        _days((c("_kind") == "w") & c("_year").between(1, 9998), c("_year"), one, four).alias("_jan4"),
        _days((c("_kind") == "w") & c("_year").between(1, 9998), c("_year") + 1, one, four).alias("_next4"),
        _days((c("_kind") == "j") & c("_year").between(1, 9999), c("_year"), one, one).alias("_jan1"),
    )
    monday = c("_jan4") - F.pmod(c("_jan4") + 3, F.lit(7))
    weeks = (c("_next4") - F.pmod(c("_next4") + 3, F.lit(7)) - monday) / 7
    listed = ", ".join(f"'{name}'" for name in sorted(available_timezones()))
    zones = F.expr(f"case when `{zone}` in ({listed}) then `{zone}` end")
    out = out.withColumn("_wall", F.when(c("_clock_ok"), c("_days") * _DAY_US + c("_of_day")))
    from_local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c("_wall")), zones))
    out = step(
        out, keep, "_year", "_month", "_mt", "_dt", "_month_ok", "_year_ok", "_h",
        F.when(c("_kind") == "u", _int(c("_y")) * _US + c("_fraction"))
        .when(c("_h") != "", F.when(c("_z") == "", from_local).otherwise(c("_wall") - c("_east") * 60 * _US)).alias("_micros"),
        F.when(c("_date_ok") & (c("_h") == ""), c("_days"))
        .when((c("_kind") == "w") & c("_year").between(1, 9998) & _int(c("_a")).between(1, weeks), (monday + (_int(c("_a")) - 1) * 7 + _int(c("_b")) - 1).cast("long"))
        .when((c("_kind") == "j") & c("_year").between(1, 9999) & _int(c("_b")).between(1, F.when(_leap(c("_year")), 366).otherwise(365)), (c("_jan1") + _int(c("_b")) - 1).cast("long")).alias("_date_days"),
    )
    partial = (
        F.when(c("_year_ok") & (c("_h") == "") & (c("_mt") == "") & (c("_dt") == ""), _pad(c("_year"), 4))
        .when(c("_month_ok") & (c("_h") == "") & (c("_dt") == ""), F.concat(_pad(c("_year"), 4), F.lit("-"), _pad(c("_month"), 2)))
    )
    day_text = F.date_from_unix_date(c("_date_days").cast("int")).cast("string")
    return step(out, keep, F.coalesce(instant_text(c("_micros")), day_text, partial).alias("normal"), F.coalesce(c("_micros"), c("_date_days") * _DAY_US).alias("micros"))
