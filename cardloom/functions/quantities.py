"""Numbers with units and time periods in texts, as column expressions.

Both work alike: one pattern finds every mention in a text, a lookup table gives each its meaning and rank, and the mention
with the best rank, then the earliest place, is the text's. A new unit or notation is a new row of a table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words -> (rank, unit); a lower rank wins.
UNITS = {
    "%": (1, "%"), "percent": (1, "%"), "pp": (2, "PP"), "ppt": (2, "PP"), "ppts": (2, "PP"), "percentage point": (2, "PP"), "percentage points": (2, "PP"),
    "trillion": (3, "T"), "tn": (3, "T"), "t": (3, "T"), "billion": (4, "B"), "bn": (4, "B"), "b": (4, "B"), "million": (5, "M"), "mn": (5, "M"), "m": (5, "M"), "thousand": (6, "K"), "k": (6, "K"),
}
#: Ranks of numbers without a unit: those with digit groups, then others.
GROUPED, PLAIN = 7, 8
# Factor of each scaling unit.
SCALES = {"T": 1e12, "B": 1e9, "M": 1e6, "K": 1e3}
# Names of parts of a year -> (rank, code); a lower rank wins. Spans of months are named by their last month.
PARTS = {
    "q1": (1, "Q1"), "q2": (1, "Q2"), "q3": (1, "Q3"), "q4": (1, "Q4"),
    "first quarter": (2, "Q1"), "second quarter": (2, "Q2"), "third quarter": (2, "Q3"), "fourth quarter": (2, "Q4"), "1st quarter": (2, "Q1"), "2nd quarter": (2, "Q2"), "3rd quarter": (2, "Q3"), "4th quarter": (2, "Q4"),
    "h1": (3, "H1"), "h2": (3, "H2"), "first half": (4, "H1"), "second half": (4, "H2"), "1st half": (4, "H1"), "2nd half": (4, "H2"),
    "jan": (5, "Q1"), "feb": (5, "Q1"), "mar": (5, "Q1"), "apr": (5, "Q2"), "may": (5, "Q2"), "jun": (5, "Q2"), "jul": (5, "Q3"), "aug": (5, "Q3"), "sep": (5, "Q3"), "oct": (5, "Q4"), "nov": (5, "Q4"), "dec": (5, "Q4"),
    "fy": (6, "FY"), "ytd": (7, "YTD"), "": (8, ""),
}

NUMBER = r"\b(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(\s*(?:%|percentage points?\b|[a-z]+\b)|)"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
PERIOD = rf"(?:\b(q[1-4]|h[12]|(?:first|second|third|fourth|1st|2nd|3rd|4th)\s+(?:quarter|half)|{_MONTH}[a-z]*\s*[-–]\s*{_MONTH}[a-z]*|fy|ytd)\s*(?:of\s+)?|\b)(20\d{{2}})\b"


def _lookup(table: dict[str, tuple[int, str]]) -> Column:
    cells = [cell for name, (rank, code) in table.items() for cell in (F.lit(name), F.struct(F.lit(rank).alias("rank"), F.lit(code).alias("code")))]
    return F.create_map(*cells)


def number_with_unit(text: Column) -> tuple[Column, Column]:
    """(value, unit) of the best-ranked quantity of a text: units in the order of ``UNITS``, then numbers with digit groups,
    then plain numbers that are no years of the 2000s and run on into no word; these two have a null unit. Null without any.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    numbers, words = F.regexp_extract_all(low, F.lit(NUMBER), 1), F.regexp_extract_all(low, F.lit(NUMBER), 2)
    units = _lookup(UNITS)

    def mention(pair: Column, at: Column) -> Column:
        number, word = pair["n"], pair["w"]
        known = units[F.regexp_replace(F.trim(word), r"\s+", " ")]
        rank = F.coalesce(known["rank"], F.when(word.rlike(r"^\S"), None).when(number.contains(","), GROUPED).when(~number.rlike(r"^20\d\d$"), PLAIN))
        return F.struct(rank.alias("rank"), at.alias("at"), F.replace(number, F.lit(","), F.lit("")).cast("double").alias("value"), known["code"].alias("unit"))

    mentions = F.transform(F.arrays_zip(numbers.alias("n"), words.alias("w")), mention)
    best = F.array_min(F.filter(mentions, lambda m: m["rank"].isNotNull()))
    return best["value"], best["unit"]


def compatible(value_a: Column, unit_a: Column, value_b: Column, unit_b: Column, tolerance: float = 0.1) -> Column:
    """Whether two quantities agree within a relative tolerance; shares agree only with shares of the same unit."""
    factors = F.create_map(*[cell for unit, factor in SCALES.items() for cell in (F.lit(unit), F.lit(factor))])
    a, b = (value * F.coalesce(factors[unit], F.lit(1.0)) for value, unit in ((value_a, unit_a), (value_b, unit_b)))
    shares = [F.coalesce(unit.isin("%", "PP"), F.lit(False)) for unit in (unit_a, unit_b)]
    return (~(shares[0] | shares[1]) | unit_a.eqNullSafe(unit_b)) & (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def period(text: Column) -> Column:
    """``Q1 2025``, ``H1 2025``, ``FY 2025``, ``YTD 2025`` or a year of the 2000s: the best-ranked mention of a text in the
    order of ``PARTS``; a span of months counts as the quarter of its last month. Null if none is named."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts, years = F.regexp_extract_all(low, F.lit(PERIOD), 1), F.regexp_extract_all(low, F.lit(PERIOD), 2)
    known = _lookup(PARTS)

    def mention(pair: Column, at: Column) -> Column:
        part = F.regexp_replace(pair["p"], r"\s+", " ")
        name = F.when(part.rlike("[-–]"), F.substring(F.regexp_replace(part, r"^.*[-–]\s*", ""), 1, 3)).otherwise(part)
        return F.struct(known[name]["rank"].alias("rank"), at.alias("at"), F.trim(F.concat_ws(" ", known[name]["code"], pair["y"])).alias("period"))

    mentions = F.transform(F.arrays_zip(parts.alias("p"), years.alias("y")), mention)
    return F.array_min(F.filter(mentions, lambda m: m["rank"].isNotNull()))["period"]
