"""Column functions with the rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds in days of the age bands, in order.
AGE_BANDS = [(365, "under_1_year"), (730, "1_to_2_years"), (1825, "2_to_5_years")]
LAST_BAND = "5_years_or_more"
UNSUPPORTED = "unsupported"


def joined_key(*parts: Column, separator: str = "|") -> Column:
    """Parts joined by a separator; a null part counts as empty and keeps its separator."""
    out = [F.coalesce(parts[0].cast("string"), F.lit(""))]
    for part in parts[1:]:
        out += [F.lit(separator), F.coalesce(part.cast("string"), F.lit(""))]
    return F.concat(*out)


def parse_us_date(text: Column) -> Column:
    """Month/day/year with or without leading zeros; null where it is no date."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date")


def age_band(days: Column) -> Column:
    out = F.when(days < AGE_BANDS[0][0], AGE_BANDS[0][1])
    for bound, name in AGE_BANDS[1:]:
        out = out.when(days < bound, name)
    return out.otherwise(LAST_BAND)


def band_order(band: Column) -> Column:
    out = F.when(band == AGE_BANDS[0][1], 1)
    for k, (_, name) in enumerate(AGE_BANDS[1:], 2):
        out = out.when(band == name, k)
    return out.otherwise(len(AGE_BANDS) + 1)


def procedural_cohort(origin: Column, family: Column) -> Column:
    """The first rule that fits decides."""
    return (
        F.when(origin.isin("6", "13"), "multidistrict_litigation")
        .when(family == "social_security", "social_security_review")
        .when(origin == "1", "ordinary_original")
        .otherwise("other_procedural_origin")
    )


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def office_code(text: Column) -> Column:
    """Digits as a number, if that is a single digit; else null."""
    number = F.try_to_number(F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text)), F.lit("9" * 18))
    return F.when(number < 10, number.cast("int").cast("string"))


def spreadsheet_safe(text: Column) -> Column:
    """A quote before values that a spreadsheet would read as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def five_year_band(date: Column) -> Column:
    """The first year of the five that a date falls in."""
    return (F.floor(F.year(date) / 5) * 5).cast("int")
