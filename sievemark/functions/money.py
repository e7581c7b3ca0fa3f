"""Prices: numbers with ambiguous separators left null, and prices with qualifier, range and frequency. Native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_of, normalized

SPACE = "[\\s\\u00a0\\u202f]"
NUMBER = "(?:\\d{1,3}(?:[\\s\\u00a0\\u202f.,]\\d{3})+(?:[,.]\\d{1,2})?|\\d+(?:[,.]\\d{1,2})?)"
CURRENCY = r"(?:€|EUR|\$|USD|£|GBP)"
#: Groups: 1 qualifier, 2 currency before, 3 first number, 4 second number, 5 currency after, 6 frequency.
PRICE = (
    rf"(?iu)(?<![\d.,])(à{SPACE}+partir{SPACE}+de|a{SPACE}+partir{SPACE}+de|dès|des|from)?{SPACE}*(?:({CURRENCY}){SPACE}*)?({NUMBER})"
    rf"(?:{SPACE}*(?:-|–|—|à|a){SPACE}*({NUMBER}))?{SPACE}*({CURRENCY})"
    rf"(?:{SPACE}*(/{SPACE}*(?:mois|month|an|année|annee|year)|par{SPACE}+(?:mois|an|année|annee)|mensuel(?:le)?|annuel(?:le)?))?(?!\d)"
)
PAGE_PRICE = rf"(?iu)(?:(?:€|\$|£){SPACE}*\d+(?:{SPACE}\d{{3}})*(?:[,.]\d{{1,2}})?|\d+(?:{SPACE}\d{{3}})*(?:[,.]\d{{1,2}})?{SPACE}*(?:€|EUR|\$|USD|£|GBP))"


def number(raw: Column) -> Column:
    """A monetary number; null where separators don't say which is which."""
    v = F.regexp_replace(raw, SPACE, "")
    bare = lambda c: F.regexp_replace(v, c, "")
    return (
        F.when(v.rlike(r"^\d+$"), v)
        .when(v.rlike(r"^\d{1,3}(?:\.\d{3})+,\d{1,2}$"), F.replace(bare("[.]"), F.lit(","), F.lit(".")))
        .when(v.rlike(r"^\d{1,3}(?:,\d{3})+\.\d{1,2}$"), bare(","))
        .when(v.rlike(r"^\d+[.,]\d{1,2}$"), F.replace(v, F.lit(","), F.lit(".")))
        .when(v.rlike(r"^\d{1,3}(?:(?:\.\d{3})+|(?:,\d{3})+)$"), bare("[.,]"))
        .cast("double")
    )


def prices(text: Column) -> Column:
    """Array of (display, currency, minimum, maximum, qualifier, frequency) of each price; the currency after it is required."""
    # The text is searched once; the groups come from each price found.
    found = all_of(text, PRICE, text.rlike(f"(?iu){CURRENCY}"))
    groups = lambda whole: F.struct(whole.alias("0"), *(F.regexp_extract(whole, f"(?s)^(?:{PRICE})$", k).alias(str(k)) for k in range(1, 7)))

    def one(p: Column) -> Column:
        raw = F.upper(F.when(p["2"] != "", p["2"]).otherwise(p["5"]))
        frequency = normalized(p["6"])
        monthly = F.contains(frequency, F.lit("mois")) | F.contains(frequency, F.lit("month")) | F.contains(frequency, F.lit("mensuel"))
        return F.struct(
            F.trim(F.regexp_replace(p["0"], f"^{SPACE}+|{SPACE}+$", "")).alias("display"),
            F.when(raw == "€", "EUR").when(raw == "$", "USD").when(raw == "£", "GBP").otherwise(raw).alias("currency"),
            number(p["3"]).alias("minimum"),
            number(F.nullif(p["4"], F.lit(""))).alias("maximum"),
            F.when(normalized(p["1"]).isin("a partir de", "des", "from"), "from").alias("qualifier"),
            F.when(frequency == "", F.lit(None)).when(monthly, "monthly").otherwise("yearly").alias("frequency"),
        )

    return F.transform(F.transform(found, groups), one)


def page_prices(text: Column) -> Column:
    """Prices as the page audit sees them: symbol on either side, the first six."""
    return F.slice(F.transform(F.regexp_extract_all(text, F.lit(PAGE_PRICE), F.lit(0)), lambda p: F.trim(p)), 1, 6)


def price_key(value: Column) -> Column:
    return F.replace(F.regexp_replace(value, "[^0-9.,]", ""), F.lit(","), F.lit("."))


def half_up(value: Column) -> Column:
    """Rounding to whole numbers of the page audit."""
    return F.floor(value + 0.5).cast("int")
