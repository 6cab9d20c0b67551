"""Numbers in text: parsing, units, canonical forms, statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any


def coerce_number(cell: Column) -> Column:
    """struct(value, is_percent) of a table cell; a null value where it isn't a number.

    (1,234) is negative; of a bracket with a percent sign behind it the sign counts, not the bracket.
    """
    t = F.trim(F.coalesce(cell, F.lit("")))
    fits = F.rlike(t, F.lit(r"^\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?%?$"))
    negative = F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")"))
    value = F.regexp_replace(t, "[(),%]", "").try_cast("double")
    return F.struct(F.when(fits, F.when(negative, -value).otherwise(value)).alias("value"), (fits & F.endswith(t, F.lit("%"))).alias("is_percent"))


def dimension(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(contains_any(t, ("%", "percent")), "percent").when(contains_any(t, ("£", "$", "eur", "usd")), "currency").otherwise("count")


def multiplier(text: Column) -> Column:
    """What a number's unit multiplies it with."""
    t = F.lower(F.coalesce(text, F.lit("")))
    compact = F.regexp_replace(t, r"\s+", "")
    rules = (
        (contains_any(compact, ("£000", "($000)", "usd000", "eur000", "(000)", "[000]")), 1e3),
        (F.rlike(t, F.lit(r"\b(thousand|thousands)\b|(?<![a-z])[-+]?[0-9]+(?:\.[0-9]+)?\s*k\b")), 1e3),
        (F.rlike(t, F.lit(r"(?<![a-z])[-+]?[0-9]+(?:\.[0-9]+)?\s*m\b|\b(mn|million|millions)\b")), 1e6),
        (F.rlike(t, F.lit(r"(?<![a-z])[-+]?[0-9]+(?:\.[0-9]+)?\s*bn\b|\b(billion|billions)\b")), 1e9),
    )
    out = F.lit(1.0)
    for condition, by in reversed(rules):
        out = F.when(condition, by).otherwise(out)
    return out


def normalize_value(text: Column) -> Column:
    """struct(value, dimension, multiplier) of the first number in a text; null without one."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    number = F.regexp_extract(F.replace(t, F.lit(","), F.lit("")), r"[-+]?[0-9]+(?:\.[0-9]+)?", 0)
    bracket = F.rlike(t, F.lit(r"\(\s*[-+]?[0-9][0-9,]*(?:\.[0-9]+)?\s*\)"))
    value = number.try_cast("double")
    value = F.when(bracket & (value > 0), -value).otherwise(value) * multiplier(t)
    return F.when(number != "", F.struct(value.alias("value"), dimension(t).alias("dimension"), multiplier(t).alias("multiplier")))


def _plain(x: Column) -> Column:
    """With thousands separators, two decimals at most, no zeros behind."""
    whole = x == F.floor(x)
    short = F.regexp_replace(F.format_number(x, 2), r"\.?0+$", "")
    return F.when(whole, F.format_number(x, 0)).otherwise(short)


def canonical_text(text: Column) -> Column:
    """'£1,234', '12.5%' or '1,234'."""

    def of(n: Column) -> Column:
        body, sign = _plain(F.abs(n["value"])), F.when(n["value"] < 0, "-").otherwise("")
        percent = F.concat(sign, F.replace(body, F.lit(","), F.lit("")), F.lit("%"))
        return F.when(n["dimension"] == "percent", percent).when(n["dimension"] == "currency", F.concat(sign, F.lit("£"), body)).when(n.isNotNull(), F.concat(sign, body))

    # bound once: written out, the value would stand in the plan a dozen times
    return F.get(F.transform(F.array(normalize_value(text)), of), F.lit(0))


#: Words that a bare number may have.
UNIT_WORDS = ("m", "mn", "bn", "million", "millions", "billion", "billions", "thousand", "thousands", "percent", "percentage", "eur", "usd")


def is_standalone_number(text: Column) -> Column:
    s = F.trim(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), 0)
    known = F.forall(words, lambda w: w.isin(*UNIT_WORDS))
    rest = F.regexp_replace(s, r"[0-9\s,.\-+£$()%/a-zA-Z]", "")
    return (s != "") & (F.length(s) <= 64) & known & (rest == "") & normalize_value(s).isNotNull()


def _share(text: Column, pattern: str, of: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(of, F.lit(1))


def digit_ratio(text: Column) -> Column:
    """Digits among characters other than white space."""
    return _share(text, r"\p{Nd}", F.length(F.regexp_replace(text, r"(?U)\s", "")))


def alpha_ratio(text: Column) -> Column:
    """Letters among all characters."""
    return _share(text, r"\p{L}", F.length(text))


def wilson(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))
