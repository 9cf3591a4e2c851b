"""Lenient parsing of numbers, money, booleans, times and lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.keys import once, text

TRUE_WORDS = ("true", "yes", "y", "1", "in stock", "instock", "active", "available")
FALSE_WORDS = ("false", "no", "n", "0", "out of stock", "sold out", "draft")


def sheet_number(value: Column) -> Column:
    """A sheet's cell: everything but digits, points and signs is dropped; negative or unreadable: null."""
    number = F.regexp_replace(text(value), r"[^\d.\-]", "").try_cast("double")
    return F.when(number >= 0, number)


def payload_number(value: Column) -> Column:
    """The first signed number in a text."""
    return F.regexp_replace(F.regexp_extract(text(value), r"-?\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("double")


def payload_integer(value: Column) -> Column:
    return payload_number(value).try_cast("bigint")


def plain_number(value: Column) -> Column:
    return F.regexp_replace(F.trim(text(value)), ",", "").try_cast("double")


def money(value: Column) -> Column:
    """The amount after a currency sign, or the first one."""
    return F.regexp_replace(F.regexp_extract(text(value), r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")


def short_count(value: Column) -> Column:
    """Counts such as 1,234 or 14.9K or 2M."""
    number = F.regexp_replace(F.regexp_extract(text(value), r"(\d[\d,]*(?:\.\d+)?)\s*([KkMm]?)", 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(text(value), r"(\d[\d,]*(?:\.\d+)?)\s*([KkMm]?)", 2))
    return F.round(number * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)).try_cast("bigint")


def glued_price(raw: Column) -> Column:
    """A price whose decimal point was lost: without point, ending in 00, and 10,000 or more."""
    number = money(raw)
    glued = ~F.contains(text(raw), F.lit(".")) & F.regexp_replace(text(raw), r"\D", "").endswith("00") & (number >= 10_000)
    return F.when(glued, number / 100).otherwise(number)


def price_triple(value: Column) -> Column:
    """struct(selling_price, mrp, discount_pct) from a text such as "-30% ₹42000 M.R.P.: ₹59900"."""
    t = text(value)
    percent = F.regexp_extract(t, r"[-−]\s*(\d{1,2}(?:\.\d+)?)\s*%", 1).try_cast("double")
    selling = glued_price(F.regexp_extract(t, r"[-−]\s*\d{1,2}(?:\.\d+)?\s*%\D{0,8}?([\d,]+(?:\.\d+)?)", 1))
    mrp = glued_price(F.regexp_extract(t, r"(?i)M\.?R\.?P\.?:?\D*?([\d,]+(?:\.\d+)?)", 1))
    return F.struct(selling.alias("selling_price"), mrp.alias("mrp"), percent.alias("discount_pct"))


def is_unit_price(value: Column) -> Column:
    """Whether a price text is per unit, such as "(₹12 / 100 ml)"."""
    return text(value).rlike(r"(?i)/\s*(?:\d+(?:\.\d+)?\s*)?(?:ml|l|g|gm|kg|count|piece|unit|oz)\b|\bper\s+(?:ml|l|g|gm|kg|count|piece|unit|oz)\b")


def discount_pct(mrp: Column, selling: Column) -> Column:
    """Per cent off, of two decimals; null without a list price or where the price is above it."""
    return F.when((mrp > 0) & (selling <= mrp), F.round((mrp - selling) / mrp * 100, 2))


def clean_prices(mrp: Column, selling: Column, zero_is_missing: bool = False, mrp_defaults: bool = False) -> Column:
    """struct(mrp, selling_price, discount_pct): a list price below the price is dropped; zero prices may
    be missing ones, and a missing list price may be the price."""

    def kept(prices: Column) -> Column:
        mrp, selling = prices["mrp"], prices["selling_price"]
        mrp = F.when(mrp >= selling, mrp).when(selling.isNull(), mrp)
        mrp = F.coalesce(mrp, selling) if mrp_defaults else mrp
        return F.struct(mrp.alias("mrp"), selling.alias("selling_price"), discount_pct(mrp, selling).alias("discount_pct"))

    positive = lambda x: once(x, lambda v: F.when(v > 0, v)) if zero_is_missing else x
    return once(F.struct(positive(mrp).alias("mrp"), positive(selling).alias("selling_price")), kept)


def boolean_word(value: Column) -> Column:
    """Yes and no in their spellings; anything else is null."""
    t = F.lower(F.trim(text(value)))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def availability(value: Column) -> Column:
    """Stock from a text such as a schema address; what says out or unavailable is tested first."""
    t = F.lower(F.regexp_replace(text(value), r"[\s_\-]+", ""))
    out = t.rlike("outofstock|soldout|unavailable|discontinued|notavailable|backorder")
    return F.when(out, False).when(t.rlike("instock|available|limitedavailability|onlineonly|preorder|left"), True)


def stock(flag: Column, negated: Column, quantity: Column, status: Column) -> Column:
    """The first that is known of a flag, a negated flag, a quantity and a status text."""
    return F.coalesce(boolean_word(flag), ~boolean_word(negated), plain_number(quantity) > 0, availability(status))


def one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(text(value), r"\s+", " "))


def text_list(value: Column) -> Column:
    """Trimmed, non-blank, distinct texts in their order; null is an empty list."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(value, lambda x: F.trim(text(x))), lambda x: x != "")), F.array().cast("array<string>"))


def instant(value: Column) -> Column:
    """An ISO time; without zone it is UTC (the session's); unreadable: null."""
    return F.try_to_timestamp(F.nullif(F.trim(text(value)), F.lit("")))


def older_than(moment: Column, now: Column, days: int = 0, hours: int = 0) -> Column:
    return moment < now - F.make_dt_interval(F.lit(days), F.lit(hours))


def is_empty(value: Column, kind: T.DataType) -> Column:
    """Null, blank, or without elements."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return value.isNull() | (F.size(value) <= 0)
    if isinstance(kind, T.StringType):
        return value.isNull() | (F.trim(value) == "")
    return value.isNull()


def to_cell(value: Column, kind: T.DataType) -> Column:
    """A value as a CSV cell: JSON for nested ones."""
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(value) if nested else value.cast("string")


def from_cell(value: Column, kind: str) -> Column:
    """The reverse; bad JSON gives an empty list or map, bad numbers null."""
    if kind.startswith(("array", "map")):
        empty = F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind)
        return F.coalesce(F.from_json(value, kind), empty)
    if kind == "bigint":
        return value.try_cast("double").try_cast("bigint")
    if kind == "boolean":
        return boolean_word(value)
    if kind == "timestamp":
        return instant(value)
    return text(value) if kind == "string" else value.try_cast(kind)


def meta_map(pairs: Column, key: str = "key", value: str = "value") -> Column:
    """A map from a list of key/value structs; blank keys are left out and the last of equal ones counts."""
    whole = F.filter(pairs, lambda p: F.trim(text(p[key])) != "")
    return F.map_from_entries(F.transform(whole, lambda p: F.struct(F.trim(text(p[key])).alias("key"), text(p[value]).alias("value"))))


def chosen_attributes(attributes: Column, names: dict[str, str]) -> Column:
    """The attributes that ``names`` maps, under their new names, in its order; empty values are left out."""
    labels = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.from_json(F.lit("{}"), "map<string,string>")
    found = F.transform(F.map_entries(labels), lambda e: F.struct(e["value"].alias("key"), F.try_element_at(attributes, e["key"]).alias("value")))
    return F.map_from_entries(F.filter(found, lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "[]", "{}")))


def positive_max(*values: Column) -> Column:
    """The greatest positive value, else null."""
    return F.greatest(*[F.when(v > 0, v) for v in values]) if len(values) > 1 else F.when(values[0] > 0, values[0])


def breakdown_total(breakdown: Column) -> Column:
    return F.aggregate(breakdown, F.lit(0).cast("bigint"), lambda total, b: total + F.coalesce(b["count"], F.lit(0)))
