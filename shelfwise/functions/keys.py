"""Identity keys and barcodes, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    """The value as text, never null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def brand_key(brand: Column) -> Column:
    """Lower case without anything but a-z and 0-9, so that spellings of one brand agree."""
    return F.regexp_replace(F.lower(text(brand)), "[^a-z0-9]+", "")


def normalize_text(value: Column) -> Column:
    """Lower case, with one space for each run of other characters than a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(text(value)), "[^a-z0-9]+", " "))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize_gtin(value: Column) -> Column:
    """The digits, if they are 8, 12, 13 or 14 with a right GS1 check digit; else empty."""

    def checked(digits: Column) -> Column:
        padded = F.lpad(digits, 14, "0")  # leading zeros leave the check digit as it is
        total = once(padded, lambda p: sum((F.substring(p, i + 1, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(13)), F.lit(0)))
        valid = F.length(digits).isin(8, 12, 13, 14) & ((10 - total % 10) % 10 == F.substring(padded, 14, 1).cast("int"))
        return F.when(valid, digits).otherwise(F.lit(""))

    return once(F.regexp_replace(text(value), r"\D", ""), checked)


#: Prefixes that GS1 keeps for other uses than retail barcodes; the last has no upper end.
RESTRICTED_PREFIXES = ((20, 29), (40, 49), (50, 59), (200, 299), (980, 999))


def plausible_barcode(gtin: Column, restricted: Sequence[tuple[int, int]] = RESTRICTED_PREFIXES) -> Column:
    """Whether a valid barcode's prefix is one that a manufacturer can have."""
    prefix = F.try_to_number(F.substring(F.lpad(F.substring(gtin, -13, 13), 13, "0"), 1, 3), F.lit("999")).cast("int")
    out = F.coalesce(gtin, F.lit("")) != ""
    for low, high in restricted:
        out = out & ~prefix.between(low, high)
    return F.coalesce(out, F.lit(False))


def gtin_from_sku(sku: Column) -> Column:
    """A barcode kept as SKU; one of 11 digits is tried with the leading zero that a sheet took away."""
    found = normalize_gtin(sku)
    padded = F.when(F.trim(text(sku)).rlike(r"^\d{11}$"), normalize_gtin(F.lpad(F.trim(text(sku)), 12, "0"))).otherwise(F.lit(""))
    return F.when(found != "", found).otherwise(padded)


def first_non_blank(values: Column) -> Column:
    """The first element of an array that is neither null nor empty, else empty."""
    return F.coalesce(F.get(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), F.lit(""))


def gtin_from_images(urls: Column) -> Column:
    """The first barcode that is a file's name (8 to 14 digits) among image addresses."""
    names = F.transform(urls, lambda u: F.regexp_extract(text(u), r"(?:^|/)(\d{8,14})(?:[_-][^/?#]*)?\.[A-Za-z]+(?:$|[?#])", 1))
    return F.coalesce(first_non_blank(F.transform(names, normalize_gtin)), F.lit(""))


#: Attribute labels that hold barcodes, and those that sometimes do.
BARCODE_LABELS = ("upc", "ean", "ean13", "gtin", "isbn", "barcode")  # fixed values
MODEL_LABELS = ("itemmodelnumber", "modelnumber", "manufacturerpartnumber", "itempartnumber", "partnumber")


def attribute_gtin(attributes: Column) -> Column:
    """A barcode among labelled attributes: barcode rows first, then model and part numbers of 13 or 14
    digits with a plausible prefix."""

    def named(folded: Column, labels: Sequence[str]) -> Column:
        held = F.filter(F.array(*map(F.lit, labels)), lambda label: F.map_contains_key(folded, label))
        return F.transform(held, lambda label: normalize_gtin(F.try_element_at(folded, label)))

    def found(folded: Column) -> Column:
        models = F.filter(named(folded, MODEL_LABELS), lambda g: F.length(g).isin(13, 14) & plausible_barcode(g))
        return once(first_non_blank(named(folded, BARCODE_LABELS)), lambda g: F.when(g != "", g).otherwise(first_non_blank(models)))

    return F.when(attributes.isNull(), F.lit("")).otherwise(once(F.transform_keys(attributes, lambda k, _: brand_key(k)), found))


def gtin_from_candidates(candidates: Column, strict: bool = False) -> Column:
    """The first of several identifiers that is a barcode (with ``strict``, a plausible one)."""
    found = F.transform(candidates, normalize_gtin)
    return F.coalesce(first_non_blank(F.filter(found, lambda g: plausible_barcode(g)) if strict else found), F.lit(""))


def text_identity(site: Column, brand: Column, name: Column) -> Column:
    return F.struct(F.lower(F.trim(text(site))).alias("site"), brand_key(brand).alias("brand"), normalize_text(name).alias("name"))


def manual_id(sku: Column, brand: Column, name: Column) -> Column:
    """The SKU, else a stable id made of brand and name, of at most 120 characters."""
    slug = F.regexp_replace(normalize_text(name), " ", "-")
    return F.when(F.trim(text(sku)) != "", F.trim(text(sku))).otherwise(F.substring(F.concat(F.lit("manual-"), brand_key(brand), F.lit("-"), slug), 1, 120))


def parent_id(parent: Column, url: Column, product_id: Column) -> Column:
    """The parent's id, else the number after ``/p/`` in the address, else the product's own id."""
    in_url = F.regexp_extract(text(url), r"/p/(\d+)", 1)
    return F.coalesce(F.nullif(F.trim(text(parent)), F.lit("")), F.nullif(in_url, F.lit("")), product_id)


def listing_code(url: Column) -> Column:
    """A ten-character listing code with at least one digit, from a product address."""
    code = F.upper(F.regexp_extract(text(url), r"(?:/dp/|/gp/product/|/product/)([A-Za-z0-9]{10})(?:[/?#]|$)", 1))
    return F.when(code.rlike(r"\d"), code).otherwise(F.lit(""))
