"""What a product's title says: size, form, strengths, bundle, distinguishing words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.keys import normalize_text, once, text

# Words without meaning in a title, forms with their keywords, units and patterns.
STOP_WORDS = (
    "a", "all", "an", "and", "at", "best", "buy", "care", "combo", "for", "free", "from", "get", "gift", "in", "india", "kit", "men", "new",
    "of", "offer", "online", "pack", "price", "product", "set", "skin", "the", "to", "type", "types", "value", "with", "women", "your",
)
FORMS: dict[str, tuple[str, ...]] = {
    "sunscreen": ("sunscreen", "sunblock", "sun screen", "spf", "uv shield"),
    "serum": ("serum", "ampoule", "essence", "booster"),
    "moisturizer": ("moisturizer", "moisturiser", "cream", "lotion", "emulsion", "gel cream"),
    "cleanser": ("cleanser", "face wash", "facewash", "foam", "cleansing gel", "cleansing water", "micellar", "shampoo", "body wash", "gel moussant"),
    "cleansing_balm": ("cleansing balm", "cleansing oil", "makeup remover"),
    "toner": ("toner", "mist", "tonic"),
    "mask": ("mask", "sheet mask", "pack", "peel off"),
    "exfoliant": ("scrub", "exfoliant", "exfoliator", "peel", "peeling"),
    "oil": ("face oil", "body oil", "hair oil", "oil"),
    "balm": ("balm", "salve", "ointment"),
    "lip": ("lip balm", "lipstick", "lip mask", "lip oil", "lip gloss"),
    "eye": ("eye cream", "eye serum", "eye gel", "under eye"),
    "powder": ("powder", "sachet"),
    "soap": ("soap", "bar", "cleansing bar"),
    "supplement": ("tablet", "capsule", "gummies", "sachets", "supplement"),
    "tool": ("brush", "roller", "device", "massager", "tool", "sponge"),
    "deodorant": ("deodorant", "deo", "antiperspirant"),
}
FORM_ALIASES = {"balm": "moisturizer", "powder": ""}
TO_ML = {"ml": 1.0, "l": 1000.0, "litre": 1000.0, "liter": 1000.0}
TO_G = {"g": 1.0, "gm": 1.0, "gms": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0}
OUNCE_ML = 29.5735
PIECES = ("capsules", "capsule", "tablets", "tablet", "sachets", "sachet", "sheets", "sheet", "wipes", "pcs", "piece", "pieces", "count")
SIZE = r"(?i)(\d+(?:[.,]\d+)?)\s*(ml|l|litre|liter|g|gm|gms|gram|grams|kg|oz|" + "|".join(PIECES) + r")\b"
MULTI = r"(?i)(\d+)\s*[x×*]\s*(\d+(?:[.,]\d+)?)\s*(ml|l|g|gm|gms|kg)\b"
PACK = r"(?i)(?:pack|set|combo|box)\s*of\s*(\d+)|(\d+)\s*[- ]?(?:pack|piece|pc)s?\b"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
SPF = r"(?i)spf\s*(\d+)"
BUNDLE = r"(?i)\b(combo|bundle|duo|trio|kit|regimen|routine|hamper|set of)\b"


def joined(*texts: Column) -> Column:
    return F.concat_ws(" ", *[text(x) for x in texts])


def _number(value: Column) -> Column:
    return F.regexp_replace(value, ",", ".").try_cast("double")


def _canonical(amount: Column, unit: Column) -> tuple[Column, Column]:
    """The amount in the canonical unit of ``unit``, which is in lower case, and that unit."""
    factor, name = F.lit(1.0), F.lit("pc")
    for table, canonical in ((TO_ML, "ml"), (TO_G, "g")):
        for spelling, times in table.items():
            factor = F.when(unit == spelling, F.lit(times)).otherwise(factor)
        name = F.when(unit.isin(*table), F.lit(canonical)).otherwise(name)
    number = _number(amount)
    return F.when(unit == "oz", F.round(number * OUNCE_ML, 1)).otherwise(number * factor), F.when(unit == "oz", F.lit("ml")).otherwise(name)


def parse_size(*texts: Column) -> Column:
    """struct(amount, unit, pack), or null: "2 x 50 ml" first, else a pack's count and the first size. Each pattern
    goes over the text once; its groups are then read from what it found."""
    found = lambda t: F.struct(*[F.regexp_extract(t, p, 0).alias(name) for p, name in ((MULTI, "multi"), (PACK, "pack"), (SIZE, "size"))])

    def parts(x: Column) -> Column:
        many = x["multi"] != ""
        pack = F.coalesce(F.nullif(F.regexp_extract(x["pack"], PACK, 1), F.lit("")), F.nullif(F.regexp_extract(x["pack"], PACK, 2), F.lit("")), F.lit("1"))
        pack = F.when(many, F.regexp_extract(x["multi"], MULTI, 1)).otherwise(pack).try_cast("int")
        amount = F.when(many, F.regexp_extract(x["multi"], MULTI, 2)).otherwise(F.regexp_extract(x["size"], SIZE, 1))
        unit = F.when(many, F.regexp_extract(x["multi"], MULTI, 3)).otherwise(F.regexp_extract(x["size"], SIZE, 2))
        return F.when(many | (x["size"] != ""), F.struct(amount.alias("amount"), F.lower(unit).alias("unit"), pack.alias("pack")))

    def size(x: Column) -> Column:
        amount, unit = _canonical(x["amount"], x["unit"])
        return F.when(x.isNotNull(), F.struct(amount.alias("amount"), unit.alias("unit"), F.greatest(F.lit(1), F.coalesce(x["pack"], F.lit(1))).alias("pack")))

    return once(once(once(joined(*texts), found), parts), size)


def _plain(number: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""), r"\.$", "")


def _plain_text(digits: Column) -> Column:
    """``_plain`` of a number that is given by its digits. Of short ones, which have at most six decimals, only zeros
    have to be taken off."""
    whole = F.ltrim(F.when(F.contains(digits, F.lit(".")), F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))).otherwise(digits), F.lit("0"))
    short = once(whole, lambda x: F.when((x == "") | F.startswith(x, F.lit(".")), F.concat(F.lit("0"), x)).otherwise(x))
    return F.when(F.length(digits) <= 7, short).otherwise(_plain(digits.cast("double")))


def size_label(size: Column) -> Column:
    """Such as 50ml or 2x50ml; empty for null."""
    base = F.concat(_plain(size["amount"]), size["unit"])
    return F.when(size.isNull(), F.lit("")).when(size["pack"] > 1, F.concat(size["pack"].cast("string"), F.lit("x"), base)).otherwise(base)


def size_total(size: Column) -> Column:
    return size["amount"] * size["pack"]


def detect_form(*texts: Column, forms: Mapping[str, Sequence[str]] = FORMS, aliases: Mapping[str, str] = FORM_ALIASES, whole_words: bool = False) -> Column:
    """The form whose longest keyword the texts contain; of equal lengths the first form; else empty.

    ``whole_words`` asks for keywords between word boundaries.
    """
    hay = F.concat_ws(" ", *[normalize_text(x) for x in texts])
    if whole_words:
        hay = F.concat(F.lit(" "), hay, F.lit(" "))
    entries = sorted((-len(k), rank, f" {k} " if whole_words else k, aliases.get(form, form)) for rank, (form, words) in enumerate(forms.items()) for k in words)

    def first(h: Column) -> Column:
        found = F.when(F.lit(False), F.lit(""))
        for _, _, word, form in entries:
            found = found.when(F.contains(h, F.lit(word)), F.lit(form))
        return found.otherwise(F.lit(""))

    return once(hay, first)  # so the text is made ready once, not for each keyword


def strengths(*texts: Column) -> Column:
    """Percentages and sun protection factors, as a sorted array such as [pct10, spf50]."""
    t = joined(*texts)
    percent = F.transform(F.regexp_extract_all(t, F.lit(PERCENT), F.lit(1)), lambda x: F.concat(F.lit("pct"), _plain_text(x)))
    spf = F.transform(F.regexp_extract_all(t, F.lit(SPF), F.lit(1)), lambda x: F.concat(F.lit("spf"), x.try_cast("bigint").cast("string")))
    return F.sort_array(F.array_distinct(F.filter(F.concat(percent, spf), lambda x: x.isNotNull())))


def is_bundle(*texts: Column) -> Column:
    return joined(*texts).rlike(BUNDLE)


def name_tokens(name: Column, brand: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The distinct, sorted words of a title without sizes, packs, brand words, stop words and numbers."""
    t = text(name)
    for pattern in (MULTI, SIZE, PACK):
        t = F.regexp_replace(t, pattern, " ")
    words = F.array_except(F.split(normalize_text(t), " "), F.concat(F.array(*map(F.lit, stop_words)), F.split(normalize_text(brand), " ")))
    return F.sort_array(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")))


def amounts_agree(left: Column, right: Column, absolute: float = 0.5, relative: float = 0.02) -> Column:
    return (left > 0) & (right > 0) & (F.abs(left - right) <= F.greatest(F.lit(absolute), relative * F.greatest(left, right)))
