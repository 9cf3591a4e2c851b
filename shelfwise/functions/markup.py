"""HTML and JSON texts of captured payloads.

What a pattern can express is a column expression; texts with nested or broken markup go through
Arrow-batched pandas functions.
"""

from __future__ import annotations

import json
import re
from collections import deque
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.keys import text
from shelfwise.functions.values import one_line

_TEXTS = T.ArrayType(T.StringType())
_BREAKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class _Reader(HTMLParser):
    """Blocks of text with the tag that each is in, and image addresses."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.images: list[str] = []
        self._parts: list[str] = []
        self._tag, self._silent = "", 0

    def _flush(self, tag: str = "") -> None:
        found = " ".join("".join(self._parts).split())
        if found:
            self.blocks.append((self._tag, found))
        self._parts, self._tag = [], tag

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._silent += 1
        elif tag in _BREAKS:
            self._flush(tag)
        elif tag == "img":
            a = dict(attrs)
            url = (a.get("src") or a.get("data-src") or a.get("data-original") or "").strip()
            if url and url not in self.images:
                self.images.append(url)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._silent = max(0, self._silent - 1)
        elif tag in _BREAKS:
            self._flush()

    def handle_data(self, data):
        if not self._silent:
            self._parts.append(data)


def read_blocks(markup: str | None) -> tuple[list[tuple[str, str]], list[str]]:
    reader = _Reader()
    reader.feed(markup or "")
    reader.close()
    reader._flush()
    return reader.blocks, reader.images


@F.pandas_udf(T.StringType())
def html_to_text(markup: pd.Series) -> pd.Series:
    """A block a line, white space collapsed, character references decoded, no scripts or styles."""
    return markup.map(lambda m: "\n".join(t for _, t in read_blocks(m)[0]))


def html_to_text_native(markup: Column) -> Column:
    """The same for plain markup: tags dropped by pattern, the five common references decoded."""
    t = F.regexp_replace(text(markup), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article))\b[^>]*>", "\n"), r"<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), one_line), lambda x: x != ""), "\n")


def _sections(markup: str | None) -> dict:
    blocks, images = read_blocks(markup)
    parts: dict[str, list[str]] = {"ingredients": [], "how_to_use": []}
    now = ""
    for tag, t in blocks:
        if tag in _HEADINGS:
            head = t.casefold().strip(" :")
            now = "ingredients" if "ingredient" in head else "how_to_use" if "how to use" in head or "directions for use" in head or head == "directions" else ""
        elif now:
            parts[now].append(t)
    return {"description": "\n".join(t for _, t in blocks), "ingredients": "\n".join(parts["ingredients"]), "how_to_use": "\n".join(parts["how_to_use"]), "images": images}


@F.pandas_udf(T.StructType([*[T.StructField(c, T.StringType()) for c in ("description", "ingredients", "how_to_use")], T.StructField("images", _TEXTS)]))
def content_sections(markup: pd.Series) -> pd.DataFrame:
    """All text, the parts under headings for ingredients and use, and the images."""
    return pd.DataFrame([_sections(m) for m in markup], columns=["description", "ingredients", "how_to_use", "images"])


def named_ingredients(markup: str | None) -> list[str]:
    """Names under a "key ingredients" heading: bold labels or heads of bullets, else "Name:text." pairs."""
    head = re.search(r"(?i)key\s+ingredients?\s*:?", markup or "")
    if not head:
        return []
    body = re.split(r"(?i)full\s+ingredient|ingredient\s+list|other\s+ingredients|all\s+ingredients", markup[head.end() :])[0]
    plain = lambda m: " ".join(unescape(re.sub(r"<[^>]+>", " ", m)).split())
    bullets = re.findall(r"(?is)<li\b[^>]*>(.*?)</li>", body)
    if bullets:
        labels = (re.search(r"(?is)<b\b[^>]*>(.*?)</b>", b) for b in bullets)
        names = [plain(m[1] if m else b).split(":")[0] for m, b in zip(labels, bullets)]
    else:
        names = [re.split(r"(?<=[.!])\s*", part)[-1] for part in plain(body).split(":")[:-1]]
    clean = (" ".join(n.split()).strip(" .,;-–—&") for n in names)
    return list({n.casefold(): n for n in reversed([n for n in clean if 1 < len(n) <= 80])}.values())[::-1]


@F.pandas_udf(_TEXTS)
def key_ingredients(markup: pd.Series) -> pd.Series:
    return markup.map(named_ingredients)


def ingredient_list(value: Column) -> Column:
    """Parts between commas and semicolons, trimmed of punctuation, of 2 to 80 characters, distinct."""
    parts = F.transform(F.split(text(value), r"[;,]"), lambda x: F.regexp_replace(one_line(x), r"^[\s.:*•\-]+|[\s.:*•\-]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x).between(2, 80)))


def labelled_section(value: Column, label: str, labels: tuple[str, ...]) -> Column:
    """The text after a label up to the next of ``labels`` or the end."""
    stop = "|".join(re.escape(x) for x in labels if x != label)
    return F.trim(F.regexp_extract(text(value), rf"(?is)\b{re.escape(label)}\b\s*:?\s*(.*?)(?=(?:\b(?:{stop})\b\s*:?)|\z)" if stop else rf"(?is)\b{re.escape(label)}\b\s*:?\s*(.*)", 1))


def attribute_table(value: Column) -> Column:
    """A map from lines "label<tab or colon>value"; of equal labels the first counts."""
    lines = F.filter(F.split(text(value), r"\r?\n"), lambda x: x.rlike(r"^[^\t:]{1,80}[\t:]\s*\S"))
    entry = lambda x: F.struct(F.trim(F.regexp_replace(F.regexp_extract(x, r"^([^\t:]+)[\t:]", 1), "[‎‏]", "")).alias("key"), F.trim(F.regexp_extract(x, r"^[^\t:]+[\t:]\s*(.*)$", 1)).alias("value"))
    return F.map_from_entries(F.reverse(F.transform(lines, entry)))


def brand_text(value: Column) -> Column:
    """Without "Visit the ... Store" and "Brand:"."""
    t = F.regexp_replace(one_line(value), r"(?i)^visit\s+the\s+|\s+store$", "")
    return F.trim(F.regexp_replace(t, r"(?i)^brand\s*:\s*", ""))


def absolute_url(url: Column, base: str) -> Column:
    u = F.trim(text(url))
    return F.when(u == "", "").when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), u).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(u, F.lit("/"))))


def last_segment(url: Column) -> Column:
    return F.regexp_extract(text(url), r"([^/?#]+)/?(?:[?#].*)?$", 1)


def full_size_image(url: Column) -> Column:
    """An image address without its thumbnail token, such as ._SX38_."""
    return F.regexp_replace(text(url), r"\._[A-Z0-9_,]+_(?=\.[a-zA-Z]+$)", "")


def decode_body(body: Column, content_type: Column | None = None) -> Column:
    """A page's bytes as text by the charset that its content type declares; without one, or with one that
    is not known here, UTF-8, bytes that are none replaced. Storefronts that declare nothing send UTF-8."""
    plain = F.make_valid_utf8(body.cast("string"))
    if content_type is None:
        return plain
    charset = F.lower(F.regexp_extract(text(content_type), r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1))
    return F.when(charset.isin("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252"), F.decode(body, "ISO-8859-1")).otherwise(plain)


def page_title(markup: Column) -> Column:
    return one_line(F.regexp_extract(text(markup), r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_links(markup: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(markup), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1)))


_LD = re.compile(r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.S | re.I)


def product_node(markup: str | None) -> str | None:
    """The JSON of the first schema.org product: bare, in a list, or in an @graph; bad blocks are passed over."""
    for raw in _LD.findall(markup or ""):
        try:
            queue = deque([json.loads(raw)])
        except ValueError:
            continue
        while queue:
            node = queue.popleft()
            if isinstance(node, list):
                queue.extend(node)
            elif isinstance(node, dict):
                kinds = node.get("@type")
                if any(str(k).rstrip("/").rsplit("/", 1)[-1].lower() == "product" for k in (kinds if isinstance(kinds, list) else [kinds])):
                    offers = node.get("offers")
                    if isinstance(offers, list):
                        node["offers"] = next((o for o in offers if isinstance(o, dict)), {})
                    for name in ("image",):
                        if isinstance(node.get(name), str):
                            node[name] = [node[name]]
                    if isinstance(node.get("brand"), str):
                        node["brand"] = {"name": node["brand"]}
                    return json.dumps(node)
                queue.extend(x for x in node.get("@graph") or [] if isinstance(x, dict))
    return None


@F.pandas_udf(T.StringType())
def linked_product(markup: pd.Series) -> pd.Series:
    return markup.map(product_node)


def media_urls(raw: str | None) -> list[str]:
    """Image addresses anywhere in a JSON text, in order, each once."""
    try:
        queue = deque([json.loads(raw or "null")])
    except ValueError:
        return []
    out: dict[str, None] = {}
    while queue:
        node = queue.popleft()
        if isinstance(node, str) and re.match(r"(?i)(?:https?:)?//\S+", node):
            out.setdefault(node)
        elif isinstance(node, list):
            queue.extend(node)
        elif isinstance(node, dict):
            if str(node.get("mediaType") or node.get("type") or "image").lower() == "image":
                queue.extend(v for k, v in node.items() if isinstance(v, (list, dict)) or k.lower() in ("url", "src", "image", "imageurl", "image_url", "secure_url"))
    return list(out)


@F.pandas_udf(_TEXTS)
def media_list(raw: pd.Series) -> pd.Series:
    return raw.map(media_urls)


_IDENTITIES = ("productId", "product_id", "skuId", "sku_id", "id", "uid")


def find_records(raw: str | None) -> list[str]:
    """The first list of objects with an identity, breadth first, each as JSON."""
    try:
        queue = deque([json.loads(raw or "null")])
    except ValueError:
        return []
    while queue:
        node = queue.popleft()
        if isinstance(node, list):
            if any(isinstance(x, dict) and any(k in x for k in _IDENTITIES) for x in node):
                return [json.dumps(x) for x in node]
            queue.extend(node)
        elif isinstance(node, dict):
            queue.extend(node.values())
    return []


@F.pandas_udf(_TEXTS)
def record_list(raw: pd.Series) -> pd.Series:
    return raw.map(find_records)


def record_array(body: Column, paths: tuple[str, ...]) -> Column:
    """Records as JSON texts: those at the first of the paths (such as response.products) that is there,
    else the first list of objects that look like products."""
    at = [F.from_json(F.get_json_object(body, f"$.{p}"), "array<string>") for p in paths]
    return F.coalesce(*at, record_list(F.when(F.coalesce(*at).isNull(), body))) if at else record_list(body)  # a body with such a path is not read again


def first_path(record: Column, *paths: str) -> Column:
    """The first path of a JSON text that holds something, as text."""
    return F.coalesce(*[F.nullif(F.get_json_object(record, f"$.{p}"), F.lit("")) for p in paths])



def parsed(record: Column) -> Column:
    """A JSON text as a variant, null if it is none: parsed once for all paths that are read from it."""
    return F.try_parse_json(record)


def at_path(record: Column, path: str) -> Column:
    """What a variant has at a path, as text; nested values as JSON."""
    return F.try_variant_get(record, f"$.{path}", "string")


def first_at(record: Column, *paths: str) -> Column:
    """The first path of a variant that holds something, as text."""
    return F.coalesce(*[F.nullif(at_path(record, p), F.lit("")) for p in paths])


def array_at(record: Column, path: str) -> Column:
    """The list at a path of a variant, as variants; null if there is none."""
    return F.try_variant_get(record, f"$.{path}", "array<variant>")
