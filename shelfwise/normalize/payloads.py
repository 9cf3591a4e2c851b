"""Captured payloads into product rows: one job for each kind of payload.

Input is the bronze table (site, url, fetched_at, page_no, category, body). Records are exploded once,
filtered by brand before any costly extraction, and selected into product columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import keys, markup, values
from shelfwise.schema import PRODUCT_COLUMNS


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def as_products(df: DataFrame, **columns: Column) -> DataFrame:
    """Select all product columns: those given, others with their defaults."""
    out = []
    for c, kind in PRODUCT_COLUMNS.items():
        default = F.lit("") if kind == "string" else _no_texts().cast(kind) if kind.startswith("array<string") else F.lit(None)
        out.append(columns.get(c, default).cast(kind).alias(c))
    return df.select(*out)


def allow(df: DataFrame, brand: Column, brands: Sequence[str]) -> DataFrame:
    """Rows of the listed brands, whatever their spelling; no list keeps all."""
    folded = sorted({"".join(ch for ch in b.lower() if ch.isascii() and ch.isalnum()) for b in brands} - {""})
    return df.where(keys.brand_key(brand).isin(*folded)) if folded else df


def listing_records(bronze: DataFrame, paths: Sequence[str] = ("response.products", "products", "items")) -> DataFrame:
    return bronze.select("site", "category", "fetched_at", "page_no", F.posexplode(markup.record_array(F.col("body"), tuple(paths))).alias("pos", "r"))


#: Paths at which listings keep a field, in order of preference.
PATHS = {
    "parent": ("productId", "product_id", "parentId", "parent_id", "id"), "name": ("productName", "product_name", "name", "title"),
    "brand": ("brandName", "brand_name", "brand.name", "brand"), "url": ("dynamicUrl", "product_url", "url", "slug"), "image": ("imageUrl", "image_url", "image", "newImageUrl"),
    "rating": ("rating", "avgRating"), "rating_count": ("ratingCount", "rating_count"), "review_count": ("reviewCount", "review_count"), "type": ("objectType", "object_type", "type"),
    "sku": ("skuId", "sku_id", "sku", "id"), "variant": ("size", "packSize", "pack_size", "variantName", "value"), "mrp": ("mrp", "price", "listPrice"),
    "selling": ("sellingPrice", "offerPrice", "final_price", "discountedPrice", "price"), "stock": ("inStock", "in_stock", "isInStock"), "out": ("outOfStock", "isOutOfStock"), "quantity": ("quantity", "stockQuantity"), "status": ("stockStatus", "availability"),
}


def json_listing(bronze: DataFrame, base_url: str, brands: Sequence[str] = (), paths: Sequence[str] = ("response.products", "products", "items")) -> tuple[DataFrame, DataFrame]:
    """(products, rejected records) of a listing with variants: a variant's own value counts wherever it has
    the key, even blank; the parent's otherwise. Tiles of other kinds are dropped; records without name or
    id are rejected, not fatal."""
    records = listing_records(bronze, paths).withColumn("j", markup.parsed(F.col("r")))
    p = lambda name: markup.first_at(F.col("j"), *PATHS[name])
    kind = F.lower(F.coalesce(p("type"), F.lit("")))
    bad = p("parent").isNull() | p("name").isNull()
    rejected = records.where(bad & kind.isin("", "product", "sku")).select("site", "page_no", "pos", "r", F.lit("no id or no name").alias("reason"))
    good = allow(records.where(~bad & kind.isin("", "product", "sku")), p("brand"), brands)
    variants = markup.array_at(F.col("j"), "variants")
    each = good.select("site", "category", "fetched_at", "page_no", "pos", "j", F.posexplode_outer(F.when(F.size(variants) > 0, variants)).alias("vpos", "v"))

    def own(name: str) -> Column:
        has = F.lit(False)
        for path in PATHS[name]:
            if "." not in path:
                has = has | F.try_variant_get("v", f"$.{path}", "variant").isNotNull()
        return F.when(F.coalesce(has, F.lit(False)), markup.first_at(F.col("v"), *PATHS[name])).otherwise(p(name))

    price = values.clean_prices(values.payload_number(own("mrp")), values.payload_number(own("selling")))
    each = each.withColumn("prices", price)
    image = markup.absolute_url(own("image"), base_url)
    products = as_products(
        each, site=F.col("site"), product_id=F.coalesce(markup.first_at(F.col("v"), *PATHS["sku"]), p("sku"), p("parent")), parent_product_id=p("parent"), brand=values.one_line(p("brand")), product_name=values.one_line(own("name")),
        categories=values.text_list(F.array("category")), source_categories=values.text_list(F.array("category")), sku=F.coalesce(own("sku"), F.lit("")), variant=F.coalesce(own("variant"), F.lit("")),
        mrp=F.col("prices.mrp"), selling_price=F.col("prices.selling_price"), discount_pct=F.col("prices.discount_pct"), rating=values.payload_number(own("rating")), rating_count=values.payload_integer(own("rating_count")), review_count=values.payload_integer(own("review_count")),
        in_stock=values.stock(own("stock"), own("out"), own("quantity"), own("status")), product_url=markup.absolute_url(own("url"), base_url), image_url=image, image_urls=values.text_list(F.array(image)), scraped_at=F.col("fetched_at"),
    )
    return products, rejected


def _reviews(raw: Column, most: int = 5) -> Column:
    schema = "array<struct<review_id:string,title:string,detail:string,description:string,nickname:string,is_buyer:string,created_at:string,likes:string,images:array<string>,meta_data:struct<value:string>,rating:string>>"
    return F.transform(F.slice(F.coalesce(F.from_json(raw, schema), F.from_json(F.lit("[]"), schema)), 1, most), lambda r: F.struct(
        keys.text(r["review_id"]).alias("review_id"), keys.text(r["title"]).alias("title"), F.coalesce(r["detail"], r["description"], F.lit("")).alias("review"), values.payload_number(F.coalesce(r["rating"], r["meta_data"]["value"])).alias("rating"), keys.text(r["nickname"]).alias("reviewer"),
        values.boolean_word(r["is_buyer"]).alias("verified_buyer"), keys.text(r["created_at"]).alias("created_at"), values.payload_integer(r["likes"]).alias("likes"), values.text_list(r["images"]).alias("images")))


def _breakdown(raw: Column) -> Column:
    schema = "array<struct<id:string,count:string,per:string>>"
    return F.transform(F.coalesce(F.from_json(raw, schema), F.from_json(F.lit("[]"), schema)), lambda b: F.struct(values.payload_integer(b["id"]).cast("int").alias("stars"), values.payload_integer(b["count"]).alias("count"), values.payload_number(b["per"]).alias("percentage")))


def json_detail(bronze: DataFrame, base_url: str, listing: DataFrame | None = None) -> DataFrame:
    """One row for each option of a detail payload: the option's values, then the response's, then those of
    the listing row of the parent. The response's barcode is only that of a sole option."""
    g = lambda path: markup.at_path(F.col("j"), path)
    d = bronze.select("site", "fetched_at", markup.parsed(F.col("body")).alias("j")).withColumn("options", markup.array_at(F.col("j"), "options"))
    # texts of the response are read before its options are listed: once, not for each of them
    d = d.withColumns({"html": F.coalesce(g("description"), F.lit("")), "made_of": F.coalesce(g("ingredients"), F.lit("")), "use": F.coalesce(g("use"), g("how_to_use"), F.lit(""))})
    d = d.withColumns({"content": markup.content_sections("html"), "ingredients": markup.html_to_text("made_of"), "key_ingredients": markup.key_ingredients("made_of"), "use": markup.html_to_text("use")})
    d = d.select("site", "fetched_at", "j", "html", "content", "ingredients", "key_ingredients", "use", F.size("options").alias("n"), F.posexplode_outer(F.when(F.size("options") > 0, F.col("options"))).alias("pos", "o"))
    o = lambda *paths: markup.first_at(F.col("o"), *paths)
    parent = F.coalesce(o("parent_id"), g("parent_id"), g("id"))
    d = d.withColumn("parent", parent)
    if listing is not None:
        first = listing.groupBy(F.col("site").alias("l_site"), F.col("parent_product_id").alias("l_parent")).agg(F.first("brand").alias("l_brand"), F.first("product_name").alias("l_name"), F.first("product_url").alias("l_url"), F.first("categories").alias("l_categories"))
        d = d.join(first, (F.col("site") == F.col("l_site")) & (F.col("parent") == F.col("l_parent")), "left")
    else:
        d = d.withColumns({"l_brand": F.lit(None).cast("string"), "l_name": F.lit(None).cast("string"), "l_url": F.lit(None).cast("string"), "l_categories": F.lit(None).cast("array<string>")})
    gallery = F.flatten(F.array(markup.media_list(F.coalesce(o("carousel"), g("carousel"), F.lit("[]"))), F.col("content.images")))
    price = values.clean_prices(values.payload_number(F.coalesce(o("price", "mrp"), g("price"), g("mrp"))), values.payload_number(F.coalesce(o("final_price", "offer_price"), g("final_price"))))
    own_code = keys.normalize_gtin(o("gtin", "ean", "barcode"))
    d = d.withColumns({"prices": price, "gallery": values.text_list(gallery)})
    return as_products(
        d, site=F.col("site"), product_id=F.coalesce(o("id", "product_id"), g("id")), parent_product_id=F.col("parent"), sku=F.coalesce(o("sku"), g("sku"), F.lit("")),
        gtin=F.when(own_code != "", own_code).when(F.col("n") > 1, "").otherwise(keys.normalize_gtin(F.coalesce(g("gtin"), g("ean")))),
        brand=F.coalesce(o("brand_name"), g("brand_name"), F.col("l_brand"), F.lit("")), product_name=F.coalesce(o("name"), g("name"), F.col("l_name"), F.lit("")), variant=F.coalesce(o("pack_size", "size", "variant_name"), g("pack_size"), F.lit("")),
        categories=F.coalesce("l_categories", _no_texts()), source_categories=F.coalesce("l_categories", _no_texts()), mrp=F.col("prices.mrp"), selling_price=F.col("prices.selling_price"), discount_pct=F.col("prices.discount_pct"),
        rating=values.payload_number(F.coalesce(o("rating"), g("rating"))), rating_count=values.payload_integer(F.coalesce(o("rating_count"), g("rating_count"))), review_count=values.payload_integer(F.coalesce(o("review_count"), g("review_count"))),
        in_stock=values.stock(F.coalesce(o("gludo_stock", "is_saleable", "in_stock"), g("gludo_stock")), o("out_of_stock"), o("quantity"), o("stock_status")), product_url=F.coalesce("l_url", markup.absolute_url(g("url"), base_url)),
        image_url=F.coalesce(F.get("gallery", F.lit(0)), F.lit("")), image_urls=F.col("gallery"), description=F.col("content.description"), description_html=F.col("html"),
        ingredients=F.col("ingredients"), key_ingredients=F.col("key_ingredients"), how_to_use=F.col("use"),
        rating_breakdown=_breakdown(g("review_splitup")), top_reviews=_reviews(g("top_review")), scraped_at=F.col("fetched_at"),
    )


def variant_listing(bronze: DataFrame, base_url: str, brands: Sequence[str] = (), paths: Sequence[str] = ("items",)) -> DataFrame:
    """A listing whose records carry groups of variants: the root and all variants, each uid once, the last
    counting; only the root has the price, SKU and barcode; the parent is the smallest uid."""
    records = allow(listing_records(bronze, paths), markup.first_path(F.col("r"), "brand.name", "brand"), brands).where(F.get_json_object("r", "$.uid").isNotNull())
    item = "struct<uid:string,name:string,slug:string,value:string,medias:string>"
    g = lambda path: F.get_json_object("r", f"$.{path}")
    groups = F.flatten(F.transform(F.coalesce(F.from_json(g("variants"), f"array<struct<items:array<{item}>>>"), F.from_json(F.lit("[]"), f"array<struct<items:array<{item}>>>")), lambda v: F.coalesce(v["items"], F.from_json(F.lit("[]"), f"array<{item}>"))))
    root = F.struct(g("uid").alias("uid"), g("name").alias("name"), g("slug").alias("slug"), g("attributes['pack-size']").alias("value"), g("medias").alias("medias"))
    number = lambda u: F.struct(u.try_cast("bigint").isNull(), u.try_cast("bigint"), u.alias("uid"))

    def chosen(everything: Column) -> Column:
        uids = F.array_distinct(F.transform(everything, lambda x: x["uid"]))
        latest = F.transform(uids, lambda u: F.element_at(F.filter(everything, lambda x: x["uid"] == u), -1))
        return F.struct(F.array_min(F.transform(uids, number))["uid"].alias("parent"), latest.alias("variants"))

    attribute = lambda name: g(f"attributes['{name}']")
    lists = lambda name: values.text_list(F.coalesce(F.from_json(attribute(name), "array<string>"), F.array(attribute(name))))
    # what a record says is read before its variants are listed: once, not for each of them
    read = records.select(
        "site", "category", "fetched_at", keys.once(F.filter(F.array_prepend(groups, root), lambda x: x["uid"].isNotNull()), chosen).alias("chosen"), g("uid").alias("uid"), g("name").alias("name"), F.coalesce(g("brand.name"), F.lit("")).alias("brand"), g("sellable").alias("sellable"),
        values.payload_number(F.coalesce(g("price.marked.min"), g("price.marked"))).alias("marked"), values.payload_number(F.coalesce(g("price.effective.min"), g("price.effective"))).alias("effective"), g("medias").alias("medias"),
        F.coalesce(F.from_json(g("attributes.identifier"), "map<string,array<string>>"), F.from_json(F.lit("{}"), "map<string,array<string>>")).alias("identity"), F.coalesce(attribute("description"), F.lit("")).alias("html"), lists("super-ingredients").alias("key_ingredients"), lists("preference").alias("special_features"),
    )
    read = read.withColumn("content", markup.content_sections("html"))
    each = read.select("*", F.col("chosen.parent").alias("parent"), F.posexplode("chosen.variants").alias("vpos", "v"))
    is_root = F.col("v.uid") == F.col("uid")
    each = each.withColumns({"prices": values.clean_prices(F.when(is_root, F.col("marked")), F.when(is_root, F.col("effective"))), "gallery": markup.media_list(F.coalesce(F.col("v.medias"), F.col("medias"), F.lit("[]")))})
    codes = F.flatten(F.array(*[F.coalesce(F.try_element_at("identity", F.lit(k)), _no_texts()) for k in ("ean", "gtin", "upc", "barcode")]))
    return as_products(
        each, site=F.col("site"), product_id=F.col("v.uid"), parent_product_id=F.col("parent"), sku=F.when(is_root, F.coalesce(F.get(F.try_element_at("identity", F.lit("sku_code")), F.lit(0)), F.lit(""))).otherwise(""),
        gtin=F.when(is_root, keys.gtin_from_candidates(codes)).otherwise(""), brand=F.col("brand"), product_name=F.coalesce("v.name", "name", F.lit("")), variant=F.coalesce("v.value", F.lit("")),
        categories=values.text_list(F.array("category")), source_categories=values.text_list(F.array("category")), mrp=F.col("prices.mrp"), selling_price=F.col("prices.selling_price"), discount_pct=F.col("prices.discount_pct"),
        in_stock=F.when(is_root, values.boolean_word(F.col("sellable"))), product_url=markup.absolute_url(F.concat(F.lit("product/"), F.col("v.slug")), base_url), image_url=F.coalesce(F.get("gallery", F.lit(0)), F.lit("")), image_urls=F.col("gallery"),
        description=F.col("content.description"), description_html=F.col("html"), ingredients=F.col("content.ingredients"), how_to_use=F.col("content.how_to_use"),
        key_ingredients=F.col("key_ingredients"), special_features=F.col("special_features"), scraped_at=F.col("fetched_at"),
    )


def merge_variant_prices(products: DataFrame, payloads: DataFrame, url_slug: Column) -> DataFrame:
    """Prices of single variants' payloads (slug, body) onto listing rows that have none: those of the first
    size that is available."""
    size = F.from_json(F.get_json_object("body", "$.sizes"), "array<struct<is_available:string,price:struct<marked:string,effective:string>>>")
    one = F.coalesce(F.get(F.filter(size, lambda s: values.boolean_word(s["is_available"])), F.lit(0)), F.get(size, F.lit(0)))
    found = payloads.select(F.col("slug").alias("p_slug"), values.clean_prices(values.payload_number(one["price"]["marked"]), values.payload_number(one["price"]["effective"])).alias("p"))
    joined = products.withColumn("p_slug", url_slug).join(found, "p_slug", "left")
    take = F.col("selling_price").isNull() & F.col("p").isNotNull()
    return joined.select(*[F.when(take, F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) if c in ("mrp", "selling_price", "discount_pct") else F.col(c) for c in products.columns])


FEED = "struct<id:string,handle:string,title:string,vendor:string,product_type:string,body_html:string,images:array<struct<src:string>>,variants:array<struct<id:string,title:string,sku:string,price:string,compare_at_price:string,available:string>>>"


def shop_feed(bronze: DataFrame, base_url: str, brands: Sequence[str] = (), barcodes: DataFrame | None = None) -> DataFrame:
    """A shop's catalogue feed: one row for each variant; the default variant has no name; a list price
    below the price is dropped; a barcode kept as SKU, else that of ``barcodes`` (handle, gtin)."""
    pages = bronze.select("site", "fetched_at", F.explode(F.from_json(F.get_json_object("body", "$.products"), f"array<{FEED}>")).alias("p"))
    pages = allow(pages, F.col("p.vendor"), brands).where("p.handle <> '' AND p.title <> ''")
    each = pages.select("site", "fetched_at", "p", F.explode("p.variants").alias("v"))
    code = keys.gtin_from_sku(F.col("v.sku"))
    if barcodes is not None:
        each = each.join(barcodes.select(F.col("handle").alias("b_handle"), F.col("gtin").alias("b_gtin")), F.col("p.handle") == F.col("b_handle"), "left")
        code = F.when(code != "", code).otherwise(F.coalesce("b_gtin", F.lit("")))
    images = values.text_list(F.transform("p.images", lambda i: i["src"]))
    each = each.withColumns({"prices": values.clean_prices(values.plain_number(F.col("v.compare_at_price")), values.plain_number(F.col("v.price"))), "gallery": images})
    kind = values.text_list(F.array("p.product_type"))
    return as_products(
        each, site=F.col("site"), product_id=F.col("v.id"), parent_product_id=F.col("p.id"), sku=keys.text(F.col("v.sku")), gtin=code, brand=F.trim("p.vendor"), product_name=F.trim("p.title"), categories=kind, source_categories=kind,
        variant=F.when(F.col("v.title") == "Default Title", "").otherwise(keys.text(F.col("v.title"))), mrp=F.col("prices.mrp"), selling_price=F.col("prices.selling_price"), discount_pct=F.col("prices.discount_pct"), in_stock=F.coalesce(values.boolean_word(F.col("v.available")), F.lit(False)),
        product_url=F.concat(F.lit(base_url.rstrip("/") + "/products/"), F.col("p.handle")), image_url=F.coalesce(F.get("gallery", F.lit(0)), F.lit("")), image_urls=F.col("gallery"),
        description=markup.html_to_text_native(F.col("p.body_html")), description_html=keys.text(F.col("p.body_html")), scraped_at=F.col("fetched_at"),
    )


NODE = "struct<name:string,brand:struct<name:string>,description:string,sku:string,image:array<string>,offers:struct<price:string,availability:string>,aggregateRating:struct<ratingValue:string,ratingCount:string>>"


def linked_data_pages(bronze: DataFrame, page_state: bool = True, brands: Sequence[str] = ()) -> DataFrame:
    """Product pages with schema.org data. With ``page_state`` a zero or missing price, the list price, the
    categories and a strict barcode come from the page's state object, of whose keys the first counts; else
    the barcode is that of an image's name."""
    pages = bronze.select("site", "url", "fetched_at", "body", F.from_json(markup.linked_product("body"), NODE).alias("d")).where("d.name <> ''")
    pages = allow(pages, F.col("d.brand.name"), brands)
    state = lambda pattern, group=1: F.nullif(F.regexp_extract("body", pattern, group), F.lit(""))
    price = lambda name: values.plain_number(state(rf'\b{name}\s*:\s*"?([0-9]+(?:\.[0-9]+)?)"?'))
    selling = values.plain_number(F.col("d.offers.price"))
    gallery = values.text_list(F.col("d.image"))
    if page_state:
        selling = F.coalesce(F.when(selling > 0, selling), price("our_price"))
        mrp, code = price("mrp"), keys.gtin_from_candidates(F.array(state(r'\bmaster_product_id\s*:\s*"?(\d{8,14})"?'), F.regexp_extract(keys.text(F.col("d.sku")), r"PPLB(\d{13})", 1)), strict=True)
        levels = values.text_list(F.array(*[state(rf'\bl{i}_category_name\s*:\s*"([^"]{{1,80}})"') for i in (1, 2, 3)]))
        pid = F.regexp_extract("url", r"/product/([^/?#]+)", 1)
    else:
        mrp, code, levels, pid = F.lit(None).cast("double"), keys.gtin_from_images(gallery), _no_texts(), markup.last_segment(F.col("url"))
    each = pages.withColumns({"prices": values.clean_prices(mrp, selling, zero_is_missing=True), "gallery": gallery, "levels": levels, "code": code, "pid": pid})
    return as_products(
        each, site=F.col("site"), product_id=F.when(F.col("pid") != "", F.col("pid")).otherwise(markup.last_segment(F.col("url"))), sku=keys.text(F.col("d.sku")), gtin=F.col("code"), brand=keys.text(F.col("d.brand.name")), product_name=F.trim("d.name"), categories=F.col("levels"), source_categories=F.col("levels"),
        mrp=F.col("prices.mrp"), selling_price=F.col("prices.selling_price"), discount_pct=F.col("prices.discount_pct"), rating=values.plain_number(F.col("d.aggregateRating.ratingValue")), rating_count=values.payload_integer(F.col("d.aggregateRating.ratingCount")),
        in_stock=values.availability(F.col("d.offers.availability")), product_url=F.col("url"), image_url=F.coalesce(F.get("gallery", F.lit(0)), F.lit("")), image_urls=F.col("gallery"), description=markup.html_to_text(keys.text(F.col("d.description"))), scraped_at=F.col("fetched_at"),
    )


SECTIONS = ("Ingredients", "Directions", "How to use", "Legal disclaimer", "Safety information", "Product description", "About this item")


def attribute_pages(rows: DataFrame) -> DataFrame:
    """Records of pages kept as (site, code, fetched_at, sections map): title, brand, price text, details
    table, about, important information, rating texts and availability."""
    s = lambda name: keys.text(F.try_element_at("sections", F.lit(name)))
    t = rows.withColumns({"attributes": markup.attribute_table(s("details")), "triple": values.price_triple(s("price"))})
    prices = values.clean_prices(F.col("triple.mrp"), F.col("triple.selling_price"), mrp_defaults=True)
    t = t.withColumn("prices", prices)
    info = s("important")
    return as_products(
        t, site=F.col("site"), product_id=F.col("code"), parent_product_id=F.col("code"), gtin=keys.attribute_gtin(F.col("attributes")), brand=markup.brand_text(s("brand")), product_name=values.one_line(s("title")), variant=values.one_line(s("variant")),
        mrp=F.col("prices.mrp"), selling_price=F.col("prices.selling_price"), discount_pct=F.coalesce("triple.discount_pct", "prices.discount_pct"), rating=values.payload_number(s("rating")), rating_count=values.short_count(s("rating_count")),
        in_stock=values.availability(s("availability")), ingredients=markup.labelled_section(info, "Ingredients", SECTIONS), key_ingredients=markup.ingredient_list(F.try_element_at("attributes", F.lit("Active Ingredients"))), how_to_use=markup.labelled_section(info, "Directions", SECTIONS),
        key_features=values.text_list(F.split(s("about"), r"\r?\n")), product_attributes=F.col("attributes"), product_url=s("url"), image_url=markup.full_size_image(s("image")), scraped_at=F.col("fetched_at"),
    )
