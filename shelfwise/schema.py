"""Schemas of the product record and of the stored tables."""

from __future__ import annotations

REVIEW = "struct<review_id:string,title:string,review:string,rating:double,reviewer:string,verified_buyer:boolean,created_at:string,likes:bigint,images:array<string>>"
BREAKDOWN = "struct<stars:int,count:bigint,percentage:double>"

#: One product (SKU) of one site at one time.
PRODUCT_COLUMNS: dict[str, str] = {
    "site": "string", "product_id": "string", "brand": "string", "product_name": "string",
    "categories": "array<string>", "source_categories": "array<string>",
    "parent_product_id": "string", "sku": "string", "gtin": "string", "variant": "string",
    "mrp": "double", "selling_price": "double", "discount_pct": "double", "rating": "double", "rating_count": "bigint",
    "in_stock": "boolean", "product_url": "string", "image_url": "string", "image_urls": "array<string>",
    "description": "string", "description_html": "string", "ingredients": "string", "key_ingredients": "array<string>",
    "how_to_use": "string", "key_features": "array<string>", "special_features": "array<string>",
    "product_attributes": "map<string,string>", "review_count": "bigint",
    "rating_breakdown": f"array<{BREAKDOWN}>", "top_reviews": f"array<{REVIEW}>", "scraped_at": "timestamp",
}
PRODUCT_DDL = ", ".join(f"{name} {kind}" for name, kind in PRODUCT_COLUMNS.items())

#: What the current catalogue holds beyond the product.
STATE_COLUMNS: dict[str, str] = {
    "source_fingerprint": "string", "detail_fingerprint": "string",
    "first_seen_at": "timestamp", "last_seen_at": "timestamp", "last_checked_at": "timestamp", "last_changed_at": "timestamp", "last_detail_scraped_at": "timestamp",
    "detail_refresh_pending": "boolean", "detail_unavailable": "boolean", "is_active": "boolean",
    "last_seen_run_id": "string", "missing_run_count": "int", "created_at": "timestamp", "updated_at": "timestamp",
}
CATALOGUE_DDL = PRODUCT_DDL + ", " + ", ".join(f"{name} {kind}" for name, kind in STATE_COLUMNS.items())

HISTORY_DDL = "site string, product_id string, parent_product_id string, sku string, variant string, mrp decimal(12,2), selling_price decimal(12,2), discount_pct decimal(7,2), in_stock boolean, scraped_at timestamp"
RUN_DDL = "id string, site string, status string, started_at timestamp, finished_at timestamp, products_seen int, products_new int, products_changed int, products_unchanged int, details_refreshed int, failures int, blocks int, requests int, message string, metadata string"
#: Captured payloads.
BRONZE_DDL = "site string, url string, fetched_at timestamp, page_no int, category string, body string"

KEY = ("site", "product_id")
HISTORY_KEY = ("site", "product_id", "scraped_at")
PRICE_FIELDS = ("mrp", "selling_price", "discount_pct", "in_stock")
#: Listing fields whose change makes a product changed, and those that only a detail payload fills.
SOURCE_FIELDS = ("parent_product_id", "sku", "categories", "source_categories", "brand", "product_name", "variant", "mrp", "selling_price", "discount_pct", "rating", "rating_count", "review_count", "in_stock", "product_url", "image_url")
RICH_FIELDS = ("gtin", "image_urls", "description", "description_html", "ingredients", "key_ingredients", "how_to_use", "key_features", "special_features", "product_attributes", "rating_breakdown", "top_reviews")
RUN_STATUSES = ("running", "success", "partial", "failed", "blocked")
