"""Catalogue reads: active/admin listings, slug lookups, user listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import newest_first

PUBLIC_PRODUCT_COLS = ["id", "slug", "title", "description", "price_cents", "tags", "cover_image_url"]
PRODUCT_DETAIL_COLS = PUBLIC_PRODUCT_COLS + ["digital_file_url"]
PUBLIC_SERVICE_COLS = ["id", "slug", "title", "description", "base_price_cents", "tags"]
ADMIN_PRODUCT_COLS = ["id", "slug", "title", "description", "price_cents", "is_active", "sku", "tags",
                      "cover_image_url", "digital_file_url", "created_at", "updated_at"]
ADMIN_SERVICE_COLS = ["id", "slug", "title", "description", "base_price_cents", "is_active", "tags",
                      "created_at", "updated_at"]
USER_PUBLIC_COLS = ["id", "email", "name", "role", "created_at"]


def active_products(products: DataFrame) -> DataFrame:
    """Active products, public columns, newest first. The ``is_active``
    predicate reaches the scan; only the 7 listed columns are read."""
    return (products.where(F.col("is_active"))
            .select(*PUBLIC_PRODUCT_COLS, "created_at")
            .orderBy(*newest_first()).drop("created_at"))


def active_services(services: DataFrame) -> DataFrame:
    return (services.where(F.col("is_active"))
            .select(*PUBLIC_SERVICE_COLS, "created_at")
            .orderBy(*newest_first()).drop("created_at"))


def admin_products(products: DataFrame) -> DataFrame:
    """All products including inactive ones, 12 columns, newest first."""
    return products.select(*ADMIN_PRODUCT_COLS).orderBy(*newest_first())


def admin_services(services: DataFrame) -> DataFrame:
    return services.select(*ADMIN_SERVICE_COLS).orderBy(*newest_first())


def admin_users(users: DataFrame) -> DataFrame:
    """Users without the password hash, newest first."""
    return users.select(*USER_PUBLIC_COLS).orderBy(*newest_first())


def _lookup(slugs: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    right = table.where(F.col("is_active")).select(*cols).withColumnRenamed("slug", "_slug")
    joined = slugs.join(right, slugs["slug"] == right["_slug"], "left")
    return joined.withColumn("found", F.col("_slug").isNotNull()).drop("_slug")


def lookup_products(slugs: DataFrame, products: DataFrame) -> DataFrame:
    """Bulk slug lookup of active products (with download URL); a slug with
    no active match comes back with ``found = false`` and null columns."""
    return _lookup(slugs, products, PRODUCT_DETAIL_COLS)


def lookup_services(slugs: DataFrame, services: DataFrame) -> DataFrame:
    return _lookup(slugs, services, PUBLIC_SERVICE_COLS)


# Fixed value: the cover shown when a product has none.
DEFAULT_COVER = "https://images.unsplash.com/photo-1454165205744-3b78555e5572"


def product_cards(products: DataFrame) -> DataFrame:
    """Catalogue cards as the shop page renders them: price text ``$d.dd``,
    detail link with the slug URI-encoded, tag markup, default cover."""
    from mercato.functions.columns import format_price, render_tags, uri_component

    return active_products(products).select(
        "id", "slug", "title",
        format_price("price_cents").alias("price_text"),
        F.concat(F.lit("/product.html?slug="), uri_component("slug")).alias("href"),
        uri_component("title").alias("title_encoded"),
        render_tags("tags").alias("tags_html"),
        F.coalesce("cover_image_url", F.lit(DEFAULT_COVER)).alias("cover"))
