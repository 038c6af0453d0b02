"""Product fields from a page's parsed form. Narrow: no shuffle anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_maker, clean_price, with_stock
from ..functions.nodes import with_dom
from ..functions.selectors import Wanted, first_image, first_text
from ..functions.text import or_blank
from ..plans.rules import PlatformRules, registered

FIELDS = ("title", "price", "seller_name", "manufacturer_name", "image_url")


def common_fields(rules: PlatformRules, dom: str = "dom") -> dict[str, Column]:
    """The five fields by the common selector lists; NULL where nothing is found."""
    return {
        "title": first_text(rules.title, dom),
        "price": first_text(rules.price, dom),
        "seller_name": first_text(rules.seller, dom),
        "manufacturer_name": first_text(rules.maker, dom),
        "image_url": first_image(rules.image, True, dom),
    }


def found_fields(rules: PlatformRules, dom: str = "dom") -> dict[str, Column]:
    """Common fields with the platform's fallbacks, price and stock text still raw.

    ``coalesce`` is lazy: a fallback list is only searched where the common list
    found nothing.
    """
    f = common_fields(rules, dom)
    maker = clean_maker(first_text(rules.maker_fallback, dom))
    return {
        "title": f["title"],
        "price_raw": f["price"],
        "stock_text": first_text(rules.availability, dom),
        "seller_name": F.coalesce(f["seller_name"], first_text(rules.seller_fallback, dom)),
        "manufacturer_name": F.coalesce(f["manufacturer_name"], maker),
        "image_url": F.coalesce(f["image_url"], first_image(rules.image_fallback, True, dom)),
    }


def final_fields(rupees: Column) -> dict[str, Column]:
    """Output fields from the found ones: clean price first, stock override second."""
    price = or_blank(F.col("price_raw"))
    price = F.when(rupees, clean_price(price)).otherwise(price)
    return {
        "title": or_blank(F.col("title")),
        "price": with_stock(price, F.col("stock_text")),
        "seller_name": or_blank(F.col("seller_name")),
        "manufacturer_name": or_blank(F.col("manufacturer_name")),
        "image_url": or_blank(F.col("image_url")),
    }


def keep_record(title: Column, price: Column) -> Column:
    """Rows with neither title nor price are not products."""
    return (title != "") | (price != "")


def with_product(
    dom_df: DataFrame, rules: PlatformRules, url: str = "url", **extra: Column
) -> DataFrame:
    """Turn ``dom`` into the product columns, one page per row.

    ``extra`` columns are computed from ``dom`` in the same step. An unreadable page
    keeps its URL, the rest is blank.
    """
    keep = [c for c in dom_df.columns if c not in ("dom", url)]
    raw = found_fields(rules) | extra
    found = F.struct(
        or_blank(F.col(url)).alias("product_url"), *[c.alias(k) for k, c in raw.items()]
    )
    # inline() keeps later filters on the fields from being copied below this step,
    # where they would evaluate every selector list a second time.
    found_df = dom_df.select(*keep, F.inline(F.array(found)))
    final = [c.alias(k) for k, c in final_fields(F.lit(rules.rupee_prices)).items()]
    return found_df.select(*keep, "product_url", *final, "price_raw", *extra)


def extract_products(
    pages: DataFrame, rules: PlatformRules, html: str = "html", url: str = "url"
) -> DataFrame:
    """Snapshots to product records, all input columns but the HTML kept."""
    return with_product(with_dom(pages, rules.wanted_product(), html), rules, url)


def extract_by_platform(
    pages: DataFrame,
    platform: str = "platform",
    rules: dict[str, PlatformRules] | None = None,
    url: str = "url",
) -> DataFrame:
    """Product records with the rules of each row's platform, in one scan and one parse.

    Platforms without rules yield no rows.
    """
    sets = sorted((registered() if rules is None else rules).items())
    wanted = Wanted([s for _, r in sets for s in r.product_selectors()], PlatformRules.IMAGE_ATTRS)
    dom = with_dom(pages.filter(F.col(platform).isin([n for n, _ in sets])), wanted)
    keep = [c for c in dom.columns if c not in ("dom", url)]
    own = [
        F.when(F.col(platform) == n, F.struct(*[c.alias(k) for k, c in found_fields(r).items()]))
        for n, r in sets
    ]
    found = dom.select(*keep, or_blank(F.col(url)).alias("product_url"), F.inline(F.array(F.coalesce(*own))))
    rupees = F.col(platform).isin([n for n, r in sets if r.rupee_prices])
    final = [c.alias(k) for k, c in final_fields(rupees).items()]
    return found.select(*keep, "product_url", *final, "price_raw")


def kept_products(products: DataFrame) -> DataFrame:
    return products.filter(keep_record(F.col("title"), F.col("price")))
