"""Rule data per platform and the registry that maps a platform to its rules."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.selectors import (
    OG_IMAGE,
    Sel,
    Wanted,
    attr_is,
    attr_part,
    css_class,
    css_id,
    has,
    tag,
)


@dataclass(frozen=True)
class PlatformRules:
    """Everything the operators need to know about one platform's pages.

    Register another instance to support another platform; no code changes.
    """

    name: str
    # product page, in order of priority
    title: tuple[Sel, ...] = ()
    price: tuple[Sel, ...] = ()
    seller: tuple[Sel, ...] = ()
    maker: tuple[Sel, ...] = ()
    image: tuple[Sel, ...] = ()
    availability: tuple[Sel, ...] = ()
    seller_fallback: tuple[Sel, ...] = ()
    maker_fallback: tuple[Sel, ...] = ()
    image_fallback: tuple[Sel, ...] = ()
    rupee_prices: bool = False
    # listing page
    link_exclusions: tuple[str, ...] = ()
    link_pattern: str = ""
    link_hint: str = ""  # plain text within one path segment that every match of the pattern shows
    link_domain: str = ""
    next_page: tuple[Sel, ...] = ()
    # variants
    swatch_row: Sel | None = None
    swatch_row_prefix: str = ""
    swatch_option: Sel | None = None
    swatch_name: tuple[Sel, ...] = ()
    swatch_gone: str = ""
    dropdown: Sel | None = None
    dropdown_prefix: str = ""
    dimension_suffix: str = ""
    dropdown_placeholder: str = ""

    IMAGE_ATTRS = ("src", "data-src", "data-lazy-src", "content")

    def product_selectors(self) -> list[Sel]:
        return [
            *self.title,
            *self.price,
            *self.seller,
            *self.maker,
            OG_IMAGE,
            *self.image,
            *self.availability,
            *self.seller_fallback,
            *self.maker_fallback,
            *self.image_fallback,
        ]

    def variant_selectors(self) -> list[Sel]:
        found = [self.swatch_row, self.swatch_option, *self.swatch_name]
        if self.dropdown is not None:
            found += [self.dropdown, tag("option")]
        return [s for s in found if s is not None]

    def wanted_product(self) -> Wanted:
        """Elements that product fields can come from."""
        return Wanted(self.product_selectors(), self.IMAGE_ATTRS)

    def wanted_product_and_variants(self) -> Wanted:
        return Wanted(
            self.product_selectors() + self.variant_selectors(),
            (*self.IMAGE_ATTRS, "alt", "name", "value", "data-asin", self.swatch_gone),
        )

    def wanted_variants(self) -> Wanted:
        return Wanted(
            self.variant_selectors(), ("alt", "name", "value", "data-asin", self.swatch_gone)
        )

    def wanted_listing(self) -> Wanted:
        return Wanted(
            [has("href", "a"), has("href", "base"), *self.next_page], ("href", "aria-disabled")
        )


_BULLETS = attr_is(
    "class",
    "a-unordered-list a-nostyle a-vertical a-spacing-none detail-bullet-list",
    tag="ul",
)
_SECTIONS = tag("div", id="productDetails_detailBullets_sections1")
_DETAILS = tag("div", id="productDetails")
_WRAPPER = tag("div", id="detailBulletsWrapper_feature_div")

# Selectors of the one platform with rules, in order of priority.
AMAZON = PlatformRules(
    name="amazon",
    title=(
        tag("h1", id="title"),
        attr_is("data-automation-id", "product-title", tag="h1"),
        tag("h1", cls="product-title"),
        tag("h1"),
        css_class("product-title"),
        attr_is("data-testid", "product-title"),
    ),
    price=(
        css_class("a-price-whole"),
        css_class("a-offscreen").inside(css_class("a-price")),
        css_class("price"),
        css_class("product-price"),
        attr_is("data-testid", "price"),
        css_class("a-price-range"),
    ),
    seller=(
        css_id("sellerProfileTriggerId"),
        css_class("a-size-small a-color-secondary"),
        css_class("seller-name"),
        attr_is("data-testid", "seller-name"),
    ),
    maker=(
        css_id("bylineInfo"),
        css_class("a-size-small a-color-secondary"),
        css_class("manufacturer-name"),
        attr_is("data-testid", "manufacturer-name"),
    ),
    image=(
        css_id("landingImage"),
        css_class("a-dynamic-image"),
        has("data-old-hires", "img"),
        has("data-src", "img"),
        has("src", "img"),
    ),
    availability=(
        tag("span").inside(tag("div", id="availability")),
        tag("div", id="outOfStock"),
        tag("div", id="unavailable"),
        tag("span", cls="a-size-medium a-color-state"),
    ),
    seller_fallback=(
        tag("span", id="bylineInfo"),
        tag("a", id="bylineInfo"),
        tag("a", cls="a-link-normal"),
        tag("div", id="merchant-info"),
        tag("div", id="sellerProfileTriggerId"),
        tag("span").inside(tag("div", id="sellerProfileTriggerId")),
        tag("span", own="Sold by").followed_by("span"),
        tag("span", own="Ships from").followed_by("span"),
        attr_part("id", "sellerProfileTriggerId", tag="a"),
        tag("a").inside(attr_part("id", "merchant-info", tag="div")),
    ),
    maker_fallback=(
        tag("li", holds="Brand:").child(_BULLETS),
        tag("li", holds="Manufacturer:").child(_BULLETS),
        tag("th", own="Brand").inside(_SECTIONS).followed_by("td"),
        tag("th", own="Manufacturer").inside(_SECTIONS).followed_by("td"),
        tag("th", own="Brand").inside(_DETAILS).followed_by("td"),
        tag("th", own="Manufacturer").inside(_DETAILS).followed_by("td"),
        tag("span", own="Brand").inside(_WRAPPER).followed_by("span"),
        tag("span", own="Manufacturer").inside(_WRAPPER).followed_by("span"),
    ),
    image_fallback=tuple(
        tag("img", id=i)
        for i in (
            "landingImage",
            "imgBlkFront",
            "main-image",
            "imageBlockFront",
            "productImage",
            "acrImage",
        )
    ),
    rupee_prices=True,
    link_exclusions=(
        "aax-eu-zaz.amazon.in",
        "amazon.in/x/c/",
        "amazon.in/s?k=",
        "amazon.in/s?ie=",
        "amazon.in/ref=",
    ),
    link_pattern="/dp/[A-Z0-9]{10}",
    link_hint="dp",
    link_domain="amazon.in",
    next_page=(
        attr_is("aria-label", "Next Page", tag="a"),
        tag("a").inside(css_class("a-last").inside(css_class("a-pagination"))),
        tag("a", shows="Next"),
        tag("a").inside(css_class("a-next").inside(css_class("a-pagination"))),
        attr_is("data-testid", "pagination-next-button"),
        css_class("s-pagination-next"),
    ),
    swatch_row=attr_part("id", "inline-twister-row-", tag="div"),
    swatch_row_prefix="inline-twister-row-",
    swatch_option=has("data-asin", "li"),
    swatch_name=(
        css_class("swatch-title-text-display"),
        tag("img"),
        css_class("a-button-text"),
    ),
    swatch_gone="data-initiallyunavailable",
    dropdown=attr_part("name", "dropdown_selected", tag="select"),
    dropdown_prefix="dropdown_selected_",
    dimension_suffix="_name",
    dropdown_placeholder="Select",
)

_REGISTRY: dict[str, PlatformRules] = {}


def register(rules: PlatformRules) -> PlatformRules:
    """Plug in (or replace) the rules of a platform."""
    _REGISTRY[rules.name] = rules
    return rules


def rules_for(platform: str) -> PlatformRules | None:
    """Rules of a platform; None where there are none (its pages yield no product)."""
    return _REGISTRY.get(platform)


def registered() -> dict[str, PlatformRules]:
    return dict(_REGISTRY)


register(AMAZON)
