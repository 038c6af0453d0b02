from pyspark.sql import functions as F

from shelfmark.functions.clean import MAKER_STOPS, clean_maker, clean_price, with_stock
from shelfmark.functions.markup import read_elements
from shelfmark.functions.nodes import with_dom
from shelfmark.functions.selectors import (
    Wanted,
    attr_is,
    css_class,
    css_id,
    first_attr,
    first_image,
    first_text,
    has,
    tag,
)
from shelfmark.functions.text import collapse, strip
from shelfmark.operators.variants import _drop_first
from shelfmark.operators.extract import extract_products, kept_products
from shelfmark.operators.quarantine import split
from shelfmark.plans.rules import AMAZON
from tests.conftest import plan_of


def found(pages, sels, column, attrs=()):
    rows = with_dom(pages, Wanted(sels, attrs)).select("page_id", column.alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.page_id)]


def test_text_helpers(evaluate):
    texts = ["\xa0 a   b\n", "\x1c\x1dx\x1f", " \t ", "ok"]
    assert evaluate(texts, strip) == [t.strip() for t in texts]
    assert evaluate(texts, collapse) == [" ".join(t.split()) for t in texts]
    assert evaluate(["size_name_name", "x", "_name"], lambda c: F.expr(_drop_first("a", "_name"))) == [
        "size_name",
        "x",
        "",
    ]


def test_first_text(pages_of):
    sels = [tag("h1"), css_class("t")]
    pages = pages_of(
        "<h1> A&nbsp; B\n C </h1>",
        "<h1></h1><h1>X</h1><p class=t>Y</p>",
        "<p class=t>Y</p><h1>X</h1>",
        "<p>z</p>",
        "<h1>a<br>b<div>c</div>d</h1>",
        "<h1>a<script>var x</script><!-- y --><style>z</style></h1>",
        None,
        "",
    )
    got = found(pages, sels, first_text(sels))
    assert got == ["A B C", "Y", "X", None, "a b c d", "a", None, None]


def test_structure_selectors(pages_of):
    sel = [css_class("b").inside(css_class("a"))]
    pages = pages_of(
        "<i class=b>0</i><div class='x a'><p><i class='b q'>1</i></p></div>",
        "<div class=a></div><i class=b>0</i>",
        "<div class=a><div class=a></div><i class=b>2</i></div>",
    )
    assert found(pages, sel, first_text(sel)) == ["1", None, "2"]
    both = [css_class("a-size-small a-color-secondary")]
    pages = pages_of("<b class='a-size-small'>x</b><b class='a-color-secondary q a-size-small'>y</b>")
    assert found(pages, both, first_text(both)) == ["y"]


def test_sibling_is_nearest_parent_only(pages_of):
    sel = [tag("span", own="Sold by").followed_by("span")]
    pages = pages_of(
        "<p><span>Sold by</span></p><p><span>other</span></p>",
        "<span>x</span><span>Sold by </span><b></b><span>S</span><span>T</span>",
        "<span>Sold by<span>inner</span></span><span>S</span>",
    )
    assert found(pages, sel, first_text(sel)) == [None, "S", "S"]


def test_unclosed_markup(pages_of):
    sel = [tag("td"), tag("li")]
    pages = pages_of(
        "<table><tr><td>a<td>b<tr><td>c</table>after",
        "<ul><li>a<ul><li>b</ul><li>c</ul>",
        "<li>a</b></i></div> b",
        "<table><tr><td>x</table><p>y",
    )
    assert found(pages, sel, first_text(sel)) == ["a", "a b", "a b", "x"]


def test_hostile_markup_stays_linear():
    wanted = Wanted(everything=True)
    for text in ("<a " * 200_000, "<" * 500_000, "<b>" * 20_000, '<a href="' * 100_000, "</p>" * 200_000,
                 "<!--" * 100_000, "<p><li>" * 5_000):
        read_elements(text, wanted)


def test_first_attr(pages_of):
    sels = [attr_is("property", "og:t", tag="meta").at("content"), tag("img").at("alt"), tag("a")]
    pages = pages_of(
        "<meta property='og:t' content='  a  b '>",
        "<meta property='og:t' content=' '><a content=x>",
        "<img alt=i content=n>",
    )
    assert found(pages, sels, first_attr(sels, "content"), ["content"]) == ["a  b", "x", None]


def test_images(pages_of):
    sels = [css_id("landingImage"), has("src", "img")]
    attrs = ["src", "data-src", "data-lazy-src", "content"]
    cases = [
        ('<meta property="og:image" content="//cdn/x.jpg">', "https://cdn/x.jpg"),
        ('<meta property="og:image" content=" https://x">', None),
        ('<meta property="og:image" content=""><meta property="og:image" content="https://x">', None),
        ('<img id=landingImage src="" data-src="//c/y.png">', "https://c/y.png"),
        ('<img id=landingImage src="data:a" data-src="https://c/y.png">', None),
        ('<img src="/rel.png">', None),
        ('<img src="/rel.png"><img src="https://ok">', None),
        ('<img id=landingImage data-lazy-src="httpfoo ">', "httpfoo"),
    ]
    from shelfmark.functions.selectors import OG_IMAGE

    got = found(pages_of(*[h for h, _ in cases]), [*sels, OG_IMAGE], first_image(sels, True), attrs)
    assert got == [w for _, w in cases]


def test_price(evaluate):
    cases = {
        "1,299": "₹1,299",
        "₹1,299.00": "₹1,299.00",
        "$1,234.50": "₹1,234.50",
        "MRP: ₹ 499": "₹499",
        "Rs. 499": "₹.499",
        "1.299,00 €": "₹1.299,00",
        "₹100 - ₹200": "₹100₹200",
        "Free": "₹",
        "٤٩٩": "₹٤٩٩",
        "": "",
    }
    assert evaluate(list(cases), clean_price) == list(cases.values())


def test_stock(evaluate):
    rows = [("₹1", "Currently OUT OF STOCK."), ("", "out of stock"), ("₹1", "In stock"), ("₹1", None)]
    got = evaluate(rows, with_stock, ("a", "b"))
    assert got == ["Out of stock", "Out of stock", "₹1", "₹1"]


def test_maker(evaluate):
    cases = {
        "Brand: Nike": "Nike",
        "Manufacturer: Puma India Packer: X": "Puma India",
        "Brand: : Acme :": "Acme",
        "Acme Imported by Foo": "Acme",
        "Acme Manufacturer: Foo": "Acme",
        "Seller Direct": "",
        "Brand:": "",
        "Brand: Brand: X": "",
        "brand: Nike": "brand: Nike",
    }
    got = evaluate(list(cases), clean_maker)
    assert got == list(cases.values())
    assert not any(stop in text for stop in MAKER_STOPS for text in got)


PAGE = (
    "<h1 id=title> Shoe </h1><span class=a-price-whole>1,299</span>"
    "<div id=availability><span>{stock}</span></div>"
)


def test_extraction_and_keep_rule(pages_of):
    pages = pages_of(
        PAGE.format(stock="In stock"),
        PAGE.format(stock="out of stock"),
        "<div id=outOfStock>Out of stock</div>",
        "<p>nothing</p>",
        None,
        "<b class=price>Free</b>",
    )
    rows = {r.page_id: r for r in extract_products(pages, AMAZON).collect()}
    assert (rows[0].title, rows[0].price, rows[0].price_raw) == ("Shoe", "₹1,299", "1,299")
    assert rows[1].price == "Out of stock"
    assert (rows[2].title, rows[2].price) == ("", "Out of stock")
    assert all(v is not None for k, v in rows[4].asDict().items() if k not in ("price_raw",))
    kept = {r.page_id for r in kept_products(extract_products(pages, AMAZON)).collect()}
    assert kept == {0, 1, 2, 5}
    good, bad = split(extract_products(pages, AMAZON), "product", "product_url")
    assert [r.page_id for r in bad.collect()] == [4] and good.count() == 5


def test_registry_extension_without_code():
    from shelfmark.plans.rules import PlatformRules, register, rules_for, registered

    assert rules_for("flipkart") is None and set(registered()) == {"amazon"}
    mine = register(PlatformRules(name="shop", title=(tag("h2"),), price=(css_class("cost"),)))
    try:
        assert rules_for("shop") is mine
    finally:
        from shelfmark.plans import rules

        rules._REGISTRY.pop("shop")


def test_rules_without_fallbacks(pages_of):
    from shelfmark.plans.rules import PlatformRules

    mine = PlatformRules(name="shop", title=(tag("h2"),), price=(css_class("cost"),))
    row = extract_products(pages_of("<h2>T</h2><i class=cost>$5</i>"), mine).first()
    assert (row.title, row.price, row.seller_name, row.image_url) == ("T", "$5", "", "")


def test_one_parse_per_page(pages_of):
    plan = plan_of(kept_products(extract_products(pages_of("<h1>x</h1>"), AMAZON)))
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    # the filter on the fields stays above the step that evaluates the selectors
    assert plan.index("Filter") < plan.index("Generate inline")


def test_parallel_parse_equals_single(pages_of, spark):
    html = ["<h1>%d</h1>" % n for n in range(40)]
    one = extract_products(pages_of(*html), AMAZON).select("page_id", "title")
    many = extract_products(pages_of(*html).repartition(7, F.col("page_id")), AMAZON)
    assert sorted(one.collect()) == sorted(many.select("page_id", "title").collect())
