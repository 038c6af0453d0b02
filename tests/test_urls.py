import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.platforms import detect
from shelfmark.functions.urls import canonical, host, is_single_product, resolve
from shelfmark.sources.platforms import supports_variants, with_platform_facts
from tests.conftest import plan_of


def test_host(evaluate):
    cases = {
        "https://u:p@WWW.Amazon.in:443/x?y=1#z": "www.amazon.in",
        "https://a_b.amazon.in/a b|c": "a_b.amazon.in",
        "https://x.in?u=@amazon.in": "x.in",
        "www.amazon.in/dp/x": "",
        "http://[::1]:80/x": "::1",
        "//cdn.example/x": "cdn.example",
        "": "",
    }
    assert evaluate(list(cases), host) == list(cases.values())
    assert evaluate([(None,)], host) == [""]


def test_platform(evaluate):
    cases = {
        "www.amazon.in": "amazon",
        "notamazon.com": "amazon",
        "ebay.amazon.example": "amazon",
        "WWW.FLIPKART.COM": "flipkart",
        "amazon": "generic",
        "shopclues.com": "generic",
        "": "generic",
        "x.walmart.com": "walmart",
    }
    assert evaluate(list(cases), detect) == list(cases.values())


def test_platform_facts(spark):
    df = spark.createDataFrame([("tatacliq",), ("meesho",), ("generic",), ("foo",)], "platform string")
    rows = {r.platform: r for r in with_platform_facts(df).collect()}
    got = {k: (r.display_name, r.paging, r.variant_support) for k, r in rows.items()}
    assert got == {
        "tatacliq": ("TATA CLIQ", "no_pagination", True),
        "meesho": ("MEESHO", "infinite_scroll", False),
        "generic": ("UNKNOWN PLATFORM (Generic Mode)", "pagination", False),
        "foo": ("FOO", "pagination", False),
    }


def test_variant_support_by_name():
    names = ["amazon", "meesho", "generic", "foo"]
    assert [supports_variants(n) for n in names] == [True, False, False, False]


def test_single_product(evaluate):
    cases = [
        ("https://www.amazon.in/dp/B0FMXNKHSW", "amazon", True),
        ("https://www.amazon.in/s?k=shoes", "amazon", False),
        ("https://www.amazon.in/s?k=/dp/", "amazon", True),
        ("https://www.amazon.in/gp/product/B0", "amazon", True),
        ("https://www.flipkart.com/x/p/itm123", "flipkart", True),
        ("https://www.myntra.com/a/b/c/123/buy", "myntra", False),
        ("https://www.ebay.com/itm/123", "ebay", True),
        ("https://www.walmart.com/ip/123", "walmart", True),
        ("https://shop.example/a/b/c/product/1", "generic", True),
        ("https://shop.example/product/1", "generic", False),
        ("https://shop.example/A/B/C/ITEM/1", "ajio", True),
    ]
    got = evaluate([c[:2] for c in cases], is_single_product, ("a", "b"))
    assert got == [c[2] for c in cases]


def test_canonical(evaluate):
    urls = ["https://x/a?b#c", "https://x/a#c?d", "https://x/a", "?q", "#f", ""]
    once = evaluate(urls, canonical)
    assert once == ["https://x/a", "https://x/a", "https://x/a", "", "", ""]
    assert evaluate(once, canonical) == once


def test_resolve_against_urljoin(evaluate):
    rng = random.Random(7)
    pieces = ["a", "b1", "..", ".", "x-y", "c.d", "..e"]
    pages = ["https://s.example/", "https://s.example/p/q", "http://s.example/p/q/?k=1#z", "https://s.example/p/q/r"]
    rows = []
    for _ in range(600):
        path = "/".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        head = rng.choice(["", "/", "https://s.example/", "//s.example/"])
        tail = rng.choice(["", "/", "?q=/../x", "#f"])
        rows.append((head + path + tail, rng.choice(pages)))
    got = evaluate(rows, resolve, ("a", "b"))
    for (href, page), out in zip(rows, got):
        # urljoin leaves dots in links that name a host; browsers do not
        rooted = href.removeprefix("https:").removeprefix("//s.example")
        want = urljoin("https" + page[page.index(":") :] if href != rooted and href[0] == "h" else page, rooted)
        assert out == want, (href, page, out, want)


@pytest.mark.parametrize(
    "href,page,want",
    [
        ("", "https://x.example/a?b#c", "https://x.example/a?b"),
        ("?p=2", "https://x.example/a/b?q=1#t", "https://x.example/a/b?p=2"),
        ("#t", "https://x.example/a?q=1#s", "https://x.example/a?q=1#t"),
        ("HTTP://X.Example", "https://y/", "http://x.example/"),
        ("javascript:void(0)", "https://y/", "javascript:void(0)"),
        (" /a\tb ", "https://y/", "https://y/ab"),
        ("/für x", "https://y/", "https://y/f%C3%BCr%20x"),
        ("q", "https://Y.Example", "https://y.example/q"),
    ],
)
def test_resolve_cases(evaluate, href, page, want):
    assert evaluate([(href, page)], resolve, ("a", "b")) == [want]


def test_resolve_with_base(evaluate):
    rows = [("x", "https://y/a/b", "/base/z"), ("x", "https://y/a/b", None)]
    got = evaluate(rows, resolve, ("a", "b", "c"))
    assert got == ["https://y/base/x", "https://y/a/x"]


def test_no_python_in_url_plans(spark):
    df = spark.createDataFrame([("https://www.amazon.in/dp/x",)], "url string")
    u = F.col("url")
    plan = plan_of(
        df.select(host(u), detect(host(u)), canonical(u), resolve(u, u), is_single_product(u, detect(host(u))))
    )
    assert "EvalPython" not in plan
