"""URL expressions. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, or_blank, strip

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
_HOST = rf"^(?:{_SCHEME})?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
_HEAD = rf"^((?:{_SCHEME})?(?://[^/?#]*)?)"

# Path markers of single-product URLs.
PRODUCT_MARKERS = {
    "amazon": ("/dp/", "/gp/product/"),
    "flipkart": ("/p/", "/item/"),
    "myntra": ("/buy/",),
    "ebay": ("/itm/",),
    "walmart": ("/ip/",),
}
# Words looked for in URLs of all other platforms.
PRODUCT_WORDS = "product|item|buy|dp|p/|itm|ip/"
MIN_PIECES = 6


def host(url: Column) -> Column:
    """Lower-case host without user info, port and IPv6 brackets; '' if there is none."""
    return or_blank(F.lower(F.btrim(F.regexp_extract(url, _HOST, 1), F.lit("[]"))))


def canonical(url: Column) -> Column:
    """Cut at the first ``?``, then at the first ``#``."""
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def is_single_product(url: Column, platform: Column) -> Column:
    """Does the URL name one product (True) or a listing (False)?"""

    def test(x):
        u, name = x["url"], x["platform"]
        many = F.size(F.split(u, "/")) > MIN_PIECES
        guess = many & F.lower(u).rlike(PRODUCT_WORDS)
        out = F.when(u.isNull(), F.lit(False))
        for known, marks in PRODUCT_MARKERS.items():
            hits = [F.contains(u, F.lit(m)) for m in marks]
            out = out.when(name == known, reduce(or_, hits))
        return out.otherwise(guess)

    return let(F.struct(url.alias("url"), platform.alias("platform")), test)


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    last = F.element_at(parts, -1)

    def step(acc, s):
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", acc).otherwise(F.array_append(acc, s))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    body = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when((F.size(kept) == 0), F.lit("/")).otherwise(F.concat(body, tail))


_UNSAFE = "[^\\x21-\\x7E]|[\"<>]"


def percent_encode(url: Column) -> Column:
    """UTF-8 percent-encode blanks, controls, quotes, angle brackets and non-ASCII."""

    def one(ch):
        coded = F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        return F.when(ch.rlike(_UNSAFE), coded).otherwise(ch)

    spelled = F.array_join(F.transform(F.split(url, ""), one), "")
    return F.when(url.rlike(_UNSAFE), spelled).otherwise(url)


def _parts(url: Column) -> Column:
    """Scheme with authority, path, and the rest from ``?`` or ``#`` on."""
    return F.struct(
        F.regexp_extract(url, _HEAD, 1).alias("head"),
        F.regexp_extract(url, _HEAD + "([^?#]*)", 2).alias("path"),
        F.regexp_extract(url, _HEAD + "[^?#]*(.*)$", 2).alias("rest"),
    )


def _authority(head: Column) -> Column:
    """Scheme and host in lower case, the scheme's own port dropped; user info as it is."""
    scheme = F.lower(F.regexp_extract(head, f"^({_SCHEME})?", 1))
    user = F.regexp_extract(head, rf"^(?:{_SCHEME})?//([^/?#]*@)", 1)
    place = F.lower(F.regexp_extract(head, rf"^(?:{_SCHEME})?//(?:[^/?#]*@)?(.*)$", 1))
    plain = F.when(scheme == "http:", F.regexp_replace(place, ":(80)?$", "")).when(
        scheme == "https:", F.regexp_replace(place, ":(443)?$", "")
    )
    return F.when(
        F.contains(head, F.lit("//")), F.concat(scheme, F.lit("//"), user, F.coalesce(plain, place))
    ).otherwise(F.lower(head))


def _tidy(url: Column) -> Column:
    """Plain scheme and host, a path for bare hosts, no dot segments."""

    def whole(p):
        path = (
            F.when(p["path"] == "", F.lit("/"))
            .when(p["path"].rlike("(^|/)[.]{1,2}(/|$)"), _drop_dots(p["path"]))
            .otherwise(p["path"])
        )
        return let(F.concat(_authority(p["head"]), path, p["rest"]), percent_encode)

    web = F.lower(url).rlike("^https?://")
    return F.when(web, let(_parts(url), whole)).otherwise(let(url, percent_encode))


_SAFE = "[!#-;=?-~]*"
_TIDY_URL = f"^https?://[a-z0-9.-]+/{_SAFE}$"
_TIDY_PATH = f"^/(?!/){_SAFE}$"


def resolve(href: Column, page_url: Column, base_href: Column | None = None) -> Column:
    """Absolute form of a link as a browser shows it, honouring ``<base href>``."""
    return let(_base(page_url, base_href), lambda b: _resolve_on(href, b))


def resolve_all(hrefs: Column, page_url: Column, base_href: Column | None = None) -> Column:
    """``resolve`` for an array of links; the page's own URL is taken apart once."""
    return let(
        _base(page_url, base_href), lambda b: F.transform(hrefs, lambda h: _resolve_on(h, b))
    )


def _base(page_url: Column, base_href: Column | None) -> Column:
    page = page_url
    if base_href is not None:
        page = let(base_href, lambda b: F.when(b.isNotNull(), _resolve_any(b, page_url)))
        page = F.coalesce(page, page_url)
    return let(
        page,
        lambda u: F.struct(
            u.alias("page"),
            _authority(F.regexp_extract(u, _HEAD, 1)).alias("head"),
            F.startswith(F.lower(u), F.lit("http")).alias("web"),
        ),
    )


def _resolve_on(href: Column, b: Column) -> Column:
    """Links that need no rewriting are settled by one regular expression each."""
    plain = ~F.contains(href, F.lit("/."))
    return (
        F.when(b["web"] & href.rlike(_TIDY_PATH) & plain, F.concat(b["head"], href))
        .when(href.rlike(_TIDY_URL) & plain, href)
        .otherwise(_resolve_any(href, b["page"]))
    )


def _resolve_any(href: Column, page_url: Column) -> Column:
    def join(x):
        h, page, p = x["h"], x["page"], x["p"]
        folder = F.regexp_replace(p["path"], "[^/]*$", "")
        return (
            F.when(h == "", F.substring_index(page, "#", 1))
            .when(h.rlike("^" + _SCHEME), h)
            .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(page, f"^({_SCHEME})", 1), h))
            .when(F.startswith(h, F.lit("/")), F.concat(p["head"], h))
            .when(F.startswith(h, F.lit("?")), F.concat(canonical(page), h))
            .when(F.startswith(h, F.lit("#")), F.concat(F.substring_index(page, "#", 1), h))
            .when(F.startswith(p["path"], F.lit("/")), F.concat(p["head"], folder, h))
            .otherwise(F.concat(p["head"], F.lit("/"), h))
        )

    clean = strip(F.regexp_replace(href, "[\t\n\r]", ""))
    x = F.struct(clean.alias("h"), page_url.alias("page"), _parts(page_url).alias("p"))
    return let(let(x, join), _tidy)
