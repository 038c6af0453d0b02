from shelfmark.functions.nodes import with_dom
from shelfmark.operators.summary import options_per_dimension, session_totals, variants_per_product
from shelfmark.operators.variants import (
    dimensions,
    extract_variants,
    split_variants,
    flatten_options,
    variant_states,
)
from shelfmark.plans.rules import AMAZON


def li(asin, inner="", more=""):
    return f'<li data-asin="{asin}" {more}>{inner}</li>'


def sw(text):
    return f'<b class="swatch-title-text-display">{text}</b>'


def row(name, *items):
    return f'<div id="inline-twister-row-{name}"><ul>{"".join(items)}</ul></div>'


def box(name, *options):
    return f'<select name="{name}">{"".join(options)}</select>'


def dims_of(pages):
    dom = with_dom(pages, AMAZON.wanted_product_and_variants())
    rows = dom.select("page_id", dimensions(AMAZON).alias("d")).collect()
    out = []
    for r in sorted(rows, key=lambda r: r.page_id):
        out.append([(d.dim, [(o.name, o.asin, o.value) for o in d.options]) for d in r.d or []])
    return out


def test_dimensions(pages_of):
    got = dims_of(
        pages_of(
            row("color_name", li("A", sw(" Red ")), li("B", sw("Blue"), 'data-initiallyUnavailable="true"')),
            row("size_name_name", li("A", sw("S"))),
            row("c", li("A", sw(" ") + '<img alt=" Red ">'), li("B", '<i class="a-button-text">Btn</i>'), li("C", "t")),
            box(
                "dropdown_selected_size_name",
                "<option>Select",
                '<option value="">None',
                "<option> S  x ",
                '<option value="m" data-asin="Q"> M </option>',
            ),
            row("color_name", li("A", sw("Red")), li("B", sw("Blue")))
            + row("size_name", li("C", sw("L")))
            + box("dropdown_selected_color_name", '<option value="1">x', '<option value="2">y', '<option value="3">z'),
            row("none_name", li("A", sw("Red"), "data-initiallyunavailable=true")),
            "<p>plain</p>",
            None,
            row("outer_name", li("A", sw("1")) + row("inner_name", li("B", sw("2")))),
            row("ab_name", li("", sw("Empty asin")), "<li>no asin</li>"),
        )
    )
    assert got == [
        [("color", [("Red", "A", "A")])],
        [("size_name", [("S", "A", "A")])],
        [("c", [("Red", "A", "A"), ("Btn", "B", "B"), ("Unknown", "C", "C")])],
        [("size", [("S  x", "S x", "S x"), ("M", "Q", "m")])],
        [("color", [("x", "1", "1"), ("y", "2", "2"), ("z", "3", "3")]), ("size", [("L", "C", "C")])],
        [],
        [],
        [],
        [("outer", [("1", "A", "A"), ("2", "B", "B")]), ("inner", [("2", "B", "B")])],
        [("ab", [("Empty asin", "", "")])],
    ]


def test_flatten_is_a_sum(pages_of):
    html = row("color_name", li("A", sw("r")), li("B", sw("b"))) + row(
        "size_name", li("C", sw("s")), li("D", sw("m")), li("E", sw("l"))
    )
    dom = with_dom(pages_of(html), AMAZON.wanted_variants())
    df = dom.select("page_id", dimensions(AMAZON).alias("dims"))
    rows = sorted((r.dim_ord, r.opt_ord, r.dim, r.asin) for r in flatten_options(df).collect())
    assert rows == [
        (1, 1, "color", "A"),
        (1, 2, "color", "B"),
        (2, 1, "size", "C"),
        (2, 2, "size", "D"),
        (2, 3, "size", "E"),
    ]
    assert sorted(r.n_options for r in options_per_dimension(df).collect()) == [2, 3]


FIELDS = "title string, price string, seller_name string, manufacturer_name string, image_url string"
OPTION = "struct<name:string,asin:string,value:string>"


def mains(spark, *asins, page_id=1):
    options = [(a.upper(), a, a) for a in asins]
    data = [(page_id, "U", "U?x", "main", "₹1", "s", "m", "i", None, [("color", options)])]
    return spark.createDataFrame(
        data,
        f"page_id long, main_product_url string, product_url string, {FIELDS}, parse_error string, "
        f"dims array<struct<dim:string,options:array<{OPTION}>>>",
    )


def records(spark, *rows):
    data = [(m, a, f"V{a}", t, "₹2", "s", "m", "i", e) for m, a, t, e in rows]
    return spark.createDataFrame(
        data,
        f"main_product_url string, asin string, product_url string, {FIELDS}, parse_error string",
    )


def titles(df):
    return [(r.variant_asin, r.title, r.is_carried) for r in sorted(df.collect(), key=lambda r: r.opt_ord)]


def test_carry_forward(spark):
    m = mains(spark, "a", "b", "c")
    some = records(spark, ("U", "a", "A", None), ("U", "c", "C", None), ("W", "b", "other", None))
    assert titles(extract_variants(m, some)) == [("a", "A", False), ("b", "A", True), ("c", "C", False)]
    late = records(spark, ("U?q#z", "c", "C", None))
    assert titles(extract_variants(m, late)) == [("a", "main", True), ("b", "main", True), ("c", "C", False)]
    only = extract_variants(m, late, on_missing="quarantine")
    assert titles(only) == [("c", "C", False)]


def test_variant_columns(spark):
    out = extract_variants(mains(spark, "a"), records(spark, ("U", "a", "A", None))).first()
    assert (out.variant_product_url, out.main_product_url, out.variant_price) == ("Va", "U", "₹2")
    assert (out.variant_type, out.variant_option, out.variant_asin, out.price) == ("color", "A", "a", "₹2")


def test_unreadable_variant_page_is_left_out(spark):
    m = mains(spark, "a", "b", "c")
    bad = records(spark, ("U", "a", "A", None), ("U", "b", "", "no html"))
    assert titles(extract_variants(m, bad)) == [("a", "A", False)]
    states = variant_states(flatten_options(m), bad)
    assert states.filter("state.parse_error is not null").count() == 2
    rows = split_variants(states)[1].collect()
    assert sorted((r.url, r.stage, r.error) for r in rows) == [("U#b", "variant", "no html"), ("U#c", "variant", "no html")]
    rows = split_variants(states, "quarantine")[1].collect()
    assert sorted((r.url, r.error) for r in rows) == [("U#b", "no html"), ("U#c", "no snapshot")]


def test_duplicate_snapshots_do_not_multiply(spark):
    m = mains(spark, "a")
    twice = records(spark, ("U", "a", "A", None), ("U?x", "a", "B", None))
    assert extract_variants(m, twice).count() == 1
    better = records(spark, ("U", "a", "", "no html"), ("U?x", "a", "B", None))
    assert titles(extract_variants(m, better)) == [("a", "B", False)]


def test_totals(spark):
    p = spark.createDataFrame([(1,), (1,), (2,)], "session_id int")
    v = spark.createDataFrame([(1, "u"), (3, "u"), (3, "w")], "session_id int, main_product_url string")
    s = spark.createDataFrame([(n,) for n in range(1, 5)], "session_id int")
    rows = {r.session_id: (r.total_products, r.total_variants) for r in session_totals(s, p, v).collect()}
    assert rows == {1: (2, 1), 2: (1, 0), 3: (0, 2), 4: (0, 0)}
    per = {r.main_product_url: r.n_variants for r in variants_per_product(v).collect()}
    assert per == {"u": 2, "w": 1}
