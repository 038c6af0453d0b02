import pytest

from shelfmark.llm import wrappers as X

SHELL = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="page-with-sidebar">
<header>Site</header><nav><ul><li><a href=/a>Menu</a></li><li><a>More</a></li></ul></nav><!-- x -->
<div class="cookie-notice">We use cookies</div><aside>Side</aside>{main}
<form><label>Mail</label><input></form><div id="comments"><p>First!</p></div><footer>&copy; us</footer><script>var a="</p>";</script></body></html>"""

CASES = [
    ("<article><h1>Head &amp; line</h1><p>One <b>bold</b>\n two&nbsp;three.</p><p>Four<br>five</p></article>", "Head & line\nOne bold two three.\nFour five"),
    ("<article><p>One<p>Two <i>x</i></article>", "One\nTwo x"),
    ("<main><div>Text of main</div><div class='ad'>Buy</div></main>", "Text of main"),
    ("<article><p>Kept</p><div class=share>Share</div><section class='reader-comments'><article><p>no</p></article></section></article>", "Kept"),
    ("<article></article>", ""),
    ("<article><p>a < b and 1<2</p><!--> <p>after</p></article>", "a < b and 1<2\nafter"),
]


@pytest.mark.parametrize(("main", "text"), CASES)
def test_main_text_of_one_page(spark, main, text):
    pages = spark.createDataFrame([(1, "http://h.example/1", SHELL.format(main=main))], "page_id long, url string, html string")
    assert [r.text for r in X.extract(pages).collect()] == [text]


def test_page_without_article_mark(spark):
    page = lambda n: SHELL.format(main=f"<div id=wrap><div class='post-body'><p>{'long text ' * 30}{n}</p><p>more {n}</p></div><div>tags</div></div>")
    pages = spark.createDataFrame([(n, "http://h.example/x", page(n)) for n in range(5)], "page_id long, url string, html string")
    for r in X.extract(pages).collect():
        assert r.text == f"{'long text ' * 30}{r.page_id}\nmore {r.page_id}"


def test_repeats_fold_and_mismatches_become_optional():
    kinds = ["ul", "li", "#", "/li", "li", "#", "/li", "li", "#", "/li", "/ul"]
    folded, place = X.fold(kinds)
    assert folded == ["ul", "li", "#", "/li", "/ul"]
    assert [folded[p] for p in place] == kinds
    left = [[k, False, 1.0] for k in ["a", "#", "b", "c"]]
    right = [[k, False, 2.0] for k in ["a", "#", "c", "d"]]
    assert X.align(left, right) == [["a", False, 3.0], ["#", False, 3.0], ["b", True, 1.0], ["c", False, 3.0], ["d", True, 2.0]]


def test_wrappers_of_many_skeletons_meet_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(X, "MERGE", 3)
    main = lambda n: "<article>" + "".join(f"<h{1 + (n >> b & 1)}>t{b}</h{1 + (n >> b & 1)}>" for b in range(5)) + "</article>"
    pages = spark.createDataFrame([(n, f"http://h{n % 2}.example/", SHELL.format(main=main(n))) for n in range(32)], "page_id long, url string, html string")
    assert X.wrappers(X.skeletons(pages)).count() == 2
    assert {r.text for r in X.extract(pages).collect()} == {"\n".join(f"t{b}" for b in range(5))}


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(1, None, None, 0), (2, "http://a/", "", 0), (3, "no url", "plain words", 0), (None, "http://a/", "<article>x</article>", 0), (5, "http://a/", long, 0), (5, "http://a/", long, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, slots long")
    got = [(r.page_id, r.url, r.text) for r in X.extract(pages).collect()]
    deep = (5, "http://a/", "\n".join(["word"] * 20_000))
    assert sorted(got, key=str) == sorted([(1, None, ""), (2, "http://a/", ""), (3, "no url", "plain words"), (None, "http://a/", "x"), deep, deep], key=str)
    assert X.extract(pages.limit(0)).count() == 0


def test_nested_containers_of_one_name_stay_apart(spark):
    page = "<div id=page><article><h1>T</h1><div><div>A</div><p>B</p></div><h2>C</h2><p>D</p></article></div>"
    pages = spark.createDataFrame([(1, "http://h.example/1", page)], "page_id long, url string, html string")
    assert [r.text for r in X.extract(pages).collect()] == ["T\nA\nB\nC\nD"]
    kinds = ["p", "#", "p", "#", "div", "div", "#", "/div", "p", "/p", "/div"]
    assert X.fold(kinds)[0] == ["p", "#", "div", "div", "#", "/div", "p", "/p", "/div"]


@pytest.mark.parametrize(
    "main",
    [
        "<div class='content-sidebar-wrap'><article><p>Kept</p><div class=share>Share</div></article></div>",
        "<div id=page class='no-sidebar'><article><p>Kept</p></article></div>",
        "<article class='post has-comments'><p>Kept</p><section class=comments><article><p>no</p></article></section></article>",
        "<div class='content-sidebar-wrap'><p>Kept</p></div>",
    ],
)
def test_marks_around_the_article_do_not_empty_the_page(main):
    page = f"<html><body><nav>Menu</nav>{main}<footer>us</footer></body></html>"
    kinds = X.fold(X.tokens(page)[0])[0]
    container = X.article_container([[k, False, 1.0] for k in kinds])
    assert X.page_text(page, X.article_slots(kinds, container)) == "Kept"


def test_main_with_most_text_goes_before_a_short_article():
    kinds = ["body", "main", "#", "/main", "article teaser", "#", "/article", "/body"]
    assert X.article_container([[k, False, w] for k, w in zip(kinds, (0, 0, 900.0, 0, 0, 20.0, 0, 0), strict=True)]) == "main"
    kinds = ["main", "#", "article", "#", "/article", "/main"]
    assert X.article_container([[k, False, w] for k, w in zip(kinds, (0, 100.0, 0, 900.0, 0, 0), strict=True)]) == "article"
