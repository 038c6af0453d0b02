import random

from pyspark.sql import functions as F

from shelfmark.operators import whitelist as wl
from shelfmark.session import stage
from shelfmark.operators.joins import first_rows
from shelfmark.sources.whitelist import from_setting, parse_entries, size_of
from tests.conftest import plan_of

GOLDEN = [
    ("Nike Store", "", "Whitelisted"),
    ("", "puma", "Whitelisted"),
    ("Adidas", "NIKE", "Whitelisted"),
    ("e", "", "Whitelisted"),
    ("   ", "\xa0 ", "False"),
    ("Adidas", "Reebok", "False"),
    (" puma india ", "x", "Whitelisted"),
]


def model(seller, maker, entries):
    if not entries:
        return "False"
    for name in (seller, maker):
        name = (name or "").strip().lower()
        if name and any(name in e.lower() or e.lower() in name for e in entries):
            return "Whitelisted"
    return "False"


def names(spark, rows):
    return spark.createDataFrame(
        [(n, s, m) for n, (s, m) in enumerate(rows)],
        "n int, seller_name string, manufacturer_name string",
    )


def labels(df):
    return [r.is_whitelisted for r in sorted(df.collect(), key=lambda r: r.n)]


def test_parse(evaluate):
    got = evaluate([" Nike , ,Puma India,", "", None, ",,", "a"], parse_entries)
    assert got == [["Nike", "Puma India"], [], [], [], ["a"]]
    assert evaluate([" Nike , ,Puma India,", ""], size_of) == [2, 0]


def test_golden_both_forms(spark):
    table = from_setting(spark, "Nike, Puma India")
    df = names(spark, [(s, m) for s, m, _ in GOLDEN])
    want = [w for _, _, w in GOLDEN]
    assert labels(wl.label(df, table)) == want
    assert labels(wl.label_with_list(df, [" Nike ", "", "Puma India"])) == want
    assert labels(wl.label(df, from_setting(spark, " , "))) == ["False"] * len(want)
    assert labels(wl.label_with_list(df, [])) == ["False"] * len(want)


def test_random_against_model(spark):
    rng = random.Random(3)

    def word(lo, hi):
        return "".join(rng.choice("abé ") for _ in range(rng.randint(lo, hi)))

    entries = sorted({w for w in (word(1, 6).strip() for _ in range(25)) if len(w) > 2})
    rows = [(word(0, 9), word(0, 5)) for _ in range(400)]
    rows += [("hot " + word(0, 1), "aa")] * 300  # one pair of names holds many rows
    want = [model(s, m, entries) for s, m in rows]
    assert "False" in want and "Whitelisted" in want
    table = spark.createDataFrame([(e,) for e in entries + entries[:3]], "entry string")
    df = names(spark, rows)
    assert labels(wl.label(df, table)) == want
    assert labels(wl.label_with_list(df, entries)) == want


def test_large_list_takes_the_join(spark):
    table = spark.range(2000).select(F.concat(F.lit("seller "), F.col("id")).alias("entry"))
    df = names(spark, [("Seller 77 Ltd", ""), ("sell", ""), ("other", "1999"), ("zzz", "")])
    out = wl.label(df, table)
    assert labels(out) == ["Whitelisted", "Whitelisted", "Whitelisted", "False"]
    plan = plan_of(wl.label(df, table))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_into_the_join_are_linear_in_the_text(spark):
    """Texts of 2,000 characters and patterns of hundreds of lengths; every pair is tested once."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(2_000))
    texts = [long, long[::-1], "abc", "x", "xyzw"]
    patterns = [long[a : a + n] for a, n in ((rng.randrange(1_500), rng.randrange(1, 500)) for _ in range(300))]
    patterns = sorted({*patterns, "zz", "xyzw!", "w", "bc", long + "a", "hhhhhhhhhhhh"})
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    got = wl.containing(t, p)
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for x in texts for y in patterns if y in x)
    assert t.select(F.explode(wl._pieces(F.col("text"), wl.PIECE))).count() <= sum(map(len, texts))


def test_trusted_only(spark):
    df = names(spark, [(s, m) for s, m, _ in GOLDEN])
    out = wl.trusted_only(wl.label(df, from_setting(spark, "Nike, Puma India")))
    assert out.count() == sum(w == "Whitelisted" for _, _, w in GOLDEN)


def test_pages_are_parsed_once_under_a_label(spark, pages_of, monkeypatch):
    from shelfmark.operators import whitelist
    from shelfmark.operators.extract import extract_products
    from shelfmark.plans.rules import AMAZON

    staged = []
    monkeypatch.setattr(whitelist, "stage", lambda df, name: staged.append(plan_of(df)) or stage(df, name))
    out = wl.label(extract_products(pages_of("<h1>a</h1>"), AMAZON), from_setting(spark, "a"))
    assert [p.count("ArrowEvalPython") for p in staged] == [1]
    assert "ArrowEvalPython" not in plan_of(out)


def test_first_rows(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), (3000 - F.col("id")).alias("o"), "id")
    got = {r.k: r.id for r in first_rows(df, ["k"], ["o"]).collect()}
    assert got == {k: max(n for n in range(3000) if n % 7 == k) for k in range(7)}


def test_texts_that_share_a_hash_are_all_tested(spark, monkeypatch):
    """A piece of a text carries a hash of eight bytes; texts with equal ones are told apart by the exact test."""
    from shelfmark.operators import whitelist

    texts = ["the nike store", "puma outlet", "shop of nike", "ab", "xyz", ""]
    patterns = ["nike", "puma", "ab", "y", "store of", "outlet x"]
    want = {(t, p) for t in texts for p in patterns if p in t}
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("text", texts), ("pattern", patterns))]
    assert "text_hash" in {c for c in frames[0].select(whitelist._hash("text")).columns}
    for hashed in (whitelist._hash, lambda name: F.lit(7).cast("long").alias(f"{name}_hash")):
        monkeypatch.setattr(whitelist, "_hash", hashed)
        assert {tuple(r) for r in whitelist.containing(*frames).collect()} == want
