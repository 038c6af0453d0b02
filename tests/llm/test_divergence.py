import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """Every pair over every kept term, in Python integers."""
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            count[s].update(w for w in words if seen[w] >= 3)
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, by = p(whole), {s: p(c) for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in by:
            pairs = [(sum(f(by[s][t], by[o][t]) for t in kept), o) for o in by if o != s]
            terms = [(f(by[s][t], q[t]), t) for t in kept if count[s][t] and by[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def audited(spark, rows):
    data = [(*r, 1, "k", 2) for r in rows]
    df = spark.createDataFrame(data, "lang string, source string, text string, n long, part string, weight long")
    got = [tuple(r) for r in D.audit(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(seed, n, sources, words=300):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéßñ日") for _ in range(rng.randrange(1, 6))) for _ in range(words)]
    say = lambda: rng.choice([" ", "\n", "1", "--"]).join(pool[int(rng.random() ** 3 * words)] for _ in range(rng.randrange(0, 60)))
    return [(rng.choice(["x", "y", None]), f"s{int(rng.random() ** 2 * sources)}", say()) for _ in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Several slices, blocks of sources and blocks of terms even for few rows."""
    monkeypatch.setattr(D, "SLICE_BYTES", 500)
    monkeypatch.setattr(D, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(D, "BLOCK_TERMS", ((3, 20), (5, 10), (64, 4)))


def test_equals_brute_force(spark, small):
    rows = texts(1, 400, 8)
    want = plain(rows)
    assert len({r for r in want if r[2] == "term"}) > 500
    assert audited(spark, rows) == want


def test_equals_brute_force_in_whole_blocks(spark):
    rows = texts(2, 500, 40)
    assert audited(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "a", "one two"), (None, "", "ONE two"), ("", "b", "One TWO three \x00 é"), ("z", "only", "x"), ("z", None, ""), ("solo", "s", "w w w")]
    rows += [("r", "a", "same words here")] * 3 + [("r", "b", None)] + [("r", "c", "same " * 100_000)]
    got = audited(spark, rows)
    assert got == plain(rows)
    assert {("z", "only", "pair", "", 0, 1), ("z", "", "pair", "only", 0, 1)} <= got
    assert not {r for r in got if r[0] == "solo"}


def test_empty_table(spark):
    assert audited(spark, []) == set()


def test_prices_of_huge_counts_are_exact():
    counts = np.array([0, 10**10, 10**13])
    assert D.prices(counts, 10**14).tolist() == [1 + 10**9 * (c + 1) // 10**14 for c in counts.tolist()]


def test_joint_tables_count_all_terms_of_a_cell():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (50, 3))
    term, source = np.nonzero(counts)
    side = D.Side(term, source, counts[term, source], [100, 90, 80], 50)
    there, _ = D.cell_sums(side, side, 7, False)
    p = [D.prices(np.append(counts[:, s], [0] * 7), w) for s, w in enumerate([100, 90, 80])]
    assert there.tolist() == [[int(((a - b) ** 2 // b).sum()) for b in p] for a in p]
