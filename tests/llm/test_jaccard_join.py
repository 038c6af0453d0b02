import itertools
import re

import numpy as np
import pytest

from shelfmark.llm import jaccard_join as J
from shelfmark.llm.components import components

from .conftest import corpus


def plain(rows):
    """(set size, component) by comparing all pairs."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    of = {d: d for d in sets}
    linked = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if linked(sets[a], sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(of[a], of[b])
            changed |= of[a] != least or of[b] != least
            of[a] = of[b] = least
    return {d: (len(s), of[d]) for d, s in sets.items()}


def check(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_components(df).collect()}
    assert got == plain(rows)
    return got


def test_components_equal_those_of_all_pairs(documents):
    got = check(documents, corpus())
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_borderline_chains_and_large_groups(spark, monkeypatch, seed):
    """Chains in which only neighbours link, more members than a group holds, and frequent tokens."""
    monkeypatch.setattr(J, "GROUP_ROWS", 4)
    monkeypatch.setattr(J, "ROUNDS", seed - 1)
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(40 + family)]
        for _ in range(12):
            rows.append((n, " ".join(words)))
            n += 1
            at = int(rng.integers(0, len(words)))
            words = [*words[:at], f"x{n}", *words[at + int(rng.integers(0, 2)) :]]
    common = " ".join(f"c{i}" for i in range(45))
    rows += [(n + i, f"{common} y{i} z{i % 3}") for i in range(12)]
    rows += [(n + 12 + i, f"{common} " + " ".join(f"q{i}_{k}" for k in range(20 + i))) for i in range(12)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_similarity_of_exactly_the_threshold_links(spark):
    a = [f"a{i}" for i in range(11)]  # 7 shingles
    rows = [(5, " ".join(a)), (3, " ".join(a[:-1] + ["b"]))]  # 6 of 8 shared
    assert check(spark.createDataFrame(rows, "doc_id long, text string"), rows)[5][1] == 3


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    expected = plain([r for r in rows if r[0] is not None])
    got = J.link_components(odd_documents).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == expected[r.doc_id] for r in got)
    assert J.link_components(no_documents).count() == 0


def by_row(rows):
    """(doc_id, set size, component) per row; a document's texts share their links."""
    texts = {n: t for n, (d, t) in enumerate(rows) if d is not None}
    of = plain(texts.items())
    least = {}
    for n, (_, c) in of.items():
        least.setdefault(c, set()).add(rows[n][0])
    joined = {d: {d} for d, _ in rows if d is not None}
    for ids in least.values():
        every = set().union(*(joined[d] for d in ids))
        for d in every:
            joined[d] = every
    return sorted((d, of[n][0], min(joined[d])) if d is not None else (-1, plain([(0, t)])[0][0], -1) for n, (d, t) in enumerate(rows))


def test_one_doc_id_under_several_texts(spark):
    text = lambda p, n=12: " ".join(f"{p}{i}" for i in range(n))
    rows = [(5, text("a")), (5, text("p")), (7, text("z")), (9, text("p", 13)), (9, text("q")), (4, text("q")), (4, text("q")), (8, text("a")), (8, "")]
    rows += [(3, ""), (3, text("b")), (2, text("b")), (2, None), (1, None), (None, text("a")), (None, ""), (6, text("c")), (6, text("d")), (0, "one two"), (0, "two")]
    got = J.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == by_row(rows)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (201, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_links_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    """Where the first turns found no links, not all linked pairs are left to the comparison of groups."""
    monkeypatch.setattr(J, "GROUP_ROWS", 8)
    monkeypatch.setattr(J, "ROUNDS", 0)
    rng = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(100)], []
    for n in range(120):
        words = list(base)
        for at in rng.integers(0, 100, 1 + n % 3):
            words[at] = f"x{n}"
        rows.append((n, " ".join(words)))
    told, compare = [], J.links_between
    monkeypatch.setattr(J, "links_between", lambda *a: told.append(compare(*a)) or told[-1])
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    assert told[0].count() <= len(rows)
