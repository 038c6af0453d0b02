import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfmark.llm import substring_dedup as D
from shelfmark.llm import words as W

from .conftest import corpus, prose


@given(st.lists(st.lists(st.integers(0, 6), max_size=14), min_size=1, max_size=4), st.integers(1, 5))
def test_compact_windows_hold_every_subsequence_once(texts, width):
    token = np.array([x for t in texts for x in t], np.uint64)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for k, at, doc, left, right in D.compact_windows(token, begin, width):
        value = (token ^ D._SEEDS[k]) * D._SEEDS[k]
        for d in range(len(texts)):
            for i in range(begin[d], begin[d + 1]):
                for j in range(i + width - 1, begin[d + 1]):
                    inside = [c for c, e, a, b in zip(at, doc, left, right, strict=True) if e == d and a <= i <= c <= j <= b]
                    assert inside == [i + int(np.argmin(value[i : j + 1]))]


def _exact(rows, size=D.MIN_WORDS):
    """Words of stretches of ``size`` words that a lesser document has."""
    first, need = {}, {}
    for doc, text in sorted(rows):
        words = text.split()
        flags = np.zeros(len(words), bool)
        for k in range(len(words) - size + 1):
            if first.setdefault(tuple(words[k : k + size]), doc) != doc:
                flags[k : k + size] = True
        need[doc] = flags
    return need


def test_every_repeated_passage_is_found_and_verified(spark, documents):
    rows = corpus()
    words = {d: t.split() for d, t in rows}
    got = {d: np.zeros(len(w), bool) for d, w in words.items()}
    for r in D.repeated_passages(documents).collect():
        a, b = words[r.doc_id][r.start : r.end], words[r.match_doc_id][r.match_start : r.match_end]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        assert r.match_doc_id < r.doc_id
        assert r.end - r.start >= D.MIN_WORDS
        assert len(a & b) >= 0.75 * len(a | b)
        got[r.doc_id][r.start : r.end] = True
    for d, need in _exact(rows).items():
        assert not (need & ~got[d]).any(), d


def test_passages_are_cut_and_other_text_stays(spark):
    head, tail = " ".join(f"h{i}" for i in range(60)), " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{head} {tail}", 0), (2, f"  a b  {head} c\nd", 0), (3, head, 0), (4, None, 0)], "doc_id long, text string, n_chars int")
    left = {r.doc_id: r for r in D.without_passages(docs, D.repeated_passages(docs)).collect()}
    assert left[1].text == f"{head} {tail}"
    assert left[2].text == "  a b  c\nd"
    assert left[2].n_chars == 10
    assert 3 not in left
    assert left[4].text is None


def test_odd_rows(odd_documents, no_documents):
    got = D.repeated_passages(odd_documents).collect()
    assert {(r.doc_id, r.match_doc_id) for r in got} == {(6, 5)}
    assert D.repeated_passages(no_documents).count() == 0
    left = D.without_passages(odd_documents, D.repeated_passages(odd_documents))
    assert left.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert D.without_passages(no_documents, D.repeated_passages(no_documents)).count() == 0


@given(st.lists(st.booleans(), max_size=40))
def test_stretches_are_the_maximal_ones(flags):
    """Each stretch scores best among all that overlap it, and no good stretch is left beside them."""
    shared = np.array(flags, bool)
    total = np.concatenate([[0], np.cumsum(np.where(shared, 1, -2))])
    score = lambda i, j: total[j] - total[i]
    found = D.shared_stretches(shared, 1, 2)
    assert all(score(i, j) > 0 and shared[i] and shared[j - 1] for i, j in found)
    assert all(a < b for (_, a), (b, _) in zip(found, found[1:], strict=False))
    covered = np.zeros(len(flags), bool)
    for i, j in found:
        covered[i:j] = True
        assert all(score(i, j) >= score(a, b) for a in range(i, j) for b in range(a + 1, j + 1))
    assert not (shared & ~covered).any()


def test_edited_passages_are_found(spark):
    """Passages of 52 to 60 words with words exchanged, put in or left out, against the similarity of the planted pair."""
    rng = random.Random(11)
    rows, need = [], {}
    for n in range(400):
        passage = prose(rng, rng.randrange(52, 61), 10**9)
        at, size = rng.randrange(5, len(passage) - 8), rng.randrange(1, 4)
        gone, new = rng.choice([(size, size), (size, 0), (0, size)])
        edited = passage[:at] + prose(rng, new, 10**9) + passage[at + gone :]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (passage, edited))
        share = len(a & b) / len(a | b)
        if share < 0.75 or len(edited) < D.MIN_WORDS:
            continue
        text = lambda x: " ".join(prose(rng, 40, 10**9) + x + prose(rng, 40, 10**9))
        rows += [(2 * n, text(passage)), (2 * n + 1, text(edited))]
        need[2 * n + 1] = len(edited)
    got = {r.doc_id for r in D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = set(need) - got
    assert len(need) > 200
    assert len(missed) <= len(need) // 500, (len(missed), len(need))


@pytest.mark.parametrize("kinds", [3, 40, 10**9])
def test_window_bounds_of_a_slice_are_those_of_a_scan(kinds):
    rng = np.random.default_rng(kinds)
    counts = rng.integers(0, 120, 30)
    begin = np.concatenate([[0], np.cumsum(counts)])
    token = W.mix(rng.integers(0, kinds, begin[-1]).astype(np.uint64))
    doc = np.repeat(np.arange(len(counts)), counts)
    for width in (1, 7, 46):
        least = {low + int(token[low : low + width].argmin()) for d in range(len(counts)) for low in range(begin[d], begin[d + 1] - width + 1)}
        at = D.window_minima(token, doc, width)
        assert at.tolist() == sorted(least)
        left, right = D.bounds(at, token[at], doc[at], begin[:-1], begin[1:])
        for i, low, high in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
            first, last = int(begin[doc[i]]), int(begin[doc[i] + 1])
            assert low == max([j + 1 for j in range(first, i) if token[j] <= token[i]], default=first)
            assert high == min([j - 1 for j in range(i + 1, last) if token[j] < token[i]], default=last - 1)


def test_the_search_around_flags_is_prepared_once_and_finds_the_longest():
    rng = np.random.default_rng(3)
    for _ in range(40):
        shared, cost = rng.random(30) < 0.8, int(rng.integers(1, 7))
        around = D.longest_around(shared, cost)
        for at in np.flatnonzero(shared).tolist():
            i, j = around(at)
            worth = lambda a, b: np.where(shared[a:b], 1, -cost).sum()  # noqa: E731, B023
            most = max(b - a for a in range(at + 1) for b in range(at + 1, 31) if worth(a, b) >= 0)
            assert shared[i] and shared[j - 1] and i <= at < j and j - i <= most
            assert worth(i, j) >= 0


def test_a_batch_of_packed_sequences_is_read_from_any_row():
    rows = [b"", b"\x01\x00\x00\x00\x00\x00", b"\x02\x00\x00\x00\x00\x01" * 2]
    raw, at = D.packed(pa.array([b"abcdef", *rows]).slice(1))
    assert [D.unpacked(raw[a:b]).tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[], [1], [2 + (1 << 40)] * 2]
