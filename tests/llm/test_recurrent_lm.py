import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import recurrent_lm as R

from .conftest import corpus


def lexicon_of(size=40):
    start = np.array([0, 3, 10, size - R.RARE if size > R.RARE else 20, size])
    return R.Lexicon(np.array([R.END]), np.array([5]), np.array([2]), 2, start, np.ones(size), np.ones(R.RARE), 100, 10)


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(R, "RARE", 20)
    lex = lexicon_of()
    rng = np.random.default_rng(0)
    p = {k: (rng.standard_normal(s) * 0.5).astype(np.float64) for k, s in R.shapes(lex).items()}
    given = rng.integers(0, lex.size, (3, 4))
    target = rng.integers(0, lex.size, (3, 4))
    fresh = np.zeros((3, 4), bool)
    fresh[1, 2] = True
    h = rng.standard_normal((3, R.HIDDEN))
    _, grad, _ = R.window_gradient(p, lex, h, given, target, fresh)
    for k, v in p.items():
        for at in rng.integers(0, v.size, 6):
            old = v.flat[at]
            v.flat[at] = old + 1e-5
            up = R.window_gradient(p, lex, h, given, target, fresh)[0]
            v.flat[at] = old - 1e-5
            down = R.window_gradient(p, lex, h, given, target, fresh)[0]
            v.flat[at] = old
            assert grad[k].flat[at] == pytest.approx((up - down) / 2e-5, abs=2e-6), k


def test_state_is_carried_through_whole_documents():
    lex = lexicon_of(120)
    p = R.initial(lex)
    rng = np.random.default_rng(1)
    lengths = [1, 400, 7, 0, 60]
    symbols = rng.integers(0, lex.size, sum(lengths))
    first = np.concatenate([[0], np.cumsum(lengths)])
    got = R.score_documents(symbols, first, p, lex)
    table = R.input_table(p)
    for d, n in enumerate(lengths):
        h, given, total = np.zeros((1, R.HIDDEN), np.float32), np.array([lex.end_symbol]), 0.0
        for t in range(n):
            h = R.step(h, table, given, p)[0]
            given = symbols[first[d] + t : first[d] + t + 1]
            total += R.log_probabilities(h, given, p, lex)[0][0]
        assert got[d] == pytest.approx(total, rel=1e-4, abs=1e-6)


def test_probabilities_of_all_symbols_add_up_to_one():
    lex = lexicon_of(120)
    h = np.random.default_rng(2).standard_normal((1, R.HIDDEN)).astype(np.float32)
    logs, _ = R.log_probabilities(np.repeat(h, lex.size, axis=0), np.arange(lex.size), R.initial(lex), lex)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("size", [1.0, 15.0, 60.0])
def test_log_probabilities_equal_plain_softmax(monkeypatch, size):
    """Also over several blocks of rows, and where outputs leave the range of exp."""
    monkeypatch.setattr(R, "BLOCK", 64)
    lex = lexicon_of(120)
    rng = np.random.default_rng(6)
    p = {k: (rng.standard_normal(s) * size).astype(np.float32) for k, s in R.shapes(lex).items()}
    h = rng.uniform(-1, 1, (300, R.HIDDEN)).astype(np.float32)
    target = rng.integers(0, lex.size, 300)
    norm = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    expected = []
    for row, at in zip(h.astype(np.float64), target, strict=True):
        c = int(np.searchsorted(lex.class_start, at, "right")) - 1
        low, high = lex.class_start[c : c + 2]
        expected.append(norm(p["classes"] @ row + p["class_bias"])[c] + norm(p["out"][low:high] @ row + p["out_bias"][low:high])[at - low])
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    for given in (None, grad):
        logs, back = R.log_probabilities(h, target, p, lex, given)
        assert logs == pytest.approx(np.array(expected), rel=1e-4, abs=1e-3)
    assert np.isfinite(back).all() and all(np.isfinite(v).all() for v in grad.values())


def plain_base(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]) for d, t in rows]
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, ws in tokens if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (out(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens}


@pytest.mark.parametrize("head", [10, 131_072])
def test_base_scores_equal_plain_counts(documents, monkeypatch, head):
    monkeypatch.setattr(R, "HEAD", head)
    monkeypatch.setattr(R, "SYMBOLS", 8)
    expected = plain_base(corpus())
    rows = R.learn_and_score(documents).collect()
    assert len(rows) == len(expected)
    for r in rows:
        held, n, known, total, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_training_beats_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(n, " ".join(f"{'ab'[n % 2]}{k}" for k in rng.integers(0, 30, 60))) for n in range(200)]
    got = R.learn_and_score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_odd_rows(odd_documents, no_documents):
    expected = plain_base([(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id != 6])
    got = R.learn_and_score(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert next(r for r in got if r.doc_id == 1).n_tokens == 1
    assert next(r for r in got if r.doc_id is None).held_out
    six = [(r.n_tokens, r.n_known, r.base_score, r.score) for r in got if r.doc_id == 6]
    assert six[0][0] == expected[5][1]
    assert six[0][:2] == six[1][:2]
    assert six[0][2:] == pytest.approx(six[1][2:], rel=1e-5)
    assert R.learn_and_score(no_documents).count() == 0
    nothing = R.learn_and_score(odd_documents.where("doc_id is null")).collect()
    assert [(r.n_known, r.train_tokens) for r in nothing] == [(0, 0)]
