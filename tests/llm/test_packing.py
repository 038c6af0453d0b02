import itertools

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from shelfmark.llm import packing as P


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_boundaries_have_the_least_padding(histogram, buckets):
    bins = sorted(histogram)
    cost = lambda ends: sum(n * min(e for e in ends if e >= b) for b, n in histogram.items())
    ends = P.boundaries(np.array(bins), np.array([histogram[b] for b in bins]), buckets)
    every = [(*some, bins[-1]) for k in range(buckets) for some in itertools.combinations(bins[:-1], k)]
    assert len(ends) <= buckets
    assert cost(ends) == min(map(cost, every))


def test_bins_hold_their_lengths(spark):
    rows = spark.range(0, 5000, 7).select("id", P.bin_of(P.F.col("id")).alias("bin")).collect()
    for r in rows:
        assert r.bin >= r.id
        assert r.bin == max(r.id, 1) if r.id <= P.EXACT else r.bin - r.id < r.id / P.PER_OCTAVE * 2
    assert len({r.bin for r in rows}) < 1100


def test_batches_keep_the_budget(documents, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 7)
    rows = P.pack(documents, buckets=4, budget=500).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {r.doc_id: len(r.text.split()) for r in documents.collect()}
    batches = {}
    for r in rows:
        assert r.padding == r.padded_length - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch_id), []).append(r)
    for (bucket, batch), own in batches.items():
        capacity = max(500 // own[0].padded_length, 1)
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == capacity or (bucket, batch + 1) not in batches and len(own) < capacity


def test_odd_rows(odd_documents, no_documents):
    rows = P.pack(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3, 9)} == {0}
    assert P.pack(no_documents).count() == 0
