import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>, score long, part long, key string"


def plain(rows):
    """Every pair scored in Python integers."""
    ok = {}
    for vec_id, label, x in rows:
        if vec_id is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        ok[vec_id] = min(ok.get(vec_id, (label, x)), (label, x))
    whole = {v: (label, [int(c * 256 // 1) if abs(c) < 2**52 else int(c) * 256 for c in x]) for v, (label, x) in ok.items()}
    out = set()
    for a, (label, x) in whole.items():
        if a % 100:
            continue
        scored = [(max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(x, y)))), b, other) for b, (other, y) in whole.items() if b != a and len(y) == len(x)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for s, b, _ in [s for s in scored if s[2] == label][:5]:
            found = [n for n in scored if n[2] != label and 30 * s <= 100 * n[0] <= 90 * s][:10]
            out |= {(a, b, rank, n[1], s, n[0]) for rank, n in enumerate(found, 1)}
    return out


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA)
    got = [tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture
def small(monkeypatch):
    """Several blocks, parts and chunks even for few rows."""
    monkeypatch.setattr(H, "ANCHOR_BYTES", 400)
    monkeypatch.setattr(H, "PART_ROWS", 300)
    monkeypatch.setattr(H, "CHUNK_ROWS", 64)
    monkeypatch.setattr(H, "CHUNK_ANCHORS", 3)


def test_equals_brute_force(spark, small):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((4, 6))
    rows = [(i, int(k := rng.integers(0, 4)), (centres[k] * 0.5 + 0.4 * rng.standard_normal(6)).round(2).tolist()) for i, _ in zip(range(-300, 1000), range(1300))]
    want = plain(rows)
    assert len(want) > 400 and mined(spark, rows) == want


def test_ties_repeats_and_one_vector_in_a_third_of_the_rows(spark, small):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [1.0, 0.5] if i % 3 == 0 else [rng.choice([0.5, 1.0, -1.0]), rng.choice([0.25, 0.5])]) for i in range(900)]
    rows += rows[:150] + [(7, 0, [9.0, 9.0]), (8, 2, [-1.0, 0.0])]
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (3, None, [0.5, 0.5]), (4, 2, None), (5, 2, [nan, 0.5]), (6, 2, [inf, 0.5]), (7, 2, [None, 0.5])]
    rows += [(None, 2, [0.5, 0.5]), (8, 2, [0.5]), (9, 2, []), (100, 3, [0.0, 0.0]), (200, 3, [0.0, 0.0]), (300, 4, []), (400, 4, []), (500, 5, [-1.0, 0.0]), (600, 5, [-0.5, 0.0]), (700, 6, [1.0, 2.0])]
    got = mined(spark, rows)
    assert got == plain(rows)
    assert {(r[0], r[1]) for r in got} >= {(0, 1), (100, 200), (300, 400)}


def test_large_components_are_exact(spark):
    rows = [(0, 1, [2.0**40, 1.0]), (1, 1, [2.0**14, 3.0]), (2, 2, [2.0**13, 0.0]), (3, 2, [2.0**13, 1.0]), (100, 1, [1e30, 0.0]), (4, 2, [1e30, 5.0]), (5, 2, [-1e300, 0.0])]
    assert mined(spark, rows) == plain(rows)


def test_packed_keys_keep_order_and_values(spark):
    rng = random.Random(3)
    edge = [0, -1, 1, 2**63 - 1, -(2**63)]
    rows = [(rng.choice(edge), rng.choice([*edge, rng.randrange(-99, 99)]), rng.randrange(2), rng.choice(edge)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, s long, k long, i long").select("*", H.packed(F.col("a"), F.col("s"), F.col("k"), F.col("i")).alias("key"))
    got = [tuple(r)[:4] for r in df.orderBy("key").collect()]
    assert got == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    import pyarrow as pa

    back = H.unpacked(pa.array([bytes(r.key) for r in df.collect()]))
    assert list(zip(*(x.tolist() for x in back))) == rows


def test_empty_table(spark):
    assert mined(spark, [(1, 1, [1.0])][:0]) == set()
    assert mined(spark, [(1, 1, [1.0])]) == set()
