import numpy as np

from shelfmark.llm import collision_ann as C


def exact(ids, vectors, query, own, k):
    d = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    keep = ids != own
    order = np.lexsort((ids[keep], d[keep]))[:k]
    return ids[keep][order].tolist()


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 300)
    monkeypatch.setattr(C, "QUERY_ROWS", 10)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 24))
    vectors = (centres[rng.integers(0, 8, 1500)] + 0.4 * rng.standard_normal((1500, 24))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = C.nearest(df, df.where("vec_id % 50 = 0"), 10).collect()
    hits = 0
    for q in range(0, 1500, 50):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        hits += len(set(exact(np.arange(1500), vectors, vectors[q], q, 10)) & {r.vec_id for r in own})
        for r in own:
            assert abs(r.score - np.sqrt(((vectors[q] - vectors[r.vec_id]) ** 2).sum())) < 1e-9
    assert hits >= 0.95 * 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1)]
    rows += [(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 2.0, 3.0], 1), (10, [], 1), (None, [1.0, 1.0], 1), (100, [1.0, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block long")
    got = C.nearest(df, df.where("vec_id in (0, 2, 3, 9, 100) or vec_id is null"), 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 0] == [(0, 1, 1), (0, 2, 7), (0, 3, 100), (0, 4, 8)]
    assert {r.query_id for r in got} == {0, 100}
    assert C.nearest(df.limit(0), df.limit(0)).count() == 0


def test_repeated_rows_of_one_id_do_not_end_the_search():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 16))
    query = vectors[0].copy()
    vectors[1:3] = query + 0.001 * rng.standard_normal((2, 16))
    again = np.repeat([1, 2], 10)
    ids, rows = np.concatenate([np.arange(400), again]), np.concatenate([vectors, vectors[again]])
    found = C.block_neighbours(ids, rows, np.array([0]), query[None], 10)
    assert found["vec_id"].tolist() == exact(np.arange(400), vectors, query, 0, 10)
