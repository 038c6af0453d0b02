import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import quality as Q
from shelfmark.llm import words as W


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|\r", max_size=60)), max_size=6))
def test_base_counts(texts):
    found = []
    for _, _, words in W.word_slices(pa.array(texts, pa.string()), limit=50):
        s = Q.statistics(words)
        found += np.column_stack([s[c] for c in Q.BASE]).tolist()
    assert found == [plain(t) for t in texts]


def test_trees_learn_and_keep_to_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(Q.FEATURES)))
    down = [Q.FEATURES.index(f) for f in Q.DECREASING]
    # the data say otherwise for one of the constrained features
    y = ((x[:, 0] > 0.4) & (x[:, down[0]] < 0.7) | (x[:, down[1]] > 0.9)).astype(float)
    trees = Q.fit(x, y, trees=30)
    p = trees.probability(x)
    assert ((p > 0.5) == y).mean() > 0.85
    for f in down:
        steps = np.repeat(x[:50], 20, axis=0)
        steps[:, f] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(trees.raw_score(steps).reshape(50, 20), axis=1) <= 1e-9).all()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((500, len(Q.FEATURES)))
    trees = Q.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), trees=5)
    for row, score in zip(x[:50], trees.raw_score(x[:50]), strict=True):
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert np.isclose(total, score)


def test_good_and_bad_documents_are_told_apart(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for n in range(300):
        bad = n % 3 == 0
        text = " ".join(f"word{rng.randrange(500)}" + ("%%%" if bad else "") for _ in range(80))
        rows.append((n, text))
        labels.append((n, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trees = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    for r in Q.judge(docs, trees).collect():
        assert r.kept == (r.doc_id % 3 != 0)
        assert not r.base_failed
    assert {r.doc_id for r in Q.keep(docs, trees).collect()} == {n for n in range(300) if n % 3}


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    trees = Q.train(odd_documents, labels)
    texts = [r.text for r in odd_documents.collect()]
    got = Q.judge(odd_documents, trees).collect()
    key = lambda r: tuple(r[c] for c in Q.BASE)
    assert sorted(map(key, got)) == sorted(tuple(plain(t)) for t in texts)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert Q.train(odd_documents, labels.limit(0)) is None
    assert Q.judge(no_documents, None).count() == 0
    assert Q.keep(odd_documents, None).columns == odd_documents.columns
