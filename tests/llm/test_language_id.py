import itertools

import numpy as np

from shelfmark.llm import language_id as L


def test_forward_sums_all_segmentations():
    pieces = L.pieces(L.default_path())
    rng = np.random.default_rng(0)
    table = np.vstack([rng.random((pieces.n, 2)), np.full((1, 2), L.UNKNOWN_CHARACTER), np.zeros((1, 2))])
    of = {t: n for n, t in enumerate(pieces.texts)}
    for word in ("the", "straße", "xqzv", "ou"):
        marked = "▁" + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
            parts = [marked[a:b] for a, b in zip(at, at[1:], strict=False)]
            rows = [of.get(p, pieces.n if len(p) == 1 else pieces.n + 1) for p in parts]
            total += np.prod(table[rows], axis=0)
        model = L.Model(["a", "b"], table, L.default_path())
        assert np.allclose(model.word_scores([word])[0], np.log(total))


def test_expectation_counts_add_up_to_segment_lengths():
    pieces = L.pieces(L.default_path())
    table = np.full((pieces.n + 2, 1), 0.01)
    table[-1] = 0
    (_, codes), = L.by_length(["there", "house"])
    counts = L.expected_counts(pieces.grid(codes), codes.shape[1], table, np.array([2.0, 3.0]))
    length = np.array([*(len(t) for t in pieces.texts), 1, 0])
    assert np.isclose((counts * length).sum(), 5 * 6)


def _languages(spark):
    rng = np.random.default_rng(1)
    stems = {"en": "the of and that with was".split(), "de": "der und nicht ein ich zu".split(), "fr": "les une dans pour avec est".split()}
    rows = [(n, " ".join(rng.choice(stems[lang], 20)), lang) for n, lang in enumerate(["en", "de", "fr"] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_texts_get_their_language(spark):
    docs = _languages(spark)
    rows = L.learn_and_predict(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 30
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    got = L.learn_and_predict(odd_documents).collect()
    assert len(got) == odd_documents.count()
    for r in got:
        if r.doc_id in (1, 2, 3, 7, 9):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert L.learn_and_predict(no_documents).count() == 0
    model = L.learn(odd_documents.where("doc_id <> 7"))
    kept = L.keep(odd_documents, model)
    assert kept.columns == odd_documents.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {None, 4, 5, 6, 8}


def test_all_parts_of_long_letter_runs_are_learned(spark):
    word = "a" * L.LONGEST_WORD + "b" * L.LONGEST_WORD + "c"
    docs = spark.createDataFrame([(1, word, "xx"), (2, "ab", "xx")], "doc_id long, text string, lang string")
    got = {r.word: r.n for r in L.sampled_word_counts(docs).collect()}
    assert got == {"a" * L.LONGEST_WORD: 1, "b" * L.LONGEST_WORD: 1, "c": 1, "ab": 1}
