import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from shelfmark.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab É\n\t\x85\xa0Z", max_size=30)), max_size=8)


@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes_equal_those_of_a_pattern(texts, limit):
    found, by_hash = [], {}
    for _, _, words in W.word_slices(pa.array(texts, pa.string()), lower=True, limit=limit):
        own = [words.raw[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
        for word, value in zip(own, words.hashes().tolist(), strict=True):
            assert by_hash.setdefault(word, value) == value
        found += [own[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    assert found == [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t))] for t in texts]
    assert len(set(by_hash.values())) == len(by_hash)


def test_shingles_of_short_and_long_texts():
    hashes = np.arange(1, 12, dtype=np.uint64)
    value, begin = W.shingles(hashes, np.array([0, 0, 2, 2, 8, 11]))
    assert np.diff(begin).tolist() == [0, 1, 0, 2, 1]
    assert len(set(value.tolist())) == 4


def test_slices_of_a_sliced_array():
    texts = pa.array(["x", "a b", None, "c"]).slice(1)
    (_, _, words), = W.word_slices(texts)
    assert words.counts.tolist() == [2, 0, 1]
