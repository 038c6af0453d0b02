from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import bpe as B

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(B.default_path())
OWN = B.vocabulary(B.default_path())


@settings(deadline=None, max_examples=200)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="the's 1\n\t\x1c\x85\xa0é中²<|endoftext|>!", max_size=80)))
def test_ids_and_text_equal_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 4000, "ab" * 2000 + "!" * 500, "hello<|endoftext|>  world", " " * 900, "thethe" * 300])
def test_long_words_and_whole_strings(text):
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="abcdeth ", min_size=1, max_size=B.SHORT))
def test_scan_and_heap_agree(word):
    parts = [OWN.byte_ids[b] for b in word.encode()]
    assert OWN._scan(list(parts)) == OWN._heap(list(parts))


def test_incomplete_bytes_decode_as_in_the_library():
    ids = OWN.encode("é中😀")
    for cut in (ids[:-1], ids[1:]):
        assert OWN.decode(cut) == LIBRARY.decode(cut, skip_special_tokens=False)


def test_round_trip_and_odd_rows(odd_documents, no_documents):
    rows = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    encoded = B.encode(odd_documents)
    assert {r.doc_id: r.text for r in B.decode(encoded).collect()} == rows
    digests = B.digests(odd_documents).collect()
    assert len(digests) == odd_documents.count()
    for r in digests:
        ids = LIBRARY.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(rows[r.doc_id].encode()).hexdigest()
    assert B.digests(no_documents).count() == 0
