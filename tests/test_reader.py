"""What the page reader remembers and leaves off between pages of a batch."""

import gc

import pyarrow as pa

from shelfmark.functions import nodes
from shelfmark.functions.markup import read_elements
from shelfmark.plans.rules import AMAZON

PAGE = (
    "<ul><li><a href='/a?x=1&amp;y'>Ne<b>xt</b></a><li><A HREF=/b Title=z>2</a></ul><script><a href=/no></script>"
    "<p class='price'>1<p class='price'>2<svg><a href=/s /></svg><a href='/a?x=1&amp;y'>Ne<b>xt</b></a>"
)


def test_tokens_that_repeat_are_taken_apart_once(monkeypatch):
    wanted, decided = AMAZON.wanted_listing(), []
    decide = wanted.decide
    monkeypatch.setattr(wanted, "decide", lambda tag, raw: (decided.append((tag, raw)), decide(tag, raw))[1])
    first = read_elements(PAGE, wanted)
    n = len(decided)
    assert n == len(set(decided))
    assert read_elements(PAGE, wanted) == first == read_elements(PAGE, AMAZON.wanted_listing())
    assert len(decided) == n  # nothing new on the second reading
    assert set(wanted.memo) >= {"<ul>", "</ul>", "</a>"}  # end tags too


def test_elements_of_one_token_do_not_share_what_is_filled_in_later():
    kept, index = read_elements("<a href=x>1</a><a href=x>2</a>", AMAZON.wanted_listing())
    assert [e[8] for e in kept] == ["1", "2"] and index["[href]"] == [0, 1]


def test_the_collector_rests_while_a_batch_is_read(monkeypatch):
    seen = []

    def read(text, wanted):
        seen.append(gc.isenabled())
        if text == "bad":
            raise ValueError(text)
        return read_elements(text, wanted)

    monkeypatch.setattr(nodes, "read_elements", read)
    out = nodes.read_batch(pa.array([PAGE, None, "", "bad", PAGE]), AMAZON.wanted_listing())
    assert seen == [False] * 3 and gc.isenabled()
    assert out.is_valid().to_pylist() == [True, False, False, False, True]
