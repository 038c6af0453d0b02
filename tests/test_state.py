"""State of streams: what one key costs in calls, and pages and snapshots beyond what its own value holds."""

import itertools
import json
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Row

from shelfmark.streaming import catalog, walk


class Handle:
    """State variables in memory that count the calls."""

    def __init__(self):
        self.calls = Counter()

    def getValueState(self, name, schema):
        self.value, n = None, len(schema.split(","))

        def update(row):
            assert len(row) == n
            self.value = row

        return self._counted(get=lambda: self.value, update=update, exists=lambda: self.value is not None)

    def getMapState(self, name, key, value):
        m = self.map = {}
        return self._counted(
            containsKey=m.__contains__, getValue=m.get, updateValue=m.__setitem__, removeKey=m.pop, keys=lambda: list(m)
        )

    def _counted(self, **calls):
        def count(name, f):
            return lambda *a: (self.calls.update([name]), f(*a))[1]

        return SimpleNamespace(**{name: count(name, f) for name, f in calls.items()})


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def event(page_no=None, links=None, has_next=True, walks=False, limit=None):
    fields = {"url": "u", "stage": "s", "walks": walks, "page_limit": limit, "page_no": page_no, "links": links, "has_next": has_next}
    return Row(event=json.dumps({k: v for k, v in fields.items() if v is not None}))


def walked(batches):
    w, handle = started(walk.Walk())
    sent = [list(w.handleInputRows((1,), iter(rows), None)) for rows in batches]
    assert all(len(rows) <= 1 for rows in sent)  # one row of one column a batch
    out = [r for rows in sent for row in rows for r in json.loads(row.found)]
    stop = min((r["stop"] for r in out if "stop" in r), default=None)
    return sorted((r["page_no"], *r["links"]) for r in out if r.get("links") and (stop is None or r["page_no"] < stop)), handle


def test_a_walk_costs_two_calls_a_batch():
    got, handle = walked([[event(2, ["b"])], [event(1, ["a"]), event(3, ["c"])], [event(walks=True, limit=0)]])
    assert got == [(1, "a"), (2, "b"), (3, "c")]
    assert handle.calls == {"get": 3, "update": 3}
    w, handle = started(walk.Walk())
    for _ in range(2):
        list(w.handleInputRows((1,), iter([event(walks=True, limit=1)]), None))
    assert handle.calls == {"get": 2, "update": 1}  # nothing new the second time


def test_walks_with_more_early_pages_than_the_value_holds():
    n = 3 * walk.HELD
    pages = [event(no, [f"l{no}"]) for no in range(n, 0, -1)] + [event(n - 1, ["again"]), event(2, ["twice"])]
    want = sorted([(no, f"l{no}") for no in range(1, n + 1)] + [(n - 1, "again"), (2, "twice")])
    for size in (1, 7, len(pages)):
        got, handle = walked([*itertools.batched(pages, size), [event(walks=True, limit=0)]])
        assert got == want and not handle.map
    cut = [*itertools.batched(pages, 5), [event(4, ["end"], has_next=False)], [event(walks=True, limit=0)]]
    got, handle = walked(cut)
    assert got == sorted([x for x in want if x[0] <= 4] + [(4, "end")]) and not handle.map


def snapshot(asin, bad=False, url="u", record="r", page_id=None, tie=0):
    return Row(asin=asin, bad=bad, page_id=page_id, url=url, tie=tie, record=record)


def main(*asins):
    return snapshot(None, page_id=1, record=json.dumps({"dims": [{"options": [{"asin": a} for a in asins]}]}))


def test_a_page_costs_two_calls_a_batch():
    p, handle = started(catalog.Page())
    first = list(p.handleInputRows(("k",), iter([main("A", "B"), snapshot("A", record="a"), snapshot("C")]), None))
    later = list(p.handleInputRows(("k",), iter([snapshot("B", record="b"), snapshot("A", bad=True)]), None))
    none = list(p.handleInputRows(("k",), iter([snapshot("B", url="v")]), None))
    assert [json.loads(r.variants) for r in first + later] == [{"A": "a"}, {"A": "a", "B": "b"}] and not none
    assert [r.version for r in first + later] == [1, 2]
    assert handle.calls == {"get": 3, "update": 2}


def test_pages_with_more_variants_than_the_value_holds():
    n = 2 * catalog.HELD + 3
    asins = [f"A{k}" for k in range(n)]
    rows = [snapshot(a, bad=True, record="bad") for a in asins] + [snapshot(a, record=a) for a in reversed(asins)] + [snapshot("A1", url="w", record="later")]
    for size, at in itertools.product((1, 50, n), (0, len(rows))):
        p, handle = started(catalog.Page())
        sent = []
        for batch in itertools.batched([*rows[:at], main(*asins), *rows[at:]], size):
            sent += p.handleInputRows(("k",), iter(batch), None)
        assert json.loads(sent[-1].variants) == {a: a for a in asins}
        assert [r.version for r in sent] == [*range(1, len(sent) + 1)]
        assert len(handle.map) == n - catalog.HELD
