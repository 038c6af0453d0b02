"""Listing walks as a stream: sessions and listing snapshots in, product requests out as they are reached.

Snapshots arrive in any order, before or after their session. Each is parsed once; links and the next-page
flag go to the state of their session, the HTML does not. A session's state is the next page number of
its walk, the page before which it stops as far as is known, and the pages that came too early. A page's
requests are sent when all pages before it are there; pages beyond the stop are dropped at once.

The state is a pair of tables, ``walks`` and ``early``, committed with the requests of each batch. A batch
brings new sets of rows for the sessions it touches, by joins and minima only, so the pages of a large
session are spread over all tasks. Reading the state costs with the number of sessions, whatever the batch.
With ``keyed`` the state lies in RocksDB, session by session in a Python processor: slower by
the row, but a batch that touches few of very many sessions does not read the others.

A stop can only move forward in time to a lower page: by a second snapshot of a page that was
already passed. Pages sent beyond it are then taken back by a stop row, which ``read_requests`` heeds, so
that the result is that of the batch for any order of files and any batch size.

Pages without session or with a number below 1 take no part, nor do sessions without id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.joins import join_shuffled
from ..plans.retail import classify_sessions, listing_facts
from ..plans.rules import PlatformRules
from ..session import stage
from ..sinks.runs import RunLog
from .state import rocksdb_state

FOUND = "session_id long, page_no long, links array<string>, stop long, url string, stage string, error string"
#: What a session finds in a batch travels as one text, as do its events: Spark hands every column of every key over
#: by itself, and a batch of columns for every key.
SENT = "found string"
_EVENT = ("url", "stage", "error", "is_single", "walks", "page_limit", "page_no", "links", "has_next")


#: Early pages that lie in the walk's own value, so that they come and go with it; every call to the state is
#: a trip to another process. What is beyond lies apart, page by page.
HELD = 16


class Walk(StatefulProcessor):
    """State of one listing walk."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: ``early``: pages that came too early, JSON of page number to the link lists of its snapshots; ``more``: are there others?
        self.walk = handle.getValueState("walk", "known boolean, next long, stop long, early string, more boolean")
        self.early = handle.getMapState("early", "page_no long", "links string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out = []
        send = lambda **x: out.append({"session_id": key[0]} | x)
        fresh: dict[int, list] = {}
        known, stops = False, []
        for row in rows:
            r = json.loads(row.event)
            url, page_no, links = r.get("url"), r.get("page_no"), r.get("links") or []
            if "error" in r:
                send(url=url, stage=r["stage"], error=r["error"])
            if r.get("is_single"):
                send(page_no=1, links=[url])
            if r.get("walks"):
                known, limit = True, r.get("page_limit")
                stops += [1] if limit is None else [limit + 1] if limit else []
            if page_no is not None:
                fresh.setdefault(page_no, []).append(links)
                stops += [page_no] if not links else [page_no + 1] if not r.get("has_next") else []
        if fresh or known:
            self._advance(fresh, known, stops, send)
        if out:
            yield Row(found=json.dumps(out))

    def _advance(self, fresh: dict[int, list], known: bool, stops: list[int], send) -> None:
        state = self.walk.get()
        was, nxt, stop, text, more = state or (False, 1, None, None, False)
        early = {int(no): lists for no, lists in json.loads(text).items()} if text else {}
        known, held = known or was, stop
        stop = min([*stops, *([] if stop is None else [stop])], default=None)
        open_ = lambda no: stop is None or no < stop
        fresh = {no: lists for no, lists in fresh.items() if open_(no)}
        if known:
            again = [no for no in fresh if no < nxt]
            for no in again:
                for links in fresh.pop(no):
                    send(page_no=no, links=links)
            while open_(nxt):
                lists = early.pop(nxt, []) + fresh.pop(nxt, [])
                if more and self.early.containsKey((nxt,)):
                    lists = json.loads(self.early.getValue((nxt,))[0]) + lists
                    self.early.removeKey((nxt,))
                if not lists:
                    break
                for links in lists:
                    send(page_no=nxt, links=links)
                nxt += 1
        if stop != held:
            if stop < nxt:
                send(stop=stop)
            early = {no: lists for no, lists in early.items() if no < stop}
            for (no,) in list(self.early.keys()) if more else ():
                if no >= stop:
                    self.early.removeKey((no,))
        for no, lists in fresh.items():
            if no in early:
                early[no] += lists
            elif more and self.early.containsKey((no,)):
                self.early.updateValue((no,), (json.dumps(json.loads(self.early.getValue((no,))[0]) + lists),))
            elif len(early) < HELD:
                early[no] = lists
            else:
                self.early.updateValue((no,), (json.dumps(lists),))
                more = True
        now = (known, nxt, stop, json.dumps(early) if early else None, more)
        if state is None or now != tuple(state):
            self.walk.update(now)

    def close(self) -> None:
        pass


def _events(sessions: DataFrame, listing_pages: DataFrame, rules: PlatformRules) -> DataFrame:
    """Session rows and parsed listing pages in one form."""
    own = F.col("has_rules") & (F.col("platform") == rules.name)
    bad = F.when(~F.col("has_rules"), F.lit("no rules")).when(F.col("page_limit").isNull(), F.lit("page limit"))
    null = lambda kind: F.lit(None).cast(kind)
    started = classify_sessions(sessions).select(
        F.col("session_id").cast("long").alias("session_id"),
        F.col("start_url").alias("url"),
        F.lit("session").alias("stage"),
        bad.alias("error"),
        (own & F.col("is_single")).alias("is_single"),
        (own & ~F.col("is_single")).alias("walks"),
        "page_limit",
        null("long").alias("page_no"),
        null("array<string>").alias("links"),
        null("boolean").alias("has_next"),
    )
    pages = listing_facts(listing_pages.filter("session_id IS NOT NULL"), rules).select(
        F.col("session_id").cast("long").alias("session_id"),
        "url",
        F.lit("listing").alias("stage"),
        F.col("parse_error").alias("error"),
        F.lit(False).alias("is_single"),
        F.lit(False).alias("walks"),
        null("long").alias("page_limit"),
        F.when(F.col("page_no") >= 1, F.col("page_no").cast("long")).alias("page_no"),
        "links",
        "has_next",
    )
    return started.filter("session_id IS NOT NULL").unionByName(pages)


def _keyed(events: DataFrame) -> DataFrame:
    """What each session's processor finds. An event travels as a JSON text of what is not NULL."""
    texts = events.select("session_id", F.to_json(F.struct(*_EVENT)).alias("event"))
    found = texts.groupBy("session_id").transformWithState(Walk(), SENT, "Append", "None")
    return found.select(F.inline(F.from_json("found", f"array<struct<{FOUND}>>")))


STATE = ("walks", "early")


def _latest_walks(walks: DataFrame) -> DataFrame:
    newest = walks.groupBy("session_id").agg(F.max(F.struct("batch", "known", "next", "stop")).alias("w"))
    return newest.select("session_id", "w.*")


def _latest_early(log: RunLog, walks: DataFrame) -> DataFrame:
    """Early pages of each session's newest set."""
    return join_shuffled(log.read("early"), walks.select("session_id", "batch"), ["session_id", "batch"])


def _ends(events: DataFrame, held: DataFrame | None) -> DataFrame:
    """Sessions that a batch touches: known?, the stop now and the one ``held`` before, and the next page before the batch."""
    no, none = F.col("page_no"), F.lit(None).cast("long")
    limit = F.when(F.col("page_limit").isNull(), F.lit(1).cast("long")).when(F.col("page_limit") != 0, F.col("page_limit") + 1)
    end = F.when(F.coalesce(F.size("links"), F.lit(0)) <= 0, no).when(~F.coalesce("has_next", F.lit(False)), no + 1)
    walks = F.coalesce(F.col("walks"), F.lit(False))
    rows = events.filter(walks | no.isNotNull()).select(
        "session_id", F.lit(True).alias("touched"), walks.alias("known"), F.when(walks, limit).otherwise(end).alias("stop"),
        none.alias("held"), F.lit(1).cast("long").alias("next"),
    )
    if held is not None:
        rows = rows.unionByName(held.select("session_id", F.lit(False).alias("touched"), "known", "stop", F.col("stop").alias("held"), "next"))
    most = [F.max(c).alias(c) for c in ("touched", "known", "held", "next")]
    return rows.groupBy("session_id").agg(*most, F.min("stop").alias("stop")).filter("touched").drop("touched")


def _reached(pages: DataFrame, ends: DataFrame) -> DataFrame:
    """``ends`` with ``reached``, the page that a known walk waits for: the first number from ``next`` on without a page."""
    mark = lambda k, here: F.struct(k.alias("k"), F.lit(here).alias("here"))
    ahead = pages.filter("known AND page_no >= next")
    marks = ahead.select("session_id", F.inline(F.array(mark(F.col("page_no"), True), mark(F.col("page_no") + 1, False))))
    marks = marks.unionByName(ends.filter("known").select("session_id", F.inline(F.array(mark(F.col("next"), False)))))
    numbers = marks.groupBy("session_id", "k").agg(F.max("here").alias("here"))
    gaps = numbers.filter("NOT here").groupBy("session_id").agg(F.min("k").alias("gap"))
    return join_shuffled(ends, gaps, "session_id", "left").withColumn("reached", F.coalesce("gap", "next")).drop("gap")


def _outputs(rows: DataFrame, pages: DataFrame, stops: DataFrame) -> dict[str, DataFrame]:
    """Tables of a batch: its requests by the links of ``pages``, stops, and the errors among ``rows``."""
    links = pages.select("session_id", "page_no", F.posexplode("links").alias("i", "requested_url"))
    return {
        "requests": links.select("session_id", "page_no", (F.col("i") + 1).cast("long").alias("link_ord"), "requested_url"),
        "stops": stops,
        "quarantine": rows.filter("error IS NOT NULL").select(F.lit(None).cast("long").alias("page_id"), "url", "stage", "error"),
    }


def _merge(log: RunLog, events: DataFrame, batch_id: int) -> None:
    """Write a batch's rows and the new state of the sessions it touches as one committed run."""
    held = _latest_walks(log.read("walks")) if log.commits() else None
    pages = events.filter("page_no IS NOT NULL").select("session_id", "page_no", F.coalesce("links", F.array().cast("array<string>")).alias("links"))
    if held is not None:
        pages = pages.unionByName(_latest_early(log, held).select("session_id", "page_no", "links"))
    ends = stage(_ends(events, held), "walk-ends")
    open_ = stage(join_shuffled(pages, ends, "session_id").filter("stop IS NULL OR page_no < stop"), "walk-pages")
    ends = stage(_reached(open_, ends), "walk-ends")
    placed = join_shuffled(open_, ends.select("session_id", "reached"), "session_id")
    sent = placed.filter("known AND page_no < reached").select("session_id", "page_no", "links")
    single = events.filter("is_single").select("session_id", F.lit(1).cast("long").alias("page_no"), F.array("url").alias("links"))
    stops = ends.filter("NOT stop <=> held AND stop < reached").select("session_id", "stop")
    number = F.lit(batch_id).cast("long").alias("batch")
    state = {
        "walks": ends.select("session_id", number, "known", F.col("reached").alias("next"), "stop"),
        "early": placed.filter("NOT known OR page_no >= reached").select("session_id", number, "page_no", "links"),
    }
    log.append(_outputs(events, sent.unionByName(single), stops) | state, number=batch_id)


def _compact(log: RunLog, after: int) -> None:
    """Of the state, the newest sets only."""
    commits = log.commits()
    if len(commits) <= after:
        return
    names = dict.fromkeys(n for r in commits for n in r.paths)
    tables = {n: log.read(n) for n in names if n not in STATE}
    if "walks" in names:
        walks = _latest_walks(log.read("walks"))
        tables |= {"walks": walks, "early": _latest_early(log, walks)}
    log.compact(tables, after)


def start_requests(
    sessions: DataFrame,
    listing_pages: DataFrame,
    rules: PlatformRules,
    out: str,
    checkpoint: str,
    once: bool = True,
    compact_after: int = 64,
    keyed: bool = False,
) -> StreamingQuery:
    """Write requests, stops and quarantine rows of every micro-batch as one committed run.

    ``checkpoint`` and the batch number make a restart neither lose nor repeat rows. ``keyed`` says where
    the state lies; a stream is carried on as it was begun.
    """
    events = _events(sessions, listing_pages, rules)
    found = _keyed(events) if keyed else events
    spark = sessions.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        log = RunLog(spark, out)
        if log.has(number=batch_id):
            return
        rows = batch.persist()
        try:
            if keyed:
                stops = rows.filter("stop IS NOT NULL").select("session_id", "stop")
                log.append(_outputs(rows, rows.filter("links IS NOT NULL"), stops), number=batch_id)
            else:
                _merge(log, rows, batch_id)
        finally:
            rows.unpersist()
        _compact(log, compact_after)

    with rocksdb_state(spark):
        writer = found.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if once else writer.start()


def read_requests(spark: SparkSession, out: str) -> DataFrame:
    """session_id, page_no, link_ord and requested_url of all pages reached and not taken back."""
    log = RunLog(spark, out)
    stops = log.read("stops").groupBy("session_id").agg(F.min("stop").alias("stop"))
    rows = join_shuffled(log.read("requests"), stops, "session_id", "left")
    return rows.filter("stop IS NULL OR page_no < stop").drop("stop")


def read_rejected(spark: SparkSession, out: str) -> DataFrame:
    """Unreadable listing pages and sessions that cannot be walked."""
    return RunLog(spark, out).read("quarantine")
