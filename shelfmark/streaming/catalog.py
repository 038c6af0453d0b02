"""Products and their variants as a stream that equals the batch, whatever arrives first.

Product and variant snapshots are two file streams. Each snapshot is parsed once, its record goes to
the state of its main page's canonical URL: the product snapshot that counts there, and the variant
snapshot that counts for each ASIN, by the rules of the batch. When what counts changes, the page's
whole set of rows is sent anew with the next version: its product row, its variant rows with the carried
ones, its quarantine rows. A late variant snapshot thus corrects rows that were carried over, a better
product snapshot replaces the one before, and a page that becomes readable takes its quarantine row back.

Every micro-batch is one committed run of three tables and the changed keys, so readers never see a
product without its variants. Records travel and rest as JSON: states hold strings only.

The state is a table of the records that counted when they came, committed under ``state`` before the batch that
they came with. A batch reads it through a filter of its own keys and is merged with it by joins. With
``keyed`` the state lies in RocksDB, page by page in a Python processor: slower by the row, but a
batch that touches few of very many pages does not read the others.

Pages off the rules' platform take no part, nor do variant snapshots without main URL or ASIN.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.urls import canonical
from ..operators.extract import FIELDS, extract_products, kept_products
from ..operators.joins import first_rows, join_shuffled, likely_among
from ..operators.quarantine import rejected
from ..operators.variants import CARRY, carry_states, flatten_options, split_variants
from ..operators.whitelist import label
from ..plans.retail import on_platform, product_facts
from ..plans.rules import PlatformRules
from ..schemas import PRODUCT_COLUMNS, VARIANT_COLUMNS
from ..session import stage
from ..sinks.runs import ChangeLog, RunLog
from ..sinks.tables import sink_projection
from .state import rocksdb_state

_RECORD = ", ".join(f"{c}: string" for c in ("product_url", *FIELDS, "parse_error"))
VARIANT = f"struct<{_RECORD}>"
MAIN = f"struct<page_id: bigint, {_RECORD}, dims: array<struct<dim: string, options: array<struct<name: string, asin: string, value: string>>>>>"
SETS = "key string, version long, main string, variants string"


#: Variant snapshots that lie in the page's own value; every call to the state is a trip to another process.
#: What is beyond lies apart, ASIN by ASIN.
HELD = 64
_Held = Row("bad", "page_id", "url", "tie", "record")


class Page(StatefulProcessor):
    """What counts for one canonical URL: a product snapshot and a variant snapshot per ASIN."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        ranked = "bad boolean, page_id long, url string, tie long, record string"
        #: ``held``: JSON of ASIN to ranked snapshot; ``more``: are there others?
        self.main = handle.getValueState("main", f"version long, known boolean, {ranked}, asins string, held string, more boolean")
        self.variants = handle.getMapState("variants", "asin string", ranked)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best: dict[str | None, Row] = {}
        for r in rows:
            if r.asin not in best or self._rank(r) < self._rank(best[r.asin]):
                best[r.asin] = r
        state = self.main.get()
        version, known, *main, asins, held, more = state or (0, False, *[None] * 5, None, None, False)
        main = _Held(*main) if known else None
        asins = set(json.loads(asins)) if asins else set()
        held = json.loads(held) if held else {}
        changed = kept = False
        fresh = best.pop(None, None)
        if fresh is not None and (main is None or self._rank(fresh) < self._rank(main)):
            main, changed = _Held(*(fresh[c] for c in _Held)), True
            asins = {o["asin"] for d in json.loads(main.record).get("dims") or () for o in d["options"] if o.get("asin") is not None}
        for asin, r in best.items():
            own = tuple(r[c] for c in _Held)
            apart = more and asin not in held and self.variants.containsKey((asin,))
            old = held.get(asin) or (self.variants.getValue((asin,)) if apart else None)
            if old is not None and not self._rank(r) < self._rank(_Held(*old)):
                continue
            if apart or (asin not in held and len(held) >= HELD):
                self.variants.updateValue((asin,), own)
                kept, more = kept or not more, True
            else:
                held[asin], kept = own, True
            changed |= asin in asins
        changed = changed and main is not None
        if changed or kept:
            version += changed
            rank = tuple(main) if main is not None else (None,) * 5
            self.main.update((version, main is not None, *rank, json.dumps(sorted(asins)), json.dumps(held), more))
        if changed:
            found = {a: held[a][4] for a in asins if a in held}
            if more:
                found |= {a: self.variants.getValue((a,))[4] for a in asins if a not in held and self.variants.containsKey((a,))}
            yield Row(key=key[0], version=version, main=main.record, variants=json.dumps(found))

    @staticmethod
    def _rank(r: Row) -> tuple:
        """Readable before unreadable; then the lowest page_id or URL, none first; then the record's hash."""
        lowest = [(x is not None, x if x is not None else 0) for x in (r.page_id, r.url)]
        return r.bad, *lowest, r.tie

    def close(self) -> None:
        pass


def _snapshots(pages: DataFrame, variant_pages: DataFrame, rules: PlatformRules) -> DataFrame:
    """Parsed snapshots of both kinds in one form; those of variants have an ASIN."""
    record = ["product_url", *FIELDS, "parse_error"]
    bad = F.col("parse_error").isNotNull().alias("bad")
    mains = product_facts(pages, rules).select(
        canonical(F.col("product_url")).alias("key"),
        F.lit(None).cast("string").alias("asin"),
        bad,
        F.col("page_id").cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("url"),
        F.xxhash64("product_url", "title", "price").alias("tie"),
        F.to_json(F.struct("page_id", *record, "dims")).alias("record"),
    )
    found = extract_products(variant_pages, rules)
    variants = found.select(
        canonical(F.col("main_product_url")).alias("key"),
        "asin",
        bad,
        F.lit(None).cast("long").alias("page_id"),
        F.col("product_url").alias("url"),
        F.xxhash64(F.struct(*record)).alias("tie"),
        F.to_json(F.struct(*record)).alias("record"),
    )
    return mains.filter("key IS NOT NULL").unionByName(variants.filter("key IS NOT NULL AND asin IS NOT NULL"))


_PLACE = ("key", "version")
#: What makes a snapshot count before another, as in ``Page``; NULL comes first.
_ORDER = ["bad", "page_id", "url", "tie"]


def _opened(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main records of sent sets, and the options of the readable ones with their own ``variant`` or NULL."""
    facts = sets.select(*_PLACE, "variants", F.from_json("main", MAIN).alias("m")).select(*_PLACE, "variants", "m.*")
    options = flatten_options(facts.filter("parse_error IS NULL"))
    own = F.element_at(F.from_json("variants", "map<string,string>"), F.col("asin"))
    return facts.drop("variants"), options.withColumn("variant", F.from_json(own, VARIANT)).drop("variants")


def _merged(state: RunLog, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """``_opened`` of the pages that a batch changes. Its records that count now are committed to the state, whose
    rows of this batch, if it is repeated, are passed over."""
    fresh = stage(first_rows(batch, ["key", "asin"], [*_ORDER, "record"]).withColumn("batch", F.lit(batch_id).cast("long")), "page-records")
    if state.commits():
        old = likely_among(state.read("records").filter(F.col("batch") < batch_id), F.col("key"), fresh.select("key"), "key")
        best = stage(first_rows(old.unionByName(fresh), ["key", "asin"], [*_ORDER, "batch", "record"]), "page-records")
    else:
        best = fresh
    new = F.col("batch") == batch_id
    state.append({"records": best.filter(new)}, number=batch_id)
    mains = best.filter("asin IS NULL").select("key", new.alias("_new"), F.from_json("record", MAIN).alias("m")).select("key", "_new", "m.*")
    variants = best.filter("asin IS NOT NULL")
    named = mains.select("key", F.explode("dims").alias("d")).select("key", F.explode("d.options.asin").alias("asin"))
    touched = join_shuffled(named, variants.filter(new).select("key", "asin"), ["key", "asin"], "left_semi").select("key")
    changed = mains.filter("_new").select("key").unionByName(touched).distinct()
    facts = join_shuffled(mains.drop("_new"), changed.withColumn("version", F.lit(batch_id + 1).cast("long")), "key")
    facts = stage(facts.select(*_PLACE, *[c for c in facts.columns if c not in _PLACE]), "pages")
    records = variants.select("key", "asin", F.from_json("record", VARIANT).alias("variant"))
    return facts, join_shuffled(flatten_options(facts.filter("parse_error IS NULL")), records, ["key", "asin"], "left")


def _compact_state(state: RunLog, after: int) -> None:
    if len(state.commits()) > after:
        state.compact({"records": first_rows(state.read("records"), ["key", "asin"], [*_ORDER, "batch", "record"])}, after)


def _outputs(facts: DataFrame, options: DataFrame, whitelist: DataFrame, on_missing: str) -> dict[str, DataFrame]:
    """Rows of all tables, with key and version, of pages that changed and their options."""
    place = _PLACE
    read = facts.filter("parse_error IS NULL")
    joined = options.withColumn("main_product_url", F.col("key"))
    found, aside = split_variants(carry_states(joined, ["key"]), on_missing, keep=place, keep_aside=place)
    unread = rejected(facts, "product", F.col("parse_error"), F.col("page_id"), "product_url", place)
    products = kept_products(read.drop("dims")).withColumn("table", F.lit("products"))
    # both tables are labelled at once
    named = products.unionByName(found.withColumn("table", F.lit("variants")), allowMissingColumns=True)
    labelled = stage(label(named, whitelist), "labelled")
    rows = lambda table, columns: sink_projection(labelled.filter(F.col("table") == table), (*place, *columns))
    return {
        ChangeLog.CHANGED: facts.select(*place),
        "products": rows("products", PRODUCT_COLUMNS),
        "variants": rows("variants", VARIANT_COLUMNS),
        "quarantine": unread.unionByName(aside),
    }


def start_catalog(
    pages: DataFrame,
    variant_pages: DataFrame,
    rules: PlatformRules,
    whitelist: DataFrame,
    out: str,
    checkpoint: str,
    once: bool = True,
    on_missing: str = CARRY,
    compact_after: int = 64,
    keyed: bool = False,
) -> StreamingQuery:
    """Write products, variants and quarantine rows of every page that a micro-batch changes.

    Both page tables are streams. ``checkpoint`` and the batch number make a restart neither lose
    nor repeat rows; ``read_catalog`` gives the tables as they stand. ``keyed`` says where the state
    lies; a stream is carried on as it was begun.
    """
    spark = pages.sparkSession
    snapshots = _snapshots(pages.filter(on_platform(rules)), variant_pages.filter(on_platform(rules)), rules)
    sets = snapshots.groupBy("key").transformWithState(Page(), SETS, "Update", "None") if keyed else snapshots
    state = RunLog(spark, f"{out.rstrip('/')}/state")

    def write(batch: DataFrame, batch_id: int) -> None:
        log = ChangeLog(spark, out)
        if log.has(number=batch_id):
            return
        if keyed:
            batch = batch.persist()
        try:
            facts, options = _opened(batch) if keyed else _merged(state, batch, batch_id)
            log.append(_outputs(facts, options, whitelist, on_missing), number=batch_id)
        finally:
            if keyed:
                batch.unpersist()
        log.compact(after=compact_after)
        if not keyed:
            _compact_state(state, compact_after)

    with rocksdb_state(spark):
        writer = sets.writeStream.outputMode("update" if keyed else "append").foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if once else writer.start()


def read_catalog(spark: SparkSession, out: str, table: str) -> DataFrame:
    """``products``, ``variants`` or ``quarantine`` after the last committed micro-batch."""
    return ChangeLog(spark, out).latest(table).drop("key", "version")
