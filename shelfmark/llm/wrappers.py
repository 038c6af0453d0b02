"""Main text of web pages by union-free regular-expression inference.

A page is a stream of tags and texts. Neighbouring equal groups of tokens are folded into one repeated
group, which leaves a short skeleton that many pages of a host share. The distinct skeletons of a host
are aligned one after the other: what both have stays, what only one has becomes an optional group, and
texts become slots. The outcome, a union-free expression with weights of the text seen in each slot, is
the host's wrapper. Only its weights are used: they decide which container holds the article. Pages of
every skeleton then emit the texts in that container but those beside the article, which fixed lists of
element names and of words in class, id and role names tell. Optional groups and texts that are constant
over a host decide nothing, so template text inside the article stays.

Skeletons are counted before they meet, and aligned in groups of at most ``MERGE`` until one wrapper
per host is left, so that a host with any number of pages needs no large task.

A null or empty page gives an empty text. Pages without a host in their URL form one host. Repeated
rows are extracted each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import stage

MERGE = 128
LONGEST_GROUP = 24
BROADCAST_SKELETONS = 20_000
#: Share of a wrapper's running text that a container without an article mark must hold.
ENOUGH = 0.7

#: Elements of HTML.
RAW = "script style noscript template textarea iframe svg title object select"
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
OUTSIDE = set("nav footer aside form button menu dialog head".split())
CLOSES_P = set("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class and id names that mark parts beside the article.
BESIDE = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " login menu modal nav navbar navigation newsletter notice notices popup promo promotion related recommended reply replies"
    " respond share sharing sidebar signup social sponsor sponsored subscribe widget".split()
)
MAIN = {"article", "main"}

TOKEN = re.compile(
    rf"(?P<gap><!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW.replace(' ', '|')})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?/][^a-zA-Z>][^>]*>|<[!?][^>]*>)"
    r"|(?P<tag></?[a-zA-Z](?:[^'\">]|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z))|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TEXT = "#"


@lru_cache(maxsize=20_000)
def signature(tag: str) -> str:
    """``name word word`` of a start tag, ``/name`` of an end tag: the words of its class, id and role."""
    name = _NAME.match(tag)[1].lower()
    if tag.startswith("</"):
        return "/" + name
    values = " ".join(a or b or c for a, b, c in _MARK.findall(tag)) if "=" in tag else ""
    return " ".join([name, *sorted(set(_WORD.findall(_CAMEL.sub(" ", values).lower())))])


def tokens(page: str) -> tuple[list[str], list[str]]:
    """Signatures and texts; a text stands where the signature is ``TEXT``. Inline tags and white space between tags go."""
    kinds: list[str] = []
    texts: list[str] = []
    for match in TOKEN.finditer(page):
        if match["text"] is not None:
            text = match["text"]
        elif match["tag"] is not None:
            kind = signature(match["tag"])
            name = kind.lstrip("/").split(" ", 1)[0]
            if name not in INLINE and name != "br":
                kinds.append(kind)
                texts.append("")
                continue
            beside = not kind.startswith("/") and BESIDE.intersection(kind.split(" ")[1:])
            text = " " if name == "br" else ""
            if beside:  # an inline element beside the article stays as a mark
                kinds.append(kind)
                texts.append("")
                continue
            if kind.startswith("/") and _open_mark(kinds, name):
                kinds.append(kind)
                texts.append("")
                continue
        else:
            continue
        if kinds and kinds[-1] == TEXT:
            texts[-1] += text
        elif text.strip():
            kinds.append(TEXT)
            texts.append(text)
    return kinds, texts


def _open_mark(kinds: list[str], name: str) -> bool:
    """Whether the nearest mark of an inline element of this name is still open."""
    for kind in reversed(kinds):
        if kind == "/" + name:
            return False
        if kind.split(" ", 1)[0] == name:
            return True
        if kind.split(" ", 1)[0].lstrip("/") in CLOSES_P:
            return False
    return False


@lru_cache(maxsize=20_000)
def balanced(unit: tuple[str, ...]) -> bool:
    """Whether a group closes what it opens and no more; the next copy closes an open ``p`` or ``li`` that it begins with."""
    stack: list[str] = []
    for kind in unit:
        name = kind.split(" ", 1)[0]
        if kind.startswith("/"):
            at = next((n for n in range(len(stack) - 1, -1, -1) if stack[n] == kind[1:]), None)
            if at is None:
                return False
            del stack[at:]
        elif kind != TEXT and name not in VOID:
            stack.append(name)
    return not stack or len(stack) == 1 and stack[0] in ("p", "li") and unit[0].split(" ", 1)[0] == stack[0]


def fold(kinds: list[str]) -> tuple[list[str], list[int]]:
    """Skeleton with repeated groups kept once, and each token's place in it. Only balanced groups fold: containers stay what they are."""
    now, place = kinds, list(range(len(kinds)))
    for _ in range(3):
        before = len(now)
        for unit in range(1, LONGEST_GROUP + 1):
            out: list[str] = []
            moved = []
            i = 0
            while i < len(now):
                if len(out) >= unit and now[i] == out[-unit] and now[i : i + unit] == out[-unit:] and balanced(tuple(out[-unit:])):
                    moved.extend(range(len(out) - unit, len(out)))
                    i += unit
                else:
                    moved.append(len(out))
                    out.append(now[i])
                    i += 1
            if len(out) < len(now):
                place = [moved[p] for p in place]
                now = out
        if len(now) == before:
            break
    return now, place


def align(left: list[list], right: list[list]) -> list[list]:
    """Merge two expressions of [signature, optional, weight] items into one without alternatives."""
    out: list[list] = []
    matcher = SequenceMatcher(None, [x[0] for x in left], [x[0] for x in right], autojunk=False)
    for what, a, b, c, d in matcher.get_opcodes():
        if what == "equal":
            out += [[x[0], x[1] or y[1], x[2] + y[2]] for x, y in zip(left[a:b], right[c:d], strict=True)]
        else:
            out += [[x[0], True, x[2]] for x in (*left[a:b], *right[c:d])]
    return out


def regions(kinds: list[str]) -> list[tuple[tuple[int, ...], bool]]:
    """For each token the open containers (their positions) and whether it is beside the article.

    Words of class, id and role names decide only while they leave something: where every article with
    text is beside, those of the outermost articles and of what encloses them do not count, and where a
    page without articles has no text left, none count.
    """
    out, mains = _regions(kinds, frozenset())
    texts = [i for i, kind in enumerate(kinds) if kind == TEXT]
    if not mains:
        if texts and all(out[i][1] for i in texts):
            out, _ = _regions(kinds, frozenset(range(len(kinds))))
        return out
    full = {m for i in texts for m in mains.intersection(out[i][0])}
    if full and all(all(out[i][1] for i in texts if m in out[i][0]) for m in full):
        outer = {m for m in full if not any(o in full for o in out[m][0] if o != m)}
        out, _ = _regions(kinds, frozenset(o for m in outer for o in out[m][0]))
    return out


def _regions(kinds: list[str], unmarked: frozenset[int]) -> tuple[list[tuple[tuple[int, ...], bool]], set[int]]:
    """Regions, and the positions of article containers. Marks of the ``unmarked`` containers do not count."""
    stack: list[tuple[str, int, bool, bool]] = []
    out = []
    mains = set()
    for i, kind in enumerate(kinds):
        name, *marks = kind.split(" ")
        if kind.startswith("/"):
            at = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == kind[1:]), None)
            if at is not None:
                del stack[at:]
        elif kind != TEXT and name not in VOID:
            if name in CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            inside = any(s[3] for s in stack)
            main = name in MAIN or "main" in marks or "articlebody" in "".join(marks)
            beside = name in OUTSIDE or bool(BESIDE.intersection(marks)) and name not in ("html", "body") and i not in unmarked or name == "header" and not inside
            stack.append((name, i, beside, main and not beside))
            if main:
                mains.add(i)
        out.append((tuple(s[1] for s in stack), any(s[2] for s in stack)))
    return out, mains


def article_container(wrapper: list[list]) -> str:
    """Signature of the container that holds the article; empty for the whole page."""
    kinds = [x[0] for x in wrapper]
    weight: dict[str, float] = {}
    total = 0.0
    depth: dict[str, int] = {}
    for (kind, _, seen), (open_at, beside) in zip(wrapper, regions(kinds), strict=True):
        if kind != TEXT or beside:
            continue
        total += seen
        for n, key in enumerate(dict.fromkeys(kinds[i] for i in open_at)):
            weight[key] = weight.get(key, 0) + seen
            depth[key] = n
    marked = [k for k in weight if k.split(" ")[0] in MAIN or "main" in k.split(" ")[1:]]
    if marked:
        # an article goes before what encloses it, unless most of the marked text stands elsewhere
        least = max(weight[k] for k in marked) / 2
        return max(marked, key=lambda k: (k.split(" ")[0] == "article" and weight[k] >= least, weight[k], k))
    large = [k for k in weight if weight[k] >= ENOUGH * total and k.split(" ")[0] in ("div", "section", "td", "table", "center", "body")]
    return max(large, key=lambda k: (depth[k], k)) if large else ""


def article_slots(kinds: list[str], container: str) -> list[bool]:
    """Which tokens of a skeleton are texts of the article."""
    spots = regions(kinds)
    held = [kind == TEXT and not beside and any(kinds[i] == container for i in open_at) for kind, (open_at, beside) in zip(kinds, spots, strict=True)]
    if any(held) or not container:
        return held if container else [kind == TEXT and not beside for kind, (_, beside) in zip(kinds, spots, strict=True)]
    own = article_container([[k, False, 1.0] for k in kinds])
    return article_slots(kinds, own) if own and own != container else [kind == TEXT and not beside for kind, (_, beside) in zip(kinds, spots, strict=True)]


def page_text(page: str, slots: list[bool] | None) -> str:
    """Blocks of the article's texts. ``slots`` are flags by skeleton position."""
    kinds, texts = tokens(page)
    _, place = fold(kinds)
    blocks = []
    for kind, text, at in zip(kinds, texts, place, strict=True):
        if kind == TEXT and slots and at < len(slots) and slots[at]:
            block = " ".join(html.unescape(text).split())
            if block:
                blocks.append(block)
    return "\n".join(blocks)


def host_of(url: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def skeletons(pages: DataFrame) -> DataFrame:
    """host, skeleton, its number of pages, and text lengths by place of the page with most text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for page in batch.column("html"):
                kinds, texts = tokens(page.as_py() or "")
                folded, place = fold(kinds)
                size = [0] * len(folded)
                for text, at in zip(texts, place, strict=True):
                    size[at] += len(text)
                out[0].append("\n".join(folded))
                out[1].append(sum(size))
                out[2].append(size)
            columns = [batch.column("host"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "skeleton", "total", "sizes"])

    cut = pages.select(host_of().alias("host"), "html").mapInArrow(run, "host string, skeleton string, total long, sizes array<long>")
    return cut.groupBy("host", "skeleton").agg(F.count("*").alias("pages"), F.max(F.struct("total", "sizes")).alias("most"))


def wrappers(found: DataFrame) -> DataFrame:
    """host and wrapper (JSON items), aligned from all skeletons of the host."""
    # the text is moderated by the number of pages, so that rare layouts weigh little
    first = F.udf(lambda s, n, sizes: json.dumps([[k, False, float(n * w)] for k, w in zip(s.split("\n"), sizes, strict=True)] if s else []), "string")
    level = found.select("host", F.col("skeleton").alias("name"), first("skeleton", "pages", "most.sizes").alias("wrapper"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("name")
        out: list[list] = []
        for item in group["wrapper"]:
            right = json.loads(item)
            out = align(out, right) if out else right
        return pd.DataFrame({"host": [group["host"].iloc[0]], "name": [group["name"].iloc[0]], "wrapper": [json.dumps(out)]})

    largest = level.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while True:
        share = -(-largest // MERGE) or 1
        part = F.pmod(F.xxhash64("name"), F.lit(share))
        level = stage(level.groupBy("host", part).applyInPandas(merge, "host string, name string, wrapper string"), "page-wrappers")
        if share == 1:
            return level.select("host", "wrapper")
        largest = level.groupBy("host").count().agg(F.max("count")).first()[0]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = stage(skeletons(rows), "page-skeletons")
    container = F.udf(lambda w: article_container(json.loads(w)), "string")
    # host and wrapper are one row per host; skeletons per host may be many, so the small side is a plain join
    chosen = found.select("host", "skeleton").join(wrappers(found).select("host", container("wrapper").alias("container")), "host")
    flags = F.udf(lambda s, c: article_slots(s.split("\n"), c) if s else [], "array<boolean>")
    slots = stage(chosen.select("host", F.xxhash64("skeleton").alias("key"), flags("skeleton", "container").alias("slots")), "page-slots")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = ["\n".join(fold(tokens(page.as_py() or "")[0])[0]) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.string())], [*batch.schema.names, "skeleton"])

    keyed = rows.select("page_id", "url", "html", host_of().alias("host")).mapInArrow(keys, f"page_id {dict(rows.dtypes)['page_id']}, url string, html string, host string, skeleton string")
    keyed = keyed.withColumn("key", F.xxhash64("skeleton")).drop("skeleton")
    joined = keyed.join(F.broadcast(slots) if slots.count() <= BROADCAST_SKELETONS else slots, ["host", "key"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [page_text(p.as_py() or "", s.as_py()) for p, s in zip(batch.column("html"), batch.column("slots"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "slots").mapInArrow(texts, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
