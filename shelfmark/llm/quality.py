"""Quality rules: base rules, then gradient-boosted trees over document statistics.

Statistics come from one vectorised pass over the texts. Trees are grown on the driver from a
bounded sample of labelled rows (``SAMPLE_ROWS``), flattened into node arrays and scored with numpy.
Features in ``DECREASING`` may only lower the score and are held to that while trees grow.

Null or empty texts have no words: all counts 0, ``base_failed`` true, ``kept`` false. Repeated rows
are judged each for itself. Without labels of both kinds the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.tables import freed

MIN_WORDS = 50
SAMPLE_ROWS = 20_000
#: Verdict: kept if the trees' probability of good quality reaches this.
KEEP_FROM = 0.35

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share",
    "upper_share", "digit_share", "punct_share", "wide_share", "line_words", "stop_share", "bang_share",
)
#: A larger value never raises the score.
DECREASING = ("symbols_per_word", "dup_line_share", "repeat_share")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:()'\"-?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?")] = True


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeated(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice within their row."""
    same = W.mix(keys + W.mix(row.astype(np.uint64)))
    _, inverse, count = np.unique(same, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    _, first = np.unique(W.mix(keys + W.mix(row.astype(np.uint64))), return_index=True)
    return np.bincount(row[first], minlength=rows)


def statistics(words: W.Words) -> dict[str, np.ndarray]:
    """Base counts and features of each text of a slice."""
    raw, at, rows = words.raw, words.at, words.rows
    n, doc, hashes = words.counts, words.doc, words.hashes()
    lead = (raw & 0xC0) != 0x80
    chars = np.maximum(_per_row(lead, at), 1)
    base = {"n_words": n, "word_chars": _per_row(lead & ~words.space, at), "n_symbols": _per_row(_SYMBOL[raw], at)}

    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    edge[1:] |= np.append(raw == 10, False)[:-1]
    line_start = np.flatnonzero(edge[:-1])
    line_end = np.append(line_start[1:], len(raw))
    line_row = np.searchsorted(at, line_start, "right") - 1
    filled = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end, line_row = line_start[filled], line_end[filled], line_row[filled]
    stop = line_end - (raw[line_end - 1] == 10) if len(line_end) else line_end
    lines = np.bincount(line_row, minlength=rows)
    base["n_dup_lines"] = lines - _distinct(W.span_hashes(raw, line_start, stop), line_row, rows)

    covered = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        inside = doc[2:] == doc[:-2]
        triple = (hashes[:-2] * np.uint64(3) + W.mix(hashes[1:-1]) * np.uint64(5) + W.mix(hashes[2:] + np.uint64(7)))[inside]
        begin = np.flatnonzero(inside)[_repeated(triple, doc[:-2][inside])]
        for j in range(3):
            covered[begin + j] = True
    base["n_repeat_words"] = np.bincount(doc[covered], minlength=rows)

    some = np.maximum(n, 1)
    features = (
        np.log1p(n), base["word_chars"] / some, base["n_symbols"] / some, base["n_dup_lines"] / np.maximum(lines, 1),
        base["n_repeat_words"] / some, _distinct(hashes, doc, rows) / some, _per_row(_UPPER[raw], at) / chars,
        _per_row(_DIGIT[raw], at) / chars, _per_row(_PUNCT[raw], at) / chars, 1 - _per_row(raw < 128, at) / chars,
        n / np.maximum(lines, 1), _per_row(_STOP[raw], at) / some, _per_row(raw == 33, at) / some,
    )
    return base | {"features": np.column_stack([x.astype(np.float64) for x in features])}


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            score += leaf[node - inner]
        return score

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_score(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, ridge: float = 5.0) -> Trees:
    """Histogram boosting on logistic loss. A constrained split passes the midpoint of its two
    values down as a bound, so no deeper split can undo the order."""
    signs = np.array([-1 if name in DECREASING else 0 for name in FEATURES])
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    code = np.column_stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)])
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, inner, width = np.full(len(y), start), 2**depth - 1, x.shape[1]
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            low[2 * i + 1 : 2 * i + 3], high[2 * i + 1 : 2 * i + 3] = low[i], high[i]
            best = (1e-9, 0, np.inf, 0.0)
            if len(mine) >= 20:
                clip = lambda v, i=i: np.clip(v, low[i], high[i])
                gs, hs = g[mine].sum(), h[mine].sum()
                gain_of = lambda v, a, b: -(a * v + 0.5 * (b + ridge) * v * v)
                whole = gain_of(clip(-gs / (hs + ridge)), gs, hs)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    gl = np.bincount(code[mine, f], g[mine], len(edges[f]) + 1).cumsum()[:-1]
                    hl = np.bincount(code[mine, f], h[mine], len(edges[f]) + 1).cumsum()[:-1]
                    vl, vr = clip(-gl / (hl + ridge)), clip(-(gs - gl) / (hs - hl + ridge))
                    gain = gain_of(vl, gl, hl) + gain_of(vr, gs - gl, hs - hl) - whole
                    gain[(hl < 1e-3) | (hs - hl < 1e-3) | (signs[f] * (vr - vl) < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, edges[f][k], (vl[k] + vr[k]) / 2)
            _, f, cut, middle = best
            out.feature[t, i], out.threshold[t, i] = f, cut
            if np.isfinite(cut) and signs[f]:
                low[2 * i + 1], high[2 * i + 2] = middle, middle
            node[mine] = 2 * i + 1 + (x[mine, f] > cut)
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = np.clip(-gs / (hs + ridge), low[inner:], high[inner:]) * rate
        out.leaf[t] = np.where(np.isfinite(value), value, 0)
        score += out.leaf[t][leaf]
    return out


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    for batch in batches:
        for low, high, words in W.word_slices(batch.column("text")):
            yield batch.slice(low, high - low), statistics(words)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the feature array of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s in _slices(batches):
            columns = [rows.column("doc_id"), *(pa.array(s[c].astype(np.int64)) for c in BASE)]
            offsets = pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32())
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(s["features"].ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {_SCHEMA}")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``rows`` labelled documents, chosen by a hash of the id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    total = known.count()
    share = min(1.0, 0.95 * rows / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn.limit(rows)), "doc_id")
    keep = texts.select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, s in _slices(batches):
            offsets = pa.array(np.arange(len(rows_) + 1) * len(FEATURES), pa.int32())
            x = pa.ListArray.from_arrays(offsets, pa.array(s["features"].ravel()))
            yield pa.RecordBatch.from_arrays([rows_.column("doc_id"), rows_.column("quality"), x], ["doc_id", "quality", "features"])

    got = keep.mapInArrow(run, "doc_id long, quality double, features array<double>").dropDuplicates(["doc_id"]).limit(rows).toPandas().sort_values("doc_id")
    x = np.array(got.features.tolist(), np.float64).reshape(len(got), len(FEATURES))
    return x, got.quality.to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame) -> Trees | None:
    x, y = labelled_sample(docs, labels)
    return fit(x, y) if 0 < y.sum() < len(y) else None


def judge(docs: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, base counts, ``base_failed``, ``score`` and ``kept`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s in _slices(batches):
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            score = trees.probability(s["features"]) if trees else np.ones(len(rows))
            columns = [*(rows.column(c) for c in carry), *(pa.array(s[c].astype(np.int64)) for c in BASE)]
            columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_from))]
            yield pa.RecordBatch.from_arrays(columns, [*carry, *BASE, "base_failed", "score", "kept"])

    taken = list(dict.fromkeys([*carry, "text"]))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{c} long" for c in BASE), "base_failed boolean, score double, kept boolean"])
    return docs.select(*taken).mapInArrow(run, schema)


def keep(docs: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of documents that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s in _slices(batches):
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            good = trees.probability(s["features"]) >= keep_from if trees else np.ones(len(rows), bool)
            yield rows.filter(pa.array(~failed & good))

    return docs.mapInArrow(freed(run), docs.schema)
