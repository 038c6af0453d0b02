"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of one fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, by a forward algorithm; a text's is the product
over its words. Piece probabilities are learned by expectation-maximisation (forward-backward) from
word counts of a bounded sample of labelled documents, ``SAMPLE_DOCS`` per language; each round is a
Spark job over those counts, and only the piece table (pieces x languages) comes back.

Words are runs of letters in lower case; characters beyond ASCII count as letters. A text that is
null or has no letter is ``und`` with score 0. Equal scores go to the language first in order.
With nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.tables import freed, stage

SAMPLE_DOCS = 1_500
ROUNDS = 3
LONGEST_PIECE = 10
#: Longer letter runs are learned and scored in parts of this many characters.
LONGEST_WORD = 32
UNKNOWN_CHARACTER = 1e-7
MEMO_WORDS = 150_000
WORDS_AT_ONCE = 4_000
UNDETERMINED = "und"

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[97:123] = False
_NOT_LETTER[128:] = False
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Lower-case letter pieces of a sentencepiece vocabulary, found by hash of their code points."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = {model.id_to_piece(n) for n in range(model.get_piece_size()) if not model.is_byte(n) and not model.is_control(n)}
        ok = lambda p: len(p) <= LONGEST_PIECE and p == p.lower() and (p.lstrip("▁").isalpha() or p == "▁")
        self.texts = sorted(p for p in every if ok(p))
        self.n = len(self.texts)
        self.bits = int(np.ceil(np.log2(max(self.n, 1) * 8)))
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.probes = 1
        for value, text in enumerate(self.texts):
            key = self._keys(_codes([text]))[0]
            slot, step = int(key >> np.uint64(64 - self.bits)), 1
            while self.values[slot % size] >= 0:
                slot, step = slot + 1, step + 1
            self.keys[slot % size], self.values[slot % size] = key, value
            self.probes = max(self.probes, step)

    @staticmethod
    def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = W._power_table(LONGEST_WORD + 2)
        sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(W.mix(codes.astype(np.uint64) + _GOLD) * up[: codes.shape[1]], axis=1, out=sums[:, 1:])
        return sums, down

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        sums, _ = self._sums(codes)
        return W.mix(sums[:, -1] + np.uint64(codes.shape[1]))

    def grid(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece number of every part [i, j) of equally long words: ``n`` for a character that is no piece, ``n + 1`` for no piece at all."""
        sums, down = self._sums(codes)
        n, size = codes.shape[1], len(self.keys)
        found = {}
        for i in range(n):
            for j in range(i + 1, min(i + LONGEST_PIECE, n) + 1):
                key = W.mix((sums[:, j] - sums[:, i]) * down[i] + np.uint64(j - i))
                slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
                value = np.full(len(key), -1, np.int32)
                for step in range(self.probes):
                    at = (slot + step) % size
                    hit = self.keys[at] == key
                    value[hit] = self.values[at[hit]]
                if j == i + 1:
                    value[value < 0] = self.n
                if (value >= 0).any():
                    value[value < 0] = self.n + 1
                    found[i, j] = value
        return found


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of equally long texts."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points with a word-start mark) of texts of one length at a time."""
    length = np.array([len(t) for t in texts])
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        yield at, _codes(["▁" + texts[i] for i in at])


def forward(grid: dict, n: int, p: np.ndarray, rows: int) -> list[np.ndarray]:
    """Summed probability of all segmentations of every beginning; one column per language.

    ``p`` has a row per piece, one for a single character that is no piece, and a last row of zeros.
    """
    alpha = [np.ones((rows, p.shape[1])), *(np.zeros((rows, p.shape[1])) for _ in range(n))]
    for j in range(1, n + 1):
        for i in range(max(0, j - LONGEST_PIECE), j):
            if (i, j) in grid:
                alpha[j] += alpha[i] * p[grid[i, j]]
    return alpha


def expected_counts(grid: dict, n: int, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in weighted words, for one language."""
    rows = len(weight)
    alpha = forward(grid, n, p, rows)
    beta = [np.zeros((rows, 1)) for _ in range(n)] + [np.ones((rows, 1))]
    total = np.zeros(len(p))
    scale = weight / np.maximum(alpha[n][:, 0], 1e-300)
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, min(i + LONGEST_PIECE, n) + 1):
            if (i, j) in grid:
                step = p[grid[i, j]] * beta[j]
                total += np.bincount(grid[i, j], (alpha[i] * step)[:, 0] * scale, len(p) + 1)[: len(p)]
                beta[i] += step
    return total


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    path: str
    memo: dict[int, int] = field(default_factory=dict)
    known: list[np.ndarray] = field(default_factory=list)

    def word_scores(self, texts: list[str]) -> np.ndarray:
        """log probability of each word, one column per language."""
        out = np.zeros((len(texts), len(self.languages)))
        parts = [(i, t[k : k + LONGEST_WORD]) for i, t in enumerate(texts) for k in range(0, max(len(t), 1), LONGEST_WORD)]
        owner = np.array([i for i, _ in parts])
        for at, codes in by_length([t for _, t in parts]):
            for low in range(0, len(at), WORDS_AT_ONCE):
                some = codes[low : low + WORDS_AT_ONCE]
                n = some.shape[1]
                last = forward(pieces(self.path).grid(some), n, self.table, len(some))[n]
                np.add.at(out, owner[at[low : low + WORDS_AT_ONCE]], np.log(np.maximum(last, 1e-300)))
        return out

    def text_scores(self, words: W.Words) -> np.ndarray:
        """Summed log probability of each text of a slice, one column per language."""
        rows, width = words.rows, len(self.languages)
        if not len(words.start):
            return np.zeros((rows, width))
        keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
            self.known.clear()
        listed = keys.tolist()
        fresh = [n for n, k in enumerate(listed) if k not in self.memo]
        raw = words.raw.tobytes()
        spans = zip(words.start[first[fresh]].tolist(), words.end[first[fresh]].tolist(), strict=True)
        scores = self.word_scores([raw[a:b].decode("utf-8", "replace") for a, b in spans]) if fresh else np.zeros((0, width))
        base = len(self.memo)
        self.memo.update((listed[n], base + i) for i, n in enumerate(fresh))
        self.known.append(scores)
        if len(self.known) > 1:
            self.known[:] = [np.concatenate(self.known)]
        each = self.known[0][np.fromiter((self.memo[k] for k in listed), np.int64, len(listed))][inverse]
        doc = words.doc
        return np.column_stack([np.bincount(doc, each[:, c], rows) for c in range(width)])


def letter_words(texts: pa.Array) -> Iterator[tuple[int, int, W.Words]]:
    raw, at = W.text_buffers(pc.utf8_lower(texts))
    for low, high in W.slices(at):
        yield low, high, W.split(raw[at[low] : at[high]], at[low : high + 1] - at[low], gap=_NOT_LETTER)


def sampled_word_counts(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """lang, word, n over the documents of each language that come first by a hash of the id."""
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    drawn = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("doc_id", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            for low, _, words in letter_words(batch.column("text")):
                raw, doc = words.raw.tobytes(), words.doc + low
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
                parts = [(d, t[k : k + LONGEST_WORD]) for d, t in zip(doc.tolist(), texts, strict=True) for k in range(0, len(t), LONGEST_WORD)]
                at, texts = ([p[c] for p in parts] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(at, pa.int64())), pa.array(texts, pa.string())], ["lang", "word"])

    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("lang", "text")
    words = texts.mapInArrow(run, "lang string, word string")
    return words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, path: str | None = None, per_language: int = SAMPLE_DOCS) -> Model:
    path = path or default_path()
    counts = stage(sampled_word_counts(docs, per_language), "language-words")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    size = pieces(path).n
    table = np.zeros((size + 2, len(languages)))
    table[:size] = 1 / max(size, 1)
    table[size] = UNKNOWN_CHARACTER
    place = {lang: c for c, lang in enumerate(languages)}
    for _ in range(ROUNDS if languages else 0):
        current = table

        def expect(batches: Iterator[pa.RecordBatch], current: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 2, len(place)))
            for batch in batches:
                lang, words, n = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
                for name in set(lang):
                    at = [i for i, x in enumerate(lang) if x == name]
                    weight = np.array([n[i] for i in at], np.float64)
                    for rows, codes in by_length([words[i] for i in at]):
                        column = current[:, [place[name]]]
                        total[:, place[name]] += expected_counts(pieces(path).grid(codes), codes.shape[1], column, weight[rows])
            piece, column = np.nonzero(total[:size])
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(column), pa.array(total[piece, column])], ["piece", "language", "n"])

        got = counts.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros((size + 2, len(languages)))
        table[:size] = 0.01
        table[got.piece, got.language] += got.n
        table /= table.sum(axis=0)
        table[size] = UNKNOWN_CHARACTER
    return Model(languages, table, path)


def _predictions(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, predicted languages, scores)."""
    names = np.array([*model.languages, UNDETERMINED], object)
    for batch in batches:
        for low, high, words in letter_words(batch.column("text")):
            rows = batch.slice(low, high - low)
            if not model.languages:
                yield rows, np.full(len(rows), UNDETERMINED, object), np.zeros(len(rows))
                continue
            letters = pc.fill_null(pc.match_substring_regex(rows.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            total = model.text_scores(words)
            odds = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0))
            yield rows, names[np.where(letters, total.argmax(axis=1), len(model.languages))], np.where(letters, 1 / odds.sum(axis=1), 0.0)


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, ``lang_pred`` and ``score`` (its share of the summed probabilities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lang, score in _predictions(batches, model):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carry), pa.array(lang, pa.string()), pa.array(score)], [*carry, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "lang_pred string, score double"])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of documents whose language can be told, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lang, score in _predictions(batches, model):
            yield rows.filter(pa.array((lang != UNDETERMINED) & (score >= least_score)))

    return docs.mapInArrow(freed(run, pieces.cache_clear), docs.schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows kept from learning; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn_and_predict(docs: DataFrame, path: str | None = None) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn(plain.where(~held_out()), path)
    return predict(plain, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
