"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's parts sit in one array beside an array of adjacent merge ranks. The smallest rank is found
by a scan, its boundary deleted, and the two neighbouring ranks refreshed, until no merge is left.
Words of more than ``SHORT`` bytes, for which repeated scans would cost the square of the length, go
through a heap over linked parts with the same order of merges.

Results of words are kept in a bounded memo of two generations per worker process; the vocabulary's path is a parameter.
Null texts count as empty: no tokens, empty decoded text. Every row is encoded for itself.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern of byte-level BPE vocabularies of this kind.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SHORT = 128
MEMO_WORDS = 250_000
BITS = 24
MASK = (1 << BITS) - 1
NEVER = 1 << 62


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass
class Vocabulary:
    """Merges, byte values of ids, and strings that are taken whole before splitting.

    A merge of parts a and b is kept under ``a << BITS | b`` as ``rank << BITS | merged id``, so the
    smallest value is the smallest rank and names the merged part as well.
    """

    merges: dict[int, int]
    byte_ids: list[int]
    pieces: dict[str, bytes]
    whole: dict[str, int]
    young: dict[str, str] = field(default_factory=dict)
    old: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        filesystem, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        with filesystem.open_input_stream(name) as stream:
            spec = json.loads(stream.read())
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        values = {c: b for b, c in letters.items()}
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges[ids[left] << BITS | ids[right]] = rank << BITS | ids[left + right]
        whole = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        pieces = {str(n): bytes(values[c] for c in text) for text, n in ids.items() if text not in whole}
        pieces |= {str(n): text.encode() for text, n in whole.items()}
        return cls(merges, [ids[letters[b]] for b in range(256)], pieces, whole)

    def word_ids(self, word: bytes) -> list[int]:
        parts = [self.byte_ids[b] for b in word]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << BITS | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            parts[i] = low & MASK
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << BITS | parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] << BITS | parts[i], NEVER)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (m := get(a << BITS | b))]
        heapq.heapify(heap)
        while heap:
            merge, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = merge & MASK, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (m := get(parts[left] << BITS | parts[right])):
                    heapq.heappush(heap, (m, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def _miss(self, word: str) -> str:
        got = self.old.get(word)
        if got is None:
            got = ",".join(map(str, [self.whole[word]] if word in self.whole else self.word_ids(word.encode())))
        if len(word) <= SHORT:
            if len(self.young) >= MEMO_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def words(self, text: str) -> list[str]:
        """Whole added strings, and between them the pre-tokenizer's words."""
        if not any(t in text for t in self.whole):
            return _split(text)
        cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.whole, key=len, reverse=True)) + ")")
        return [w for part in cut.split(text) for w in ([part] if part in self.whole else _split(part))]

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by commas."""
        memo, miss = self.young, self._miss
        out = [memo.get(w) or miss(w) for w in self.words(text)]
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(n) for n in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> str:
        pieces = self.pieces
        raw = b"".join([pieces[n] for n in joined.split(",")]) if joined else b""
        return raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


_split = regex.compile(PATTERN).findall
_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process and path."""
    if path not in _loaded:
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``ids array<int>`` of every text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for rows in _portions(batch, text):
                ids = [own.encode(t or "") for t in rows.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carry), pa.array(ids, pa.list_(pa.int32()))], [*carry, "ids"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "ids array<int>"])
    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the decoded ``text`` of every ``ids``; null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(texts, pa.string())], [*carry, "text"])

    kinds = dict(encoded.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "text string"])
    return encoded.select(*dict.fromkeys([*carry, "ids"])).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text and keep counts and digests only, in one pass."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for rows in _portions(batch, "text"):
                out: tuple[list, list, list] = ([], [], [])
                for text in rows.column("text").to_pylist():
                    joined = own.encode_joined(text or "")
                    out[0].append(joined.count(",") + 1 if joined else 0)
                    out[1].append(sha256(joined.encode()).hexdigest())
                    out[2].append(sha256(own.decode_joined(joined).encode()).hexdigest())
                columns = [rows.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _portions(batch: pa.RecordBatch, text: str, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time become Python strings."""
    for low in range(0, len(batch), rows):
        yield batch.slice(low, rows)
