"""Gated recurrent language model in numpy, with a class-factored output softmax.

Words of all training documents are counted. The ``SYMBOLS`` most frequent are symbols of the network;
every other word belongs to one of ``RARE`` symbols by its ending, and its probability given that symbol
follows its count. The output is factored: a softmax over classes, then one over the class's symbols, so
the probabilities of all words sum to one. Output biases start from the counts.

Training is truncated backpropagation through ``WINDOW`` steps with the state carried on between windows
and reset at document starts. A start on ``WARM_DOCS`` documents (bounded) is followed by a pass over all
training documents: each task trains on its own rows, and the tasks' parameters are averaged by tokens, in
pieces, on the cluster. Scoring carries the state through each whole document, many documents at a time.

Words are compared by 64-bit hashes. Counts of the ``HEAD`` most frequent words are sent to the tasks;
occurrences of rarer ones are joined with the whole table of counts.

A null text counts as empty: its only token is the end. A row without doc_id is held out. Every row is
scored for itself, also if repeated. Without training documents the model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.tables import stage

SYMBOLS = 4_096
RARE = 64
CLASSES = 64
HEAD = 131_072
EMBED, HIDDEN = 16, 24
STREAMS, WINDOW = 512, 16
WARM_DOCS, WARM_PASSES = 800, 3
WARM_RATE, RATE = 0.01, 0.003
PIECE = 4_096
#: Rows scored together, and outputs kept before they are reduced to probabilities.
ROWS = 4_096
OUTPUTS = 32_768
#: Rows whose class outputs are worked on together: they stay in a core's cache.
BLOCK = 2_048
END = np.uint64(0x0123456789ABCDEF)
ADDED = 0.1


def endings(words: W.Words, at: np.ndarray | None = None) -> np.ndarray:
    """Rare-word symbol of each word: a number from its last two bytes."""
    end, start = (words.end, words.start) if at is None else (words.end[at], words.start[at])
    last = words.raw[end - 1].astype(np.int64)
    before = np.where(end - start > 1, words.raw[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before) % RARE


def with_ends(values: np.ndarray, first: np.ndarray, end: int | np.uint64) -> np.ndarray:
    """Word values of consecutive texts with an end value after each text."""
    return np.insert(values, first[1:], end) if len(first) > 1 else values


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and each one's number among them, by a hash table instead of a sort."""
    coded = W.signed(hashes).dictionary_encode()
    return coded.dictionary.to_numpy().view(np.uint64), coded.indices.to_numpy()


def word_counts(docs: DataFrame) -> DataFrame:
    """h (word hash), n and ending of all words and ends of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds = [np.full(len(batch), END)], [np.zeros(len(batch), np.int64)]
            for _, _, words in W.word_slices(batch.column("text"), lower=True):
                keys.append(words.hashes())
                kinds.append(endings(words))
            key, code = distinct(np.concatenate(keys))
            kind = np.empty(len(key), np.int32)
            kind[code] = np.concatenate(kinds)
            columns = [W.signed(key), pa.array(np.bincount(code, minlength=len(key))), pa.array(kind)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "n", "ending"])

    found = docs.select("text").mapInArrow(run, "h long, n long, ending int")
    return found.groupBy("h").agg(F.sum("n").alias("n"), F.max("ending").alias("ending"))


@dataclass
class Lexicon:
    """What tasks need of the counts: frequent words by hash, their symbols, and sums for rare ones."""

    keys: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    end_symbol: int
    class_start: np.ndarray
    symbol_counts: np.ndarray
    rare_mass: np.ndarray
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return int(self.class_start[-1])

    @property
    def rare_from(self) -> int:
        return self.size - RARE

    def look_up(self, hashes: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count of each word; count -1 if it has to be joined."""
        own, code = distinct(hashes)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        hit = self.keys[at] == own
        symbol = np.where(hit, self.symbols[at], -1).astype(np.int32)[code]
        symbol = np.where(symbol < 0, self.rare_from + ending, symbol)
        return symbol.astype(np.int32), np.where(hit, self.counts[at], -1)[code]


def lexicon(counts: DataFrame) -> Lexicon:
    """From staged word counts; ties in frequency go by hash."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    head = counts.orderBy(F.desc("n"), "h").limit(HEAD).toPandas()
    keys = head["h"].to_numpy(np.int64).view(np.uint64)
    n = head["n"].to_numpy(np.int64)
    if END not in keys:
        keys, n = np.append(END, keys), np.append(0, n)
    frequent = np.arange(len(keys)) < SYMBOLS
    frequent[keys == END] = True
    ranked = np.flatnonzero(frequent)
    weight = np.sqrt(n[ranked] + 1.0)
    group = np.minimum((np.cumsum(weight) - weight) / weight.sum() * CLASSES, CLASSES - 1).astype(np.int64)
    _, group = np.unique(group, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(np.bincount(group)), [len(ranked) + RARE]])
    symbols = np.full(len(keys), -1, np.int64)
    symbols[ranked] = np.arange(len(ranked))
    rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame(pd.DataFrame({"h": keys[ranked].view(np.int64)}))), "h", "left_anti")
    sums = rare.groupBy("ending").agg(F.sum(F.col("n") + ADDED).alias("mass"), F.sum("n").alias("n")).toPandas()
    mass, seen = np.zeros(RARE), np.zeros(RARE)
    mass[sums["ending"]], seen[sums["ending"]] = sums["mass"], sums["n"]
    order = np.argsort(keys)
    return Lexicon(
        keys[order], n[order], symbols[order], int(symbols[keys == END][0]), start,
        np.concatenate([n[ranked], seen]), mass + ADDED, int(total[0] or 0), int(total[1]),
    )


Parameters = dict[str, np.ndarray]


def shapes(lex: Lexicon) -> dict[str, tuple[int, ...]]:
    classes = len(lex.class_start) - 1
    return {
        "embed": (lex.size, EMBED), "input": (EMBED, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "gate": (3 * HIDDEN,), "inner": (HIDDEN,),
        "classes": (classes, HIDDEN), "class_bias": (classes,), "out": (lex.size, HIDDEN), "out_bias": (lex.size,),
    }


def initial(lex: Lexicon) -> Parameters:
    draw = np.random.default_rng(5)
    p = {k: (draw.standard_normal(s) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for k, s in shapes(lex).items()}
    p["input"] *= 3
    p["state"] *= 2
    p["classes"] *= 0.1
    p["out"] *= 0.1
    n = lex.symbol_counts + 0.5
    per_class = np.add.reduceat(n, lex.class_start[:-1])
    p["class_bias"] = np.log(per_class / per_class.sum()).astype(np.float32)
    p["out_bias"] = np.log(n / np.repeat(per_class, np.diff(lex.class_start))).astype(np.float32)
    return p


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(values: np.ndarray, lex: Lexicon) -> Parameters:
    out, at = {}, 0
    for k, shape in sorted(shapes(lex).items()):
        size = int(np.prod(shape))
        out[k] = values[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(h: np.ndarray, table: np.ndarray, symbol: np.ndarray, p: Parameters) -> tuple[np.ndarray, ...]:
    """One step of the network: new state, and what its derivative needs."""
    x = table.take(symbol, axis=0)
    u = h @ p["state"]
    gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    keep, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
    inner = u[:, 2 * HIDDEN :] + p["inner"]
    new = reset * inner
    new += x[:, 2 * HIDDEN :]
    np.tanh(new, out=new)
    state = h - new
    state *= keep
    state += new
    return state, keep, reset, inner, new


def input_table(p: Parameters) -> np.ndarray:
    return p["embed"] @ p["input"] + p["gate"]


def _stable_order(values: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of small non-negative integers; numpy sorts 16 bits by radix."""
    return np.argsort(values.astype(np.uint16) if bound <= 1 << 16 else values, kind="stable")


def _exp(x: np.ndarray, at: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """``x`` becomes its exponentials; returns the values at the places ``at`` of its flat form, and the rows' sums.

    ``wide`` says that values may leave the range of exp.
    """
    if wide and x.size:
        x -= x.max(axis=1, keepdims=True)
    chosen = x.ravel().take(at)
    np.exp(x, out=x)
    return chosen, x @ np.ones(x.shape[1], x.dtype)


def _with_bias(weight: np.ndarray, bias: np.ndarray, most: float) -> tuple[np.ndarray, bool]:
    """Weights with the bias as a last row, and whether outputs can exceed 60 for inputs of at most ``most``."""
    both = np.empty((weight.shape[1] + 1, len(weight)), weight.dtype)
    both[:-1], both[-1] = weight.T, bias
    return both, bool((np.abs(weight).sum(axis=1) * most + np.abs(bias)).max(initial=0) > 60)


def log_probabilities(h: np.ndarray, target: np.ndarray, p: Parameters, lex: Lexicon, grad: Parameters | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target symbol; with ``grad``, adds gradients of the mean loss and returns that of h.

    Rows are brought into the order of their targets' classes once, so each class works on neighbouring rows.
    A last column of ones carries the biases through the same products. Exponentials are not divided by their
    sums: what is multiplied with them, or comes of it, is narrower.
    """
    sizes = np.diff(lex.class_start)
    group = np.repeat(np.arange(len(sizes)), sizes).take(target)
    order = _stable_order(group, len(lex.class_start))
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(sizes)))]).tolist()
    target, group, learning, n = target.take(order), group.take(order), grad is not None, len(target)
    most = float(np.abs(h).max(initial=0))
    rows = np.ones((n, h.shape[1] + 1), h.dtype)
    rows[:, :-1] = h.take(order, axis=0)
    h, number = rows, np.arange(n)
    weight, wide = _with_bias(p["classes"], p["class_bias"], most)
    out, total = np.empty(n), np.empty(n, h.dtype)
    back, within = (np.empty((n, h.shape[1] - 1), h.dtype) for _ in range(2)) if learning else (None, None)
    for low in range(0, n, BLOCK):
        cut = slice(low, low + BLOCK)
        d = h[cut] @ weight
        at = number[: len(d)] * len(sizes) + group[cut]
        out[cut], total[cut] = _exp(d, at, wide)
        if learning:
            d.ravel()[at] -= total[cut]
            np.matmul(d, p["classes"], out=back[cut])
            slope = d.T @ (h[cut] / total[cut, None])
            slope /= n
            grad["classes"] += slope[:, :-1]
            grad["class_bias"] += slope[:, -1]
    out -= np.log(total)
    if learning:
        back /= total[:, None]
    weight, wide = _with_bias(p["out"], p["out_bias"], most)
    starts = lex.class_start.tolist()
    target -= lex.class_start.take(group)
    at = number * sizes.take(group) + target
    for c, (low, high) in enumerate(zip(starts, starts[1:], strict=False)):
        first, end = ends[c], ends[c + 1]
        if first == end:
            continue
        d = h[first:end] @ weight[:, low:high]
        place = at[first:end] - first * (high - low)
        chosen, total[first:end] = _exp(d, place, wide)
        out[first:end] += chosen
        if learning:
            d.ravel()[place] -= total[first:end]
            np.matmul(d, p["out"][low:high], out=within[first:end])
            slope = d.T @ (h[first:end] / total[first:end, None])
            slope /= n
            grad["out"][low:high] += slope[:, :-1]
            grad["out_bias"][low:high] += slope[:, -1]
    out -= np.log(total)
    logs = np.empty_like(out)
    logs[order] = out
    if learning:
        within /= total[:, None]
        within += back
        within /= n
        back[order] = within
    return logs, back


def window_gradient(p: Parameters, lex: Lexicon, h: np.ndarray, given: np.ndarray, target: np.ndarray, fresh: np.ndarray) -> tuple[float, Parameters, np.ndarray]:
    """Loss, gradients and last state of one window; inputs are (streams, steps).

    ``fresh`` marks first tokens of documents, before which the state is zero.
    """
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    table = input_table(p)
    streams, steps = given.shape
    begun = [np.flatnonzero(f) for f in fresh.T]
    before, keep, reset, inner, new, states = np.empty((6, steps, streams, HIDDEN), h.dtype)
    for t in range(steps):
        before[t] = h
        before[t, begun[t]] = 0
        states[t], keep[t], reset[t], inner[t], new[t] = step(before[t], table, given[:, t], p)
        h = states[t]
    logs, back = log_probabilities(states.reshape(-1, HIDDEN), target.T.ravel(), p, lex, grad)
    back = back.reshape(steps, streams, HIDDEN)
    # derivatives inside a step, for all steps at once
    other = 1 - keep
    by_keep = before - new
    by_keep *= keep
    by_keep *= other
    by_new = 1 - new * new
    by_new *= other
    by_reset = 1 - reset
    by_reset *= reset
    by_reset *= inner
    d_state = np.empty((steps, streams, 3 * HIDDEN), h.dtype)
    d_new = np.empty_like(new)
    carry, to_state = np.zeros_like(h), np.ascontiguousarray(p["state"].T)
    for t in range(steps - 1, -1, -1):
        d = back[t]
        d += carry
        np.multiply(d, by_new[t], out=d_new[t])
        du = d_state[t]
        np.multiply(d, by_keep[t], out=du[:, :HIDDEN])
        np.multiply(d_new[t], by_reset[t], out=du[:, HIDDEN : 2 * HIDDEN])
        np.multiply(d_new[t], reset[t], out=du[:, 2 * HIDDEN :])
        carry = du @ to_state
        d *= keep[t]
        carry += d
        carry[begun[t]] = 0
    inputs, symbol = d_state.reshape(-1, 3 * HIDDEN), given.T.ravel()
    every = np.ones(len(inputs), h.dtype)
    grad["inner"] = (every @ inputs)[2 * HIDDEN :]
    grad["state"] = before.reshape(-1, HIDDEN).T @ inputs
    inputs[:, 2 * HIDDEN :] = d_new.reshape(-1, HIDDEN)
    grad["input"] = p["embed"].take(symbol, axis=0).T @ inputs
    grad["gate"] = every @ inputs
    order = _stable_order(symbol, lex.size)
    symbol = symbol.take(order)
    first = np.flatnonzero(np.diff(symbol, prepend=-1))
    grad["embed"][symbol[first]] = np.add.reduceat((inputs @ p["input"].T).take(order, axis=0), first, axis=0)
    return float(-logs.mean()), grad, h


class Trainer:
    """Adam over windows of parallel streams."""

    def __init__(self, p: Parameters, lex: Lexicon, rate: float) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.lex, self.rate, self.steps, self.tokens = lex, rate, 0, 0
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}

    def learn(self, symbols: np.ndarray, streams: int = STREAMS) -> float:
        """One pass over consecutive documents, each closed by the end symbol. Returns the mean loss."""
        n = len(symbols)
        streams = max(1, min(streams, n // WINDOW))
        length = -(-n // streams)
        padded = np.append(symbols, np.full(streams * length - n, self.lex.end_symbol, symbols.dtype))
        target = padded.reshape(streams, length)
        given = np.empty_like(target)
        given[:, 1:] = target[:, :-1]
        given[:, 0] = self.lex.end_symbol
        fresh = given == self.lex.end_symbol
        h, losses = np.zeros((streams, HIDDEN), np.float32), []
        for low in range(0, length, WINDOW):
            cut = slice(low, low + WINDOW)
            loss, grad, h = window_gradient(self.p, self.lex, h, given[:, cut], target[:, cut], fresh[:, cut])
            self._update(grad)
            losses.append(loss)
        self.tokens += n
        return float(np.mean(losses)) if losses else 0.0

    def _update(self, grad: Parameters) -> None:
        self.steps += 1
        size = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        shrink = min(1.0, 1.0 / max(size, 1e-9))
        scale = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in grad.items():
            first, second = self.first[k], self.second[k]
            first *= 0.9
            first += g * g.dtype.type(0.1 * shrink)
            g *= g
            g *= 0.001 * shrink * shrink
            second *= 0.999
            second += g
            np.sqrt(second, out=g)
            g += 1e-8
            np.divide(first, g, out=g)
            g *= scale
            self.p[k] -= g


def batch_tokens(texts: pa.Array, lex: Lexicon) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and, with ends, (hash, symbol, count, first token of each text) for slices of a text column."""
    for low, high, words in W.word_slices(texts, lower=True):
        hashes = words.hashes()
        symbol, count = lex.look_up(hashes, endings(words))
        end_count = lex.counts[np.searchsorted(lex.keys, END)]
        first = words.first + np.arange(len(words.first))
        yield (
            low, high, with_ends(hashes, words.first, END), with_ends(symbol, words.first, lex.end_symbol),
            with_ends(count, words.first, end_count), first,
        )


def train(docs: DataFrame, lex: Lexicon) -> Parameters:
    """Parameters learned from all given documents."""
    first = docs.where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCS).select("text").toArrow()
    warm = Trainer(initial(lex), lex, WARM_RATE)
    tokens = [x[3] for x in batch_tokens(first.column("text").combine_chunks(), lex)] if len(first) else []
    for _ in range(WARM_PASSES if tokens else 0):
        warm.learn(np.concatenate(tokens), 128)
    begun = flat(warm.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trainer(unflat(begun, lex), lex, RATE)
        for batch in batches:
            parts = [x[3] for x in batch_tokens(batch.column("text"), lex)]
            if parts:
                own.learn(np.concatenate(parts))
        if own.tokens:
            moved = (flat(own.p) - begun).astype(np.float64) * own.tokens
            pieces = [moved[i : i + PIECE] for i in range(0, len(moved), PIECE)]
            salt = int(own.tokens % 64)
            columns = [pa.array(range(len(pieces)), pa.int32()), pa.array([salt] * len(pieces), pa.int32()), pa.array([own.tokens] * len(pieces), pa.int64()), pa.array(pieces, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "salt", "tokens", "moved"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(group["moved"].to_numpy()), axis=0)
        return pd.DataFrame({"piece": [group["piece"].iloc[0]], "tokens": [group["tokens"].sum()], "moved": [total]})

    out = "piece int, tokens long, moved array<double>"
    parts = docs.select("text").mapInArrow(run, "piece int, salt int, tokens long, moved array<double>")
    summed = parts.groupBy("piece", "salt").applyInPandas(add, out).groupBy("piece").applyInPandas(add, out).toPandas()
    if not len(summed):
        return unflat(begun, lex)
    summed = summed.sort_values("piece")
    return unflat(begun + np.concatenate(summed["moved"].to_list()) / summed["tokens"].iloc[0], lex)


def score_documents(symbols: np.ndarray, first: np.ndarray, p: Parameters, lex: Lexicon) -> np.ndarray:
    """Natural log probability of each document's symbols, the end included."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    rows, start = len(order), first[:-1][order]
    total = np.zeros(rows)
    table = input_table(p)
    h = np.zeros((rows, HIDDEN), np.float32)
    given = np.full(rows, lex.end_symbol)
    active = rows - np.searchsorted(length[order][::-1], np.arange(int(length.max(initial=0))), "right")
    states, targets, held = [], [], 0
    for t, n in enumerate(active.tolist()):
        h = step(h[:n], table, given[:n], p)[0]
        given = symbols[start[:n] + t]
        states.append(h)
        targets.append(given)
        held += n
        if held >= OUTPUTS or t == len(active) - 1:
            logs, _ = log_probabilities(np.concatenate(states), np.concatenate(targets), p, lex)
            row = np.concatenate([np.arange(len(x)) for x in targets])
            total += np.bincount(row, logs, rows)
            states, targets, held = [], [], 0
    out = np.zeros(rows)
    out[order] = total
    return out


def score(docs: DataFrame, p: Parameters, lex: Lexicon, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    values = flat(p)
    rare_log = np.log10(lex.rare_mass)
    names = ["row", "doc_id", "n_tokens", "known", "base", "score", "h", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unflat(values, lex)
        for whole in batches:
            for low in range(0, len(whole), ROWS):
                yield from scored(whole.slice(low, ROWS), own)

    def scored(batch: pa.RecordBatch, own: Parameters) -> Iterator[pa.RecordBatch]:
        slices = list(batch_tokens(batch.column("text"), lex))
        hashes, symbol, count = (np.concatenate([x[i] for x in slices]) for i in (2, 3, 4))
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[5]) for x in slices]))])
        n = len(batch)
        doc = np.repeat(np.arange(n), np.diff(first))
        logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + ADDED), 0.0)
        rare = np.flatnonzero(symbol >= lex.rare_from)
        model = score_documents(symbol, first, own, lex) / np.log(10)
        model += np.bincount(doc[rare], logs[rare] - rare_log[symbol[rare] - lex.rare_from], n)
        known = np.bincount(doc[count > 0], minlength=n)
        columns = [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(first)), pa.array(known), pa.array(np.bincount(doc, logs, n)), pa.array(model)]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        late = np.flatnonzero(count < 0)
        pair = W.mix(hashes[late] + W.mix(doc[late].astype(np.uint64)))
        _, at, times = np.unique(pair, return_index=True, return_counts=True)
        at, n = late[at], len(at)
        columns = [batch.column("row").take(pa.array(doc[at])), *(pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*columns, W.signed(hashes[at]), pa.array(times)], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, n_tokens long, known long, base double, score double, h long, times long"
    found = stage(numbered.mapInArrow(run, schema), "lm-scores")
    late = found.where("h is not null").select("row", "h", "times").join(counts.select("h", "n"), "h", "left")
    sums = late.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADDED)).alias("late"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("late_known"),
    )
    each = np.log10(lex.tokens + ADDED * (lex.distinct + 1))
    added = lambda column, late: F.col(column) + F.coalesce(late, F.lit(0))
    return found.where("h is null").join(sums, "row", "left").select(
        "doc_id", "n_tokens", added("known", "late_known").alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (added("base", "late") - F.col("n_tokens") * float(each)).alias("base_score"), added("score", "late").alias("score"),
    )


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def learn_and_score(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = plain.where(~held_out())
    counts = stage(word_counts(own), "lm-counts")
    lex = lexicon(counts)
    scores = score(plain, train(own, lex), lex, counts)
    return scores.withColumn("held_out", held_out())
