"""Document log-likelihood by a gated recurrent language model in numpy.

Words are counted over all documents, and the counts stay a table of the cluster.  The output softmax is factored by class,
P(word) = P(class | state) P(word | class, state).  The most frequent words have places in classes, ``side`` classes of
``side`` words, where ``side`` follows the cube root of the number of words seen twice, up to ``MOST_CLASSES``; they alone
travel to the tasks.  All other words fall by their hash into ``TAILS`` tails, which are classes of the first layer
and inputs like words, so every task knows every word's symbol without a look-up.  A tail's words share it by their counts,
P(word | tail) = count / mass, which is joined to the words of the documents; words seen once share what these have of the tail by
their spelling under a byte bigram model, whose counts also come from all documents.  So every text has a
proper probability, and it follows the whole corpus however large the vocabulary.

Training is truncated backpropagation through time over the whole corpus, once, every token a target: the documents
are split by hash into rounds, more of them for more tokens; in a round every task starts from the current weights,
trains on its share in streams whose state is carried from window to window, and the tasks' weights are averaged by tokens
they saw.  A stream may begin inside a document, with a state of zero.  Weights are summed in pieces after a shuffle, so
the driver receives one model whatever the number of tasks.  Scoring carries the state through each document from its
first word to its end mark; no text is cut.

Defined cases: a null text has a null log-likelihood and no words; a text without words has the
log-likelihood of the end mark; null ids are kept; repeated rows are scored each; on an empty table the
model is the initial one.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import documents_only, lean, written
from docquarry.llm.tokens import WORD_BYTE, Words, slices

#: Classes, and words of a class, at least and at most; between, the cube root of the words seen twice.  At the most, the
#: frequent words and the model are 1.5 MB together.
CLASSES, MOST_CLASSES = 32, 64
TAILS = 32
HIDDEN = 16
#: Rounds at least, and the tokens from which each doubling takes one more: with more tasks weights are averaged more often.
ROUNDS, ROUND_TOKENS = 3, 1 << 24
STEPS = 16
STREAMS = 512
CHUNK_TOKENS = STEPS * STREAMS * 48
RATE = 0.01
PIECE = 2048
#: Symbol 0 is the mark between documents; the most frequent words follow.
END, FIRST = 0, 1
SCORE_BYTES = 12 << 20


@dataclass
class Gru:
    """Input weights by symbol, recurrent weights, and the two softmax layers.

    Symbols are the words of the classes, then the tails, which are classes of the first layer alone.
    """

    inputs: np.ndarray
    recurrent: np.ndarray
    class_weight: np.ndarray
    class_bias: np.ndarray
    word_weight: np.ndarray
    word_bias: np.ndarray

    @staticmethod
    def initial(classes: int = CLASSES, size: int = CLASSES, hidden: int = HIDDEN, tails: int = 0, seed: int = 11) -> Gru:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return Gru(
            draw(classes * size + tails, 3 * hidden), draw(hidden, 3 * hidden), draw(hidden, classes + tails), np.zeros(classes + tails, np.float32),
            draw(classes, hidden, size), np.zeros((classes, size), np.float32),
        )

    @property
    def shape(self) -> tuple[int, int, int, int]:
        """Classes, words of a class, hidden units, tails."""
        return self.word_weight.shape[0], self.word_weight.shape[2], self.recurrent.shape[0], len(self.class_bias) - self.word_weight.shape[0]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).reshape(-1) for f in fields(self)])

    @staticmethod
    def of(values: np.ndarray, classes: int = CLASSES, size: int = CLASSES, hidden: int = HIDDEN, tails: int = 0) -> Gru:
        """Views of one vector, in the order of the fields."""
        kinds = classes + tails
        shapes = ((classes * size + tails, 3 * hidden), (hidden, 3 * hidden), (hidden, kinds), (kinds,), (classes, hidden, size), (classes, size))
        values, at, parts = values.astype(np.float32, copy=False), 0, []
        for shape in shapes:
            n = int(np.prod(shape))
            parts.append(values[at : at + n].reshape(shape))
            at += n
        return Gru(*parts)

    def step(self, word: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and what the backward step needs."""
        n = h.shape[1]
        x, u = self.inputs.take(word, axis=0), h @ self.recurrent
        gate = x[:, : 2 * n] + u[:, : 2 * n]
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += 1.0
        np.divide(1.0, gate, out=gate)
        z, r = gate[:, :n], gate[:, n:]
        new = r * u[:, 2 * n :]
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        after = h - new
        after *= z
        after += new
        return after, z, r, new, u[:, 2 * n :]

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target) given the states, row by row."""
        kind, order, word, edge = _by_class(target, *self.shape)
        logits = h @ self.class_weight
        logits += self.class_bias
        out = logits[np.arange(len(h)), kind] - np.log(_exp(logits) @ np.ones(len(self.class_bias), np.float32))
        mine = h.take(order, axis=0)
        logits = np.empty((len(mine), self.shape[1]), np.float32)
        for c in np.flatnonzero(np.diff(edge)):
            s = slice(edge[c], edge[c + 1])
            np.matmul(mine[s], self.word_weight[c], out=logits[s])
            logits[s] += self.word_bias[c]
        inner = logits[np.arange(len(mine)), word]
        out[order] += inner - np.log(_exp(logits) @ np.ones(self.shape[1], np.float32))
        return out


def _exp(logits: np.ndarray) -> np.ndarray:
    """In place; the states are within one, so that only wild weights would need the limit."""
    np.minimum(logits, 80.0, out=logits)
    return np.exp(logits, out=logits)


def _by_class(symbol: np.ndarray, classes: int, size: int, hidden: int, tails: int) -> tuple[np.ndarray, ...]:
    """Class or tail of each symbol; positions of words of classes in order of these, their places there, and the classes' edges.

    A symbol below zero is none and has the kind after the last.
    """
    words = classes * size
    kind = np.where(symbol < words, symbol // size, symbol - (words - classes))
    kind[symbol < 0] = classes + tails
    order = np.argsort(_narrow(kind, classes + tails + 1), kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=classes + tails + 1)[:classes])])
    order = order[: edge[-1]]
    return kind, order, symbol[order] % size, edge


def _narrow(values: np.ndarray, below: int) -> np.ndarray:
    """In few bytes, which sort fast."""
    return values.astype(np.uint8 if below <= 1 << 8 else np.uint16 if below <= 1 << 16 else np.int32)


def window_gradient(model: Gru, words: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[float, Gru, np.ndarray]:
    """Loss summed over a window, its gradient, and the state after it.

    ``words``, ``targets`` and ``fresh`` are steps x streams; ``fresh`` marks a document's first step, where
    the state is zero; a target below zero counts for nothing.
    """
    steps, streams = words.shape
    classes, size, hidden, tails = model.shape
    kind_of = model.recurrent.dtype
    live = (~fresh).astype(kind_of)[:, :, None]
    before, states, z, r, new, u = (np.empty((steps, streams, hidden), kind_of) for _ in range(6))
    for t in range(steps):
        np.multiply(h, live[t], out=before[t])
        h, z[t], r[t], new[t], u[t] = model.step(words[t], before[t])
        states[t] = h
    flat, rows = states.reshape(-1, hidden), np.flatnonzero(targets.reshape(-1) >= 0)
    kind, order, word, edge = _by_class(targets.reshape(-1), *model.shape)
    p = flat @ model.class_weight
    p += model.class_bias
    _exp(p)
    p /= (p @ np.ones(classes + tails, kind_of))[:, None]
    if len(rows) < steps * streams:
        p[targets.reshape(-1) < 0] = 0
    kind = kind[rows]
    loss = -float(np.log(p[rows, kind] + 1e-30).sum())
    p[rows, kind] -= 1
    d_state, d_class, d_class_bias = p @ model.class_weight.T, flat.T @ p, np.ones(len(p), kind_of) @ p

    # Tokens in order of their class: a class is a slice, and what is not a product is done for all at once.
    mine, rows = flat.take(order, axis=0), np.arange(len(order))
    used = np.flatnonzero(np.diff(edge))
    parts = [slice(edge[c], edge[c + 1]) for c in used]
    q = np.empty((len(mine), size), kind_of)
    for c, s in zip(used, parts, strict=True):
        np.matmul(mine[s], model.word_weight[c], out=q[s])
        q[s] += model.word_bias[c]
    _exp(q)
    q /= (q @ np.ones(size, kind_of))[:, None]
    loss -= float(np.log(q[rows, word] + 1e-30).sum())
    q[rows, word] -= 1
    d_word, d_word_bias = np.zeros_like(model.word_weight), np.zeros_like(model.word_bias)
    back = np.empty_like(mine)
    for c, s in zip(used, parts, strict=True):
        np.matmul(mine[s].T, q[s], out=d_word[c])
        np.matmul(q[s], model.word_weight[c].T, out=back[s])
    if len(used):
        d_word_bias[used] = np.add.reduceat(q, edge[used], axis=0)
    d_state[order] += back
    d_state = d_state.reshape(steps, streams, hidden)

    rest = 1 - z
    slope_z = before - new
    slope_z *= z
    slope_z *= rest
    slope_new = new * new
    np.subtract(1, slope_new, out=slope_new)
    slope_new *= rest
    slope_r = u
    slope_r *= r
    np.subtract(1, r, out=rest)
    slope_r *= rest
    d_input = np.empty((steps, streams, 3 * hidden), kind_of)
    d_u = np.empty((steps, streams, 3 * hidden), kind_of)
    d_h, turned = np.zeros((streams, hidden), kind_of), np.ascontiguousarray(model.recurrent.T)
    for t in range(steps - 1, -1, -1):
        d_h = d_h + d_state[t]
        d_new = d_h * slope_new[t]
        d_u[t, :, :hidden] = d_h * slope_z[t]
        d_u[t, :, hidden : 2 * hidden] = d_new * slope_r[t]
        d_u[t, :, 2 * hidden :] = d_new * r[t]
        d_input[t, :, 2 * hidden :] = d_new
        d_h = (d_h * z[t] + d_u[t] @ turned) * live[t]
    d_input[:, :, : 2 * hidden] = d_u[:, :, : 2 * hidden]
    d_recurrent = before.reshape(-1, hidden).T @ d_u.reshape(-1, 3 * hidden)
    d_inputs = np.zeros_like(model.inputs)
    seen = words.reshape(-1)
    order = np.argsort(_narrow(seen, len(model.inputs)), kind="stable")
    sorted_seen = seen[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_seen[1:] != sorted_seen[:-1]]))
    d_inputs[sorted_seen[first]] = np.add.reduceat(d_input.reshape(-1, 3 * hidden).take(order, axis=0), first, axis=0)
    return loss, Gru(d_inputs, d_recurrent, d_class, d_class_bias, d_word, d_word_bias), h


class Trainer:
    """Adam over windows of streams; chunks of ids are cut into streams that carry their state."""

    def __init__(self, model: Gru, rate: float = RATE):
        self.shape, self.rate, self.updates, self.tokens, self.loss = model.shape, rate, 0, 0, 0.0
        self.values = model.flat()
        self.first, self.second = np.zeros_like(self.values), np.zeros_like(self.values)

    def train(self, ids: np.ndarray) -> None:
        """``ids``: documents one after another, each with END before and behind it."""
        n = len(ids) - 1
        if n < 1:
            return
        streams = int(min(STREAMS, max(1, n // (4 * STEPS))))
        length = -(-n // streams)
        short = length * streams - n  # the last stream's steps without a target
        words = np.concatenate([ids[:-1], np.zeros(short, ids.dtype)]).reshape(streams, length).T
        targets = np.concatenate([ids[1:], np.full(short, -1, ids.dtype)]).reshape(streams, length).T
        h = np.zeros((streams, self.shape[2]), np.float32)
        for at in range(0, length, STEPS):
            x, y = words[at : at + STEPS], targets[at : at + STEPS]
            seen = int((y >= 0).sum())
            model = Gru.of(self.values, *self.shape)
            loss, slope, h = window_gradient(model, x, y, x == END, h)
            g = slope.flat()
            g /= seen
            norm = float(np.sqrt(np.dot(g, g)))
            if norm > 1:
                g /= norm
            self.updates += 1
            self.tokens += seen
            self.loss += loss
            change = g - self.first
            change *= 0.1
            self.first += change
            np.multiply(g, g, out=g)
            g -= self.second
            g *= 0.01
            self.second += g
            scale = self.rate * np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates)
            root = np.sqrt(self.second)
            root += 1e-7
            change = scale * self.first
            change /= root
            self.values = self.values - change.astype(np.float32)


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words' hashes in order with their symbols, log probabilities of byte pairs (index 256: a word's edge), how
    often each symbol occurs, the classes, words of a class and tails of the model; and for each tail the log of its mass
    and of what words seen once have of it."""

    hashes: np.ndarray
    ids: np.ndarray
    spelling: np.ndarray
    counts: np.ndarray
    shape: tuple[int, int, int]
    mass: np.ndarray
    once: np.ndarray

    def encode(self, words: Words) -> np.ndarray:
        """The symbol of each word."""
        classes, size, tails = self.shape
        tail = (classes * size + words.hashes.view(np.int64) % tails).astype(np.int32)
        if len(self.hashes) == 0:
            return tail
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes, self.ids[at], tail)

    def initial(self) -> Gru:
        """A model whose biases are the counts'."""
        classes, size, tails = self.shape
        model = Gru.initial(classes, size, tails=tails)
        n = self.counts + 0.5
        inner = n[: classes * size].reshape(classes, size)
        total = np.concatenate([inner.sum(1), n[classes * size :]])
        model.class_bias[:] = np.log(total / total.mean())
        model.word_bias[:] = np.log(inner / inner.mean(1, keepdims=True))
        return model

    def spelled(self, words: Words, unknown: np.ndarray) -> np.ndarray:
        """log P(spelling) of the chosen words."""
        starts, ends = words.starts[unknown], words.ends[unknown]
        value = self.spelling.reshape(-1)[byte_pairs(words.data, starts, ends)]
        edge = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        return np.add.reduceat(value, edge[:-1]) if len(value) else value


def byte_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes 257 * before + after of each word's bytes, edges included: its length + 1 codes."""
    lengths = ends - starts
    n = int(lengths.sum())
    if n == 0:
        return np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    flat = data[np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(n)].astype(np.int64)
    out = np.full(n + len(lengths), 256, np.int64)
    after = np.full(n + len(lengths), 256, np.int64)
    at = np.arange(n) + word
    out[at + 1] = flat
    out[np.cumsum(lengths + 1)[:-1]] = 256
    out[0] = 256
    after[at] = flat
    return out * 257 + after


def pair_counts(words: Words) -> np.ndarray:
    """How often each code of ``byte_pairs`` occurs."""
    out = np.zeros(257 * 257, np.int64)
    if len(words.starts):
        data = words.data
        inside = WORD_BYTE[data]
        inside[words.ends - 1] = False
        at = np.flatnonzero(inside)
        code = data[at].astype(np.int32) * 257
        code += data[at + 1]
        out += np.bincount(code, minlength=257 * 257)
        out[256 * 257 : 256 * 257 + 256] += np.bincount(data[words.starts], minlength=256)
        out[256 : 256 * 257 : 257] += np.bincount(data[words.ends - 1], minlength=256)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, byte-pair counts and the number of texts of a partition."""
    hashes, numbers, held = [], [], 0
    pairs, texts = np.zeros(257 * 257, np.int64), 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        return unique, np.bincount(inverse, weights=np.concatenate(numbers)).astype(np.int64)

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    for batch in batches:
        texts += batch.num_rows
        for a, b in slices(batch.column("text")):
            words = Words(batch.column("text").slice(a, b - a))
            unique, n = np.unique(words.hashes, return_counts=True)
            hashes.append(unique)
            numbers.append(n)
            held += len(unique)
            pairs += pair_counts(words)
            if held > 1 << 20:
                one, two = merged()
                hashes, numbers, held = [one], [two], 0
                if len(one) > 1 << 21:
                    yield rows(0, one, two)
                    hashes, numbers = [], []
    if hashes:
        yield rows(0, *merged())
    at = np.flatnonzero(pairs)
    yield rows(1, at, pairs[at])
    yield rows(2, np.zeros(1, np.int64), np.array([texts]))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(kind, key, n)``: how often each word (kind 0, by hash) and byte pair (1) occurs, and the number of texts (2)."""
    counts = docs.select("text").where("text is not null").mapInArrow(lean(_counts), "kind int, key long, n long")
    return written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def vocabulary(counts: DataFrame, classes: int | None = None) -> Vocabulary:
    """From the counts; the driver receives ``MOST_CLASSES ** 2`` words at most, 257^2 pairs and a row for each tail."""
    words = counts.where("kind = 0").select("key", "n")
    if classes is None:
        classes = min(MOST_CLASSES, max(CLASSES, int(np.ceil(words.where("n > 1").count() ** (1 / 3)))))
    head = words.orderBy(F.desc("n"), "key").limit(classes * classes - FIRST).toArrow()
    key, often = head["key"].to_numpy(), head["n"].to_numpy()
    order = np.lexsort((key, -often))
    key, often = key[order], often[order]
    rest = words.limit(0) if len(key) == 0 else words.where((F.col("n") < int(often[-1])) | ((F.col("n") == int(often[-1])) & (F.col("key") > int(key[-1]))))
    tails = rest.groupBy(F.pmod("key", F.lit(TAILS)).cast("int").alias("tail")).agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).toArrow()
    mass, once = np.zeros(TAILS), np.zeros(TAILS)
    mass[tails["tail"].to_numpy()], once[tails["tail"].to_numpy()] = tails["n"].to_numpy(), tails["once"].to_numpy()
    other = counts.where("kind <> 0").toArrow()
    kind, code, n = (other[c].to_numpy() for c in ("kind", "key", "n"))
    pairs = np.zeros(257 * 257)
    pairs[code[kind == 1]] += n[kind == 1]
    pairs = pairs.reshape(257, 257) + 0.01
    symbols = np.zeros(classes * classes + TAILS)
    symbols[END], symbols[FIRST : FIRST + len(key)], symbols[classes * classes :] = n[kind == 2].sum(), often, mass
    by_hash = np.argsort(key.view(np.uint64))
    # a spelling may belong to any tail, so those of one tail are TAILS times as likely within it
    share = np.log(np.maximum(once, 0.5) / np.maximum(mass, 1)) + np.log(TAILS)
    return Vocabulary(key.view(np.uint64)[by_hash], (by_hash + FIRST).astype(np.int32), np.log(pairs / pairs.sum(1, keepdims=True)), symbols, (classes, classes, TAILS), np.log(np.maximum(mass, 1)), share)


def _with_ends(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """END after every document."""
    return np.insert(ids, row[1:], END)


def rounds_for(tokens: float) -> int:
    return max(ROUNDS, int(np.ceil(np.log2(max(1.0, tokens / ROUND_TOKENS)))))


def fit(docs: DataFrame, words: Vocabulary, rounds: int | None = None, rate: float = RATE) -> Gru:
    """One pass over all documents, in rounds of local training and averaging."""
    rounds = rounds or rounds_for(float(words.counts.sum()))
    context = docs.sparkSession.sparkContext
    model = words.initial()
    shape = model.shape
    shared_words = context.broadcast(words)
    docs = docs.where("text is not null")
    for turn in range(rounds):
        start = context.broadcast(model.flat())

        def task(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(Gru.of(start.value, *shape), rate / (1 + turn))
            held, n = [np.zeros(1, np.int32)], 1
            for batch in batches:
                for a, b in slices(batch.column("text")):
                    got = Words(batch.column("text").slice(a, b - a))
                    held.append(_with_ends(shared_words.value.encode(got), got.row))
                    n += len(held[-1])
                    if n >= CHUNK_TOKENS:
                        trainer.train(np.concatenate(held))
                        held, n = [np.zeros(1, np.int32)], 1
            if n > 1:
                trainer.train(np.concatenate(held))
            if trainer.tokens:
                values = trainer.values
                at = list(range(0, len(values), PIECE))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array([float(trainer.tokens)] * len(at)), pa.array([values[i : i + PIECE].tobytes() for i in at], pa.binary())],
                    names=["piece", "tokens", "mean"],
                )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for piece, tokens, mean in zip(*(batch.column(c).to_pylist() for c in ("piece", "tokens", "mean")), strict=True):
                    own = sums.setdefault(piece, [0.0, 0.0])
                    own[0] += tokens
                    own[1] = own[1] + tokens * np.frombuffer(mean, np.float32).astype(np.float64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()]), pa.array([(s[1] / s[0]).astype(np.float32).tobytes() for s in sums.values()], pa.binary())], names=["piece", "tokens", "mean"])

        schema = "piece int, tokens double, mean binary"
        mine = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn).select("text")
        got = mine.mapInArrow(lean(task), schema).repartition("piece").mapInArrow(lean(add), schema).collect()
        if got:
            values = model.flat()
            for r in got:
                part = np.frombuffer(r["mean"], np.float32)
                values[r["piece"] : r["piece"] + len(part)] = part
            model = Gru.of(values, *shape)
        start.unpersist()
    return model


def document_scores(model: Gru, documents: list[np.ndarray]) -> np.ndarray:
    """Sum of log P of each document's symbols and its end mark; the state runs through the whole document."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    lengths = np.array([len(documents[i]) + 1 for i in order])
    flat = np.concatenate([documents[i] for i in order]) if documents else np.zeros(0, np.int32)
    base = np.concatenate([[0], np.cumsum(lengths - 1)])
    total = np.zeros(len(order))
    h = np.zeros((len(order), model.shape[2]), np.float32)
    words = np.full(len(order), END, np.int64)
    states, targets, rows, held = [], [], [], 0
    # how many documents have a step t: those longer than t
    longer = (len(order) - np.cumsum(np.bincount(lengths, minlength=1))).tolist() if order else []
    for t in range(int(lengths.max(initial=0))):
        active, inner = longer[t], longer[t + 1]
        h = model.step(words[:active], h[:active])[0]
        target = np.full(active, END, np.int64)
        target[:inner] = flat[base[:inner] + t]
        states.append(h)
        targets.append(target)
        rows.append(np.arange(active))
        words, held = target, held + active
        if held >= 1 << 15:
            total += np.bincount(np.concatenate(rows), weights=model.log_probability(np.concatenate(states), np.concatenate(targets)), minlength=len(order))
            states, targets, rows, held = [], [], [], 0
    if held:
        total += np.bincount(np.concatenate(rows), weights=model.log_probability(np.concatenate(states), np.concatenate(targets)), minlength=len(order))
    out = np.empty(len(order))
    out[order] = total
    return out


def score(docs: DataFrame, model: Gru, words: Vocabulary, counts: DataFrame) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, per_word)``, natural logarithms."""
    context = docs.sparkSession.sparkContext
    shared, shape = context.broadcast((model.flat(), words)), model.shape
    first_tail = words.shape[0] * words.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocab = Gru.of(shared.value[0], *shape), shared.value[1]
        ids: list[pa.Array] = []
        known: list[pa.Array] = []
        documents: list[np.ndarray] = []
        rare: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            value, n = document_scores(own, documents), np.array([len(d) for d in documents])
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.concat_arrays(known), pa.array(n, pa.int32()), pa.array(value), pa.concat_arrays(rare)],
                names=["doc_id", "known", "n_words", "value", "rare"],
            )

        for batch in batches:
            for a, b in slices(batch.column("text")):
                texts = batch.column("text").slice(a, b - a)
                got = Words(texts)
                code = vocab.encode(got)
                at = np.flatnonzero(code >= first_tail)
                row = np.searchsorted(got.row, at, "right") - 1
                # a word that is several times in a document is looked up once
                order = np.lexsort((got.hashes[at], row))
                at, row = at[order], row[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (got.hashes[at[1:]] != got.hashes[at[:-1]])])[: len(at)]
                one = at[new]
                times = np.diff(np.append(np.flatnonzero(new), len(at)))
                edge = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=b - a))])
                parts = [pa.array(got.hashes[one].astype(np.int64)), pa.array(times, pa.int32()), pa.array(vocab.spelled(got, one).astype(np.float32))]
                rare.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(parts, names=["key", "times", "spelled"])))
                known.append(texts.is_valid())
                ids.append(batch.column("doc_id").slice(a, b - a))
                documents += np.split(code, got.row[1:-1])
                size += len(got.data)
                if size >= SCORE_BYTES:
                    yield flush()
                    ids, known, documents, rare, size = [], [], [], [], 0
        if documents:
            yield flush()

    schema = "doc_id long, known boolean, n_words int, value double, rare array<struct<key:long,times:int,spelled:float>>"
    base = written(docs.mapInArrow(lean(apply), schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = base.select("row", F.explode("rare").alias("w")).select("row", "w.*")
    seen = counts.where("kind = 0 and n > 1").select("key", "n")
    tail = F.pmod("key", F.lit(TAILS)).cast("int")
    of = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), tail)
    within = F.when(F.col("n").isNotNull(), F.log(F.col("n").cast("double")) - of(words.mass)).otherwise(of(words.once) + F.col("spelled"))
    more = rare.join(seen, "key", "left").select("row", (F.col("times") * within).alias("more")).groupBy("row").agg(F.sum("more").alias("more"))
    value = F.when(F.col("known"), F.col("value") + F.coalesce("more", F.lit(0.0)))
    scored = base.drop("rare").join(more, "row", "left")
    return scored.select("doc_id", "n_words", F.round(value, 4).alias("log_likelihood"), F.round(value / (F.col("n_words") + 1), 6).alias("per_word"))


def log_likelihood(docs: DataFrame) -> DataFrame:
    """Train on all documents and score all documents."""
    docs = documents_only(docs)
    counts = word_counts(docs)
    words = vocabulary(counts)
    return score(docs, fit(docs, words), words, counts)
