"""Personal data by a skip-chain conditional random field.

Nodes are white-space tokens, labels O, EMAIL, PHONE, CARD, IP and SECRET.  Neighbouring tokens share
chain potentials; skip edges join each token that repeats an earlier one, or has its shape, to the
nearest such token before it in the document, however far.  Loopy message passing then makes
distant mentions agree: a fragment that says little by itself takes the label of its clear twin.

Only some tokens are *evident*: those with a digit (of any script), with an "@", or of twenty letters, marks of
identifiers and more; all others are O.  The graph of a document holds the evident tokens and ``MARGIN`` plain tokens
around each; beyond, a message has forgotten where it came from (tests compare with the whole graph).  Repeats are
looked for over the whole document.  A fragment that is not evident by itself, such as a name out of an address, is no entity.

Messages are passed until they settle, ``ROUNDS`` rounds at most: after each round only edges at nodes whose belief has moved
go on.  Edges are taken ``EDGES`` at a time and renewed in place, so that a document needs a few hundred bytes for each evident token
whatever its length, and a document of nothing but numbers no more than that.

Weights are fitted by gradient ascent on the likelihood with loopy marginals, on documents that a
seeded generator writes with entities in several formats, noise around tokens, bare fragments of earlier
entities, and numbers that are no entities.  No labelled corpus is needed and none is sampled.

Defined cases: null and empty texts have no entities and pass ``redact`` unchanged; rows with a null id
are left out of ``entities`` but redacted by ``redact``; repeated rows are treated each on its own; extra
columns pass through ``redact``.  ``n_chars``, where it exists, follows the redacted text.
"""

from __future__ import annotations

import functools
import random
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docquarry.llm.common import documents_only, lean, small_batches
from docquarry.llm.tokens import runs, slices, string_buffers

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET")
O, EMAIL, PHONE, CARD, IP, SECRET = range(6)
K = len(LABELS)
MARGIN = 2
ROUNDS = 200
#: A belief that moves less has settled.
SETTLED = 1e-3
#: Edges whose messages are renewed at once.
EDGES = 1 << 15
CHAIN, SAME, ALIKE = range(3)
TRAIN_DOCUMENTS = 320

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n\f\v")] = True
_SIGNAL = np.zeros(256, bool)
_SIGNAL[list(b"0123456789@")] = True
#: Whether two bytes can begin a digit that is not ASCII; a token with such a pair is looked at.
_DIGIT_PAIR = np.zeros(1 << 16, bool)
for _c in map(chr, range(128, sys.maxunicode + 1)):
    if _c.isdigit():
        _DIGIT_PAIR[int.from_bytes(_c.encode()[:2], "big")] = True
_LEFT = "\"'[{<*%$#&!,.;:|=`~"
_RIGHT = "\"']}>*%$#&!,.;:|=?`~"
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9a-z_\-]{20,}")
#: A token without a digit that may still be a secret.
LETTERS = 20
_LETTERS = re.compile(r"[a-z_\-]{%d,}" % LETTERS)


def evident(token: str) -> bool:
    """Whether a token can be anything but O."""
    if any(c.isdigit() or c == "@" for c in token):
        return True
    if len(token) < LETTERS:
        return False
    a, b = trim(token)
    return _LETTERS.fullmatch(token[a:b].lower()) is not None


def trim(token: str) -> tuple[int, int]:
    """The token's range without noise and punctuation around it."""
    a = len(token) - len(token.lstrip(_LEFT))
    b = len(token.rstrip(_RIGHT))
    return (a, b) if a < b else (0, len(token))


def shape(core: str) -> str:
    """Classes of characters, runs collapsed."""
    out: list[str] = []
    for c in core:
        k = "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out) if len(out) <= 14 else "mixed"


@functools.lru_cache(1 << 14)
def _look(token: str) -> tuple[int, str, int, str, bool]:
    """Where the token's core begins, the core, its digits, its shape, and whether the token is evident; neighbours ask again."""
    a, b = trim(token)
    core = token[a:b].lower()
    return a, core, sum(c.isdigit() for c in core), shape(core), evident(token)


def _context(token: str) -> str:
    _, core, digits, form, _ = _look(token)
    return f"{form}:{digits}" if digits or "@" in core else core


def token_features(tokens: Sequence[str], i: int) -> list[str]:
    """Names of a token's features; a plain token has the one."""
    token = tokens[i]
    a, core, digits, form, some = _look(token)
    if not some:
        return ["plain"]
    before = _context(tokens[i - 1]) if i else "<s>"
    after = _context(tokens[i + 1]) if i + 1 < len(tokens) else "</s>"
    out = ["some", "shape=" + form, f"digits={min(digits, 20)}", f"length={min(len(core), 48) // 4}", f"both={form}:{digits}", "before=" + before, "after=" + after, f"joined={form}|{before}", f"followed={form}|{after}"]
    if i > 1:
        out.append("before2=" + _context(tokens[i - 2]))
    if not digits and "@" not in core:
        out.append(f"vowels={10 * sum(c in 'aeiou' for c in core) // len(core)}")
    if _HEX.fullmatch(core):
        out += ["hexlike", "hexlike|" + ("quoted" if a and token[a - 1] in "\"'" else "bare")]
    if form == "9.9.9.9":
        out.append("octets=" + str(all(x.isascii() and len(x) <= 3 and int(x) < 256 for x in core.split("."))))
    if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", core):
        out.append("address")
    return out


def skip_keys(token: str) -> tuple[str, str]:
    """What a token must share with an earlier one for a skip edge: its text, or its shape and size."""
    _, core, digits, form, _ = _look(token)
    return core, f"{form}:{digits}"


def _before(keys: np.ndarray, at: np.ndarray, wanted: np.ndarray, here: np.ndarray) -> np.ndarray:
    """For each wanted key the last place before ``here`` that has it, or -1; ``at`` are the places of ``keys``, rising."""
    if len(keys) == 0:
        return np.full(len(wanted), -1)
    names, code = np.unique(np.concatenate([keys, wanted]), return_inverse=True)
    span = int(max(at.max(initial=0), here.max(initial=0))) + 2
    known = np.sort(code[: len(keys)].astype(np.int64) * span + at)
    own = code[len(keys) :].astype(np.int64) * span
    last = np.searchsorted(known, own + here) - 1
    value = known[np.maximum(last, 0)]
    return np.where((last >= 0) & (value >= own), value - own, -1)


def skip_edges(tokens: Sequence[str], nodes: Sequence[int]) -> np.ndarray:
    """(earlier node, later node, kind): to the last token of the same text or with it as a piece, or else of a like shape."""
    texts, forms, pieces, holders = (array("q") for _ in range(4))
    for n, i in enumerate(nodes):
        text, form = skip_keys(tokens[i])
        texts.append(hash(text))
        forms.append(hash(form))
        for piece in re.findall(r"[0-9a-z]{4,}(?:-[0-9a-z]{4,})*", text):
            pieces.append(hash(piece))
            holders.append(n)
    text, form, piece, holder, here = (np.array(x, np.int64) for x in (texts, forms, pieces, holders, range(len(nodes))))
    same, part, alike = _before(text, here, text, here), _before(piece, holder, text, here), _before(form, here, form, here)
    earlier = np.where(same >= 0, same, np.where(part >= 0, part, alike))
    kind = np.where((same >= 0) | (part >= 0), SAME, ALIKE)
    keep = earlier >= 0
    return np.stack([earlier[keep], here[keep], kind[keep]], 1)


@dataclass
class Graph:
    """Many documents as one graph: the features of its nodes one after another, how many each has, and edges by kind."""

    features: np.ndarray
    sizes: np.ndarray
    edges: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The node of each feature."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        out, edge = np.zeros((len(self.sizes), K)), np.concatenate([[0], np.cumsum(self.sizes)])
        for at in range(0, len(self.sizes), EDGES):
            sizes = self.sizes[at : at + EDGES]
            own, rows = self.features[edge[at] : edge[at + len(sizes)]], np.repeat(np.arange(len(sizes)), sizes)
            for k in range(K):
                out[at : at + EDGES, k] = np.bincount(rows, weights=weights[own, k], minlength=len(sizes))
        return out


def pass_messages(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int, damp: float = 0.2, settled: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Loopy belief propagation: the nodes' beliefs, and the messages to the later and to the earlier end of each edge.

    All messages of a round rest on the beliefs before it; ``pair[kind]`` are log potentials from the earlier to the later.
    """
    n, e = len(unary), len(edges)
    beliefs, messages = unary.copy(), np.zeros((2, e, K), np.float32)
    tables = np.exp(np.stack([pair, pair.transpose(0, 2, 1)]))
    at = np.arange(e)
    for step in range(rounds):
        if len(at) == 0:
            break
        change = np.zeros((n, K))
        for s in range(0, len(at), EDGES):
            own = at[s : s + EDGES]
            first, second, kind = edges[own].T
            before = messages[:, own]
            for way, source, target in ((0, first, second), (1, second, first)):
                sent = beliefs[source] - before[1 - way]
                sent = np.exp(sent - sent.max(1, keepdims=True))
                new = np.empty((len(own), K))
                for x in range(len(pair)):
                    mine = kind == x
                    new[mine] = sent[mine] @ tables[way, x]
                new = np.log(new / new.sum(1, keepdims=True))
                if step:
                    new = damp * before[way] + (1 - damp) * new
                new = new.astype(np.float32)
                messages[way, own] = new
                new -= before[way]
                for k in range(K):
                    change[:, k] += np.bincount(target, weights=new[:, k], minlength=n)
        beliefs += change
        if settled:
            moved = np.abs(change - change.mean(1, keepdims=True)).max(1) > settled
            at = np.flatnonzero(moved[edges[:, 0]] | moved[edges[:, 1]])
    return beliefs, messages


def propagate(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals and pair marginals of each edge."""
    beliefs, messages = pass_messages(unary, edges, pair, rounds)
    i, j = edges[:, 0], edges[:, 1]
    joint = pair[edges[:, 2]] + (beliefs[i] - messages[1])[:, :, None] + (beliefs[j] - messages[0])[:, None, :]
    if len(edges):
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
    node = np.exp(beliefs - beliefs.max(1, keepdims=True)) if len(unary) else beliefs
    return node / node.sum(1, keepdims=True) if len(unary) else node, joint


@dataclass(frozen=True)
class SkipChain:
    """Feature ids, their weights, and the log potentials of chain and skip edges."""

    ids: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def graph(self, documents: Sequence[Sequence[str]], nodes: Sequence[Sequence[int]]) -> Graph:
        features, sizes, edges, at = array("i"), array("i"), [np.zeros((0, 3), np.int64)], 0
        for tokens, kept in zip(documents, nodes, strict=True):
            signal = array("q")
            for n, i in enumerate(kept):
                own = [self.ids[f] for f in token_features(tokens, i) if f in self.ids]
                features.extend(own)
                sizes.append(len(own))
                if _look(tokens[i])[4]:
                    signal.append(n)
            kept, signal = np.asarray(kept, np.int64), np.array(signal, np.int64)
            chain = np.flatnonzero(np.diff(kept) == 1)
            edges.append(np.stack([at + chain, at + chain + 1, np.full(len(chain), CHAIN)], 1))
            skips = skip_edges(tokens, kept[signal].tolist())
            skips[:, :2] = signal[skips[:, :2]]
            skips = skips[kept[skips[:, 1]] - kept[skips[:, 0]] > 1]  # neighbours have their chain
            skips[:, :2] += at
            edges.append(skips)
            at += len(kept)
        return Graph(np.array(features, np.int32), np.array(sizes, np.int32), np.concatenate(edges).astype(np.int32))

    def label(self, documents: Sequence[Sequence[str]], nodes: Sequence[Sequence[int]]) -> list[np.ndarray]:
        """The most likely label of every node."""
        graph = self.graph(documents, nodes)
        best = pass_messages(graph.unary(self.weights), graph.edges, self.pair, ROUNDS, settled=SETTLED)[0].argmax(1)
        return np.split(best, np.cumsum([len(n) for n in nodes])[:-1]) if nodes else []


def active(tokens: Sequence[str], margin: int = MARGIN) -> list[int]:
    """Tokens with evidence, and ``margin`` plain ones on either side."""
    keep: set[int] = set()
    for i, token in enumerate(tokens):
        if evident(token):
            keep.update(range(max(0, i - margin), min(len(tokens), i + margin + 1)))
    return sorted(keep)


# --- fitting -------------------------------------------------------------------------------------

_SYLLABLES = "an be con de er fi ge ha in jo ka le mo na or pa qu re si ta un vi wo xi yo ze tion ment keit ung able est".split()


def generated_document(rng: random.Random) -> tuple[list[str], list[int]]:
    """Tokens and labels of one document: filler, entities, fragments of them, and harmless numbers."""
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    seen: list[tuple[str, int]] = []

    def entity() -> list[tuple[str, int]]:
        kind = rng.randrange(9)
        if kind <= 1:
            name = word() + rng.choice([f".{number(2)}", "", f"_{word()}", f".{word()}", number(3), f"-{word()}", f".{word()}-{number(2)}"])
            out = [(f"{name}@{word()}{rng.choice(['', number(1)])}.{rng.choice(['example.com', 'net', 'org', 'co.uk', word() + '.de', word() + '.' + word() + '.' + word()[:2]])}", EMAIL)]
            out = ([(rng.choice(["mail", "contact", "email:"]), O)] if rng.random() < 0.2 else []) + out
        elif kind <= 3:
            area, line = number(3), f"{number(3)}-{number(4)}"
            out = [
                [("+" + number(rng.randint(1, 2)), PHONE), (f"({area})", PHONE), (line, PHONE)],
                [("+" + number(1), PHONE), (f"({area})", PHONE), (line, PHONE)],
                [(f"({area})", PHONE), (line, PHONE)],
                [(f"{area}-{line}", PHONE)],
                [("+" + number(2), PHONE), (number(2), PHONE), (number(7), PHONE)],
                [(f"+{number(11)}", PHONE)],
            ][rng.randrange(6)]
            if rng.random() < 0.2:
                out = [(rng.choice(["call", "tel", "phone:"]), O), *out]
            seen.append((line, PHONE))
        elif kind <= 5:
            out = [(number(16), CARD)] if rng.random() < 0.7 else [(number(15), CARD)] if rng.random() < 0.3 else [(number(4), CARD) for _ in range(4)] if rng.random() < 0.6 else [("-".join(number(4) for _ in range(4)), CARD)]
        elif kind <= 6:
            out = [(".".join(str(rng.randrange(256)) for _ in range(4)), IP)]
        else:
            secret = hexes(rng.choice([32, 40, 40, 64])) if rng.random() < 0.85 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(24, 44)))
            name = rng.choice(["token", "token", "api_key", "secret", "password", "key"])
            out = [[(name, O), ("=", O), (f'"{secret}"', SECRET)], [(name + ":", O), (secret, SECRET)], [(f'"{secret}"', SECRET)]][rng.choice([0, 0, 0, 1, 2])]
        if len(out[-1][0]) > 6:
            seen.append(out[-1])
        return out

    def harmless() -> list[tuple[str, int]]:
        return [
            [(str(rng.randint(1, 2100)), O)],
            [(number(rng.randint(1, 8)), O)],
            [(f"{rng.randint(0, 999)}.{number(2)}", O)],
            [(f"{rng.randint(0, 9)}.{rng.randint(0, 9)}", O)],
            [(f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", O)],
            [(f"20{number(2)}-{number(2)}-{number(2)}", O)],
            [(f"{number(2)}:{number(2)}", O)],
            [("isbn", O), (number(13), O)],
            [(f"{word()}{rng.randint(0, 99)}", O)],
            [(f"({rng.randint(1, 99)})", O)],
            [(f"{rng.randint(1, 99)}%", O)],
            [(f"{rng.randint(1, 30)}-{rng.randint(1, 30)}", O)],
            [("@" + word(), O)],
            [("#" + hexes(6), O)],
            [("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(9, 16))), O)],
            [(f"{word()}{word()}{word()}-{word()}{word()}{word()}-{word()}{word()}", O)],
        ][rng.randrange(16)]

    tokens: list[tuple[str, int]] = []
    if rng.random() < 0.05:  # nothing but a number
        tokens = harmless()
    for _ in range(0 if tokens else rng.randint(2, 8)):
        tokens += [(word() + rng.choice(["", "", "", ",", ".", ":"]), O) for _ in range(rng.randint(1, 8))]
        pick = rng.random()
        if pick < 0.45:
            tokens += entity()
            while rng.random() < 0.25:
                tokens += entity()
        elif pick < 0.6 and seen:
            tokens.append(rng.choice(seen))
        else:
            tokens += harmless()
    tokens += [(word(), O) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    style = rng.random()
    out = []
    for text, label in tokens:
        if style < 0.12:
            text += rng.choice(["%%%", "***", "&&&", "###", "$$$"])
        elif style < 0.24:
            text = text.upper() + "!!"
        elif label and rng.random() < 0.25:
            text += rng.choice([",", ".", ";", "!"])
        out.append((text, label))
    return [t for t, _ in out], [y for _, y in out]


@functools.lru_cache(maxsize=4)
def train(documents: int = TRAIN_DOCUMENTS, seed: int = 7, steps: int = 50, rate: float = 0.3, ridge: float = 1e-3) -> SkipChain:
    """Fit on generated documents; deterministic for its arguments."""
    rng = random.Random(seed)
    made = [generated_document(rng) for _ in range(documents)]
    texts, truth = [t for t, _ in made], [y for _, y in made]
    counts = Counter(f for tokens in texts for i in range(len(tokens)) for f in token_features(tokens, i))
    ids = {f: n for n, f in enumerate(sorted(f for f, c in counts.items() if c >= 4))}
    model = SkipChain(ids, np.zeros((len(ids), K)), np.zeros((3, K, K)))
    nodes = [list(range(len(t))) for t in texts]
    graph = model.graph(texts, nodes)
    gold = np.concatenate([np.array(y) for y in truth])
    flat, rows = graph.features, graph.rows
    hot = np.eye(K)[gold]
    gold_pair = np.zeros((len(graph.edges), K, K))
    gold_pair[np.arange(len(graph.edges)), gold[graph.edges[:, 0]], gold[graph.edges[:, 1]]] = 1
    kinds = [graph.edges[:, 2] == k for k in range(3)]
    first, second = [np.zeros_like(model.weights), np.zeros_like(model.pair)], [np.zeros_like(model.weights), np.zeros_like(model.pair)]
    values = [model.weights, model.pair]
    for step in range(1, steps + 1):
        node, joint = propagate(graph.unary(values[0]), graph.edges, values[1], rounds=6)
        gap = (hot - node) / documents
        slope = np.stack([np.bincount(flat, weights=gap[rows, k], minlength=len(ids)) for k in range(K)], 1)
        pair_slope = np.stack([(gold_pair[m] - joint[m]).sum(0) if m.any() else np.zeros((K, K)) for m in kinds]) / documents
        for v, g in enumerate((slope - ridge * values[0], pair_slope - ridge * values[1])):
            first[v] = 0.9 * first[v] + 0.1 * g
            second[v] = 0.99 * second[v] + 0.01 * g * g
            values[v] = values[v] + rate * (first[v] / (1 - 0.9**step)) / (np.sqrt(second[v] / (1 - 0.99**step)) + 1e-8)
    return SkipChain(ids, values[0], values[1])


# --- documents -----------------------------------------------------------------------------------

Span = tuple[int, int, int]


class Tokens:
    """The tokens of a document, made from its bytes when they are asked for."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        self.raw, self.starts, self.ends = raw, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> str:
        return self.raw[self.starts[i] : self.ends[i]].decode("utf-8", "replace")


def _document_spans(tokens: Tokens, nodes: np.ndarray, labels: np.ndarray) -> list[Span]:
    """(start byte, end byte, label); neighbouring tokens of a phone or card number are one span."""
    out: list[Span] = []
    last = None
    found = np.flatnonzero(labels != O)
    for i, y in zip(nodes[found].tolist(), labels[found].tolist(), strict=True):
        token = tokens[i]
        a, b = trim(token)
        a = int(tokens.starts[i]) + len(token[:a].encode())
        b = int(tokens.ends[i]) - len(token[b:].encode())
        if out and last == i - 1 and out[-1][2] == y and y in (PHONE, CARD) and not (y == CARD and out[-1][1] - out[-1][0] > 12 and b - a > 12):
            out[-1] = (out[-1][0], b, y)
        else:
            out.append((a, b, y))
        last = i
    return out


def _evident(raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the evident tokens; only tokens of rare bytes or many are made to be looked at."""
    total = np.concatenate([[0], np.cumsum(_SIGNAL[data], dtype=np.int32)])
    sure = total[ends] > total[starts]
    pair = np.zeros(len(data) + 1, np.int32)
    high = np.flatnonzero(data[:-1] >= 0xC2)
    pair[high + 1] = _DIGIT_PAIR[(data[high].astype(np.int32) << 8) | data[high + 1]]
    np.cumsum(pair, out=pair)
    look = np.flatnonzero(~sure & ((pair[ends] > pair[starts]) | (ends - starts >= LETTERS)))
    sure[look] = [evident(raw[starts[i] : ends[i]].decode("utf-8", "replace")) for i in look.tolist()]
    return np.flatnonzero(sure)


def find(texts: pa.Array, model: SkipChain) -> list[list[Span]]:
    """Entity spans of each text, in bytes of its UTF-8."""
    found: list[list[Span]] = [[] for _ in range(len(texts))]
    for lo, hi in slices(texts):
        data, offsets = string_buffers(texts.slice(lo, hi - lo))
        raw = data.tobytes()
        starts, ends = runs(~_SPACE[data], offsets)
        signal = _evident(raw, data, starts, ends)
        edge = np.searchsorted(starts, offsets)
        rows = np.unique(np.searchsorted(edge, signal, "right") - 1)
        documents, nodes = [], []
        for r in rows:
            a, b = edge[r], edge[r + 1]
            mine = signal[np.searchsorted(signal, a) : np.searchsorted(signal, b)] - a
            near = (mine[:, None] + np.arange(-MARGIN, MARGIN + 1)).reshape(-1)
            documents.append(Tokens(raw[offsets[r] : offsets[r + 1]], starts[a:b] - offsets[r], ends[a:b] - offsets[r]))
            nodes.append(np.unique(near[(near >= 0) & (near < b - a)]))
        if not documents:
            continue
        for r, tokens, kept, labels in zip(rows, documents, nodes, model.label(documents, nodes), strict=True):
            found[lo + int(r)] = _document_spans(tokens, kept, labels)
    return found


def redacted(text: str, spans: list[Span]) -> str:
    data, out, at = text.encode(), [], 0
    for a, b, y in spans:
        out += [data[at:a], f"[{LABELS[y]}]".encode()]
        at = b
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def entities(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """Each document that holds personal data: its spans in characters, and its text without them."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = find(texts, shared.value)
            rows = [i for i, s in enumerate(found) if s]
            lists, clean = [], []
            for i in rows:
                text = texts[i].as_py()
                characters = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
                lists.append([{"start": int(characters[a]), "end": int(characters[b]), "label": LABELS[y]} for a, b, y in found[i]])
                clean.append(redacted(text, found[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, pa.list_(span)), pa.array(clean, pa.string())],
                names=["doc_id", "n_entities", "entities", "redacted_text"],
            )

    schema = "doc_id long, n_entities int, entities array<struct<start:int,end:int,label:string>>, redacted_text string"
    return documents_only(docs).where("doc_id is not null and text is not null").mapInArrow(lean(apply), schema)


def redact(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced by its label in brackets."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    names = docs.columns
    counted = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = find(texts, shared.value)
            changed = {i: redacted(texts[i].as_py(), s) for i, s in enumerate(found) if s}
            if changed:
                columns = {n: batch.column(n) for n in names}
                at = pa.array([i in changed for i in range(batch.num_rows)])
                columns["text"] = pc.replace_with_mask(texts, at, pa.array(list(changed.values()), texts.type))
                if counted:
                    sizes = pa.array([len(v) for v in changed.values()], columns["n_chars"].type)
                    columns["n_chars"] = pc.replace_with_mask(columns["n_chars"], at, sizes)
                batch = pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
            yield batch

    return docs.mapInArrow(lean(apply), docs.schema)
