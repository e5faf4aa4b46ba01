"""N-gram Jaccard join: group-count vectors in R-trees bound the overlap, survivors are verified exactly.

Every document is the set of its word n-grams.  Documents of one and the same set form one *node*,
whatever their number.  Two nodes of Jaccard ``threshold`` or more are *linked*, and linked nodes form
classes.  The result has a row for each document with its class and the number of its links, so it grows with the
documents and not with the pairs, though every pair is verified.

A count-vector R-tree alone cannot be spread over a cluster: boxes of unrelated texts overlap, so all
trees would meet all trees.  A prefix filter brings nodes together first, and it loses no pair:

* grams have one order, by the number of sets that have them, rare ones first.  So many of a set's first grams are its *prefix*
  that any two linked sets share a gram of both prefixes.  All grams are counted; those that no other set has are dropped;
* the holders of a gram are paired.  By the places of a pair's first common gram its overlap is bounded; pairs below the
  threshold are left out.  Of the others a bucket of grams keeps the edges that connect its nodes, one for each
  at most, so edges grow with the grams and not with the pairs.  A gram of more than ``MOST_PAIRED`` holders is
  not paired: its holders, by size, are chained wherever the sizes allow a link;
* nodes that are connected by what is left form a *unit*, and any two nodes of a unit are compared.  A
  link lies in one unit, so it counts once.

The nodes of a unit are the points of an R-tree (a single leaf, if they are few); its bounds discard pairs, and the
sets of what is left are compared in full, so no link is wrong.  A unit of many nodes or grams is cut into tiles,
and each two tiles are a unit of work of their own: no task holds more than two tiles.

Shuffles: nodes by set; all grams, 32 bits of each, to be counted; those of several sets, back to their chunks of sets; the prefixes'
grams that others share; edges of units; sets of nodes of a unit, once for each piece of work.

Defined cases: null ids are left out; a text without words (null, empty, marks alone) is a class of its own with no
link and no copy; a text of fewer than n words is one gram of all of them; every row counts on its own, so repeated rows
are copies of one another; a class is named by its least id, which two classes share only if an id repeats with
different texts; extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import documents_only, keyed, lean, written
from docquarry.llm.rtree import FANOUT, CountRTree, pair_passes_at
from docquarry.llm.tokens import U64, Words, grams, mix, slices

N = 3
THRESHOLD = 0.5
GROUPS = 32
#: A gram of a prefix with more holders chains them; one with fewer pairs them.
MOST_PAIRED = 1024
#: Grams of fewer sets are not told apart in the order; it decides the cost and never the result.
SAMPLE_TIMES = 3
#: Grams of the sets for each bucket that counts them, and for each that pairs the holders of what is left of them.
BUCKET_GRAMS, PREFIX_GRAMS = 1 << 21, 1 << 22
#: Grams and sets that a task holds before they are sent; places in a chunk are 16 bits.
HELD_GRAMS, CHUNK_NODES = 1 << 19, 1 << 15
#: Nodes and grams of a tile, about; a key with more has several.
TILE_NODES = 4096
TILE_GRAMS = 1 << 20
#: Ids broadcast at most (16 MB); beyond, the same filter is a shuffled join.
BROADCAST_IDS = 1_000_000
#: Bytes of the bit matrix that compares a unit's sets; sets that need more are merged pair by pair.
MATRIX_BYTES = 96 << 20

def gram_sets(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-gram hashes."""
    for a, b in slices(texts):
        words = Words(texts.slice(a, b - a))
        hashes, at = grams(words.hashes, words.row, n)
        edge = np.searchsorted(at, words.row)
        for i in range(b - a):
            yield np.unique(hashes[edge[i] : edge[i + 1]])


def set_key(members: np.ndarray) -> int:
    """64 bits that name a set."""
    return int(mix(mix(members).sum(dtype=np.uint64, keepdims=True) + U64(len(members)))[0].astype(np.int64))


def group_counts(members: np.ndarray) -> np.ndarray:
    """How many members fall in each group; saturated vectors bound nothing."""
    counts = np.bincount((members & U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.where(counts.max() < 65535, counts, 65535).astype(np.uint16)


def sketches(docs: DataFrame, n: int = N) -> DataFrame:
    """For each row ``(row, doc_id, text)`` its node and set size."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                sets = list(gram_sets(texts.slice(a, b - a), n))
                sizes = np.array([len(s) for s in sets])
                node = pa.array([set_key(s) if len(s) else 0 for s in sets], pa.int64(), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), node, pa.array(sizes, pa.int32())], names=["row", "doc_id", "node", "size"])

    return docs.mapInArrow(lean(apply), "row long, doc_id long, node long, size int")


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """So many of a set's first grams that the first common gram of a pair at the threshold is among them."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _gaps(owner: np.ndarray) -> bytes:
    """Ascending places below 65,536, as bytes if their gaps allow."""
    gaps = np.diff(owner, prepend=0)
    return gaps.astype(np.uint8 if gaps.max(initial=0) < 256 else np.uint16).tobytes()


def _places(gaps: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, np.uint8 if len(gaps) == n else np.uint16), dtype=np.int64)


def _messages(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 64], strict=True), schema, strict=True)], schema=schema)


_GRAMS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("head", pa.bool_()), ("grams", pa.binary()), ("owners", pa.binary())])
_SHARED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("head", pa.bool_()), ("number", pa.int32()), ("grams", pa.binary()), ("owners", pa.binary()), ("kinds", pa.binary())])


def _dealt(n: int, buckets: int):
    """All grams of a chunk of sets, a message for each bucket of grams, and the chunk's nodes and sizes as its head."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, chunks = context.partitionId() if context else 0, 0
        held: dict[int, np.ndarray] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nodes, sizes = np.array(list(held), np.int64), np.array([len(s) for s in held.values()], np.int32)
            # of this content, so that a task that runs again in another order mixes no chunks
            chunk = int(mix(np.array([set_key(mix(nodes.view(np.uint64)) + np.arange(len(nodes), dtype=np.uint64)), part << 32 | chunks]).view(np.uint64)).sum(dtype=np.uint64).astype(np.int64))
            spread = mix(np.concatenate(list(held.values())))
            owner = np.repeat(np.arange(len(nodes)), sizes)
            held.clear()
            bucket = ((spread >> U64(32)) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, low = bucket[order], owner[order], spread[order].astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = [(chunk % buckets, chunk, True, nodes.tobytes(), sizes.tobytes())]
            rows += [(int(bucket[i]), chunk, False, low[i:j].tobytes(), _gaps(owner[i:j])) for i, j in zip(first, np.append(first[1:], len(bucket)), strict=True)]
            yield from _messages(rows, _GRAMS)

        for batch in batches:
            for a, b in slices(batch.column("text")):
                for s in gram_sets(batch.column("text").slice(a, b - a), n):
                    if len(s) and (key := set_key(s)) not in held:
                        held[key] = s
                        total += len(s)
                        if total >= HELD_GRAMS or len(held) >= CHUNK_NODES:
                            yield from flush()
                            chunks, total = chunks + 1, 0
        if held:
            yield from flush()

    return apply


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to their chunks go the grams that several sets have, with their classes by frequency; heads go on as they are."""
    for part in each_run(batches, "bucket"):
        bucket = part["bucket"][0].as_py()
        chunk, head = part["chunk"].to_pylist(), part["head"].to_pylist()
        grams, owners = part["grams"].to_pylist(), part["owners"].to_pylist()
        yield from _messages([(c, bucket, True, 0, g, o, b"") for c, h, g, o in zip(chunk, head, grams, owners, strict=True) if h], _SHARED)
        chunk, grams, owners = ([x for x, h in zip(c, head, strict=True) if not h] for c in (chunk, grams, owners))
        if not chunk:
            continue
        edge = np.cumsum([0] + [len(g) // 4 for g in grams])
        low = np.frombuffer(b"".join(grams), np.uint32)
        _, which, times = np.unique(low, return_inverse=True, return_counts=True)
        kinds = np.where(times >= SAMPLE_TIMES, np.minimum(255, 1 + 4 * np.log2(times)), 0).astype(np.uint8)
        rows = []
        for c, o, i, j in zip(chunk, owners, edge[:-1], edge[1:], strict=True):
            often = times[which[i:j]] > 1
            rows.append((c, bucket, False, j - i, low[i:j][often].tobytes(), _gaps(_places(o, j - i)[often]), kinds[which[i:j][often]].tobytes()))
        yield from _messages(rows, _SHARED)


def _prefixes(threshold: float, buckets: int):
    """The grams of the sets' prefixes that other sets have too, by bucket: columns of many in one value, a set's next to each other.

    A gram is named by its bucket and 32 bits; two of one name are in the same place of the order, and no pair is lost by it."""
    columns = (("grams", np.uint64), ("nodes", np.int64), ("sizes", np.int32), ("places", np.uint16))
    schema = pa.schema([("bucket", pa.int32()), *((name, pa.binary()) for name, _ in columns)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            values = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            bucket = (mix(values[0]) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, values = bucket[order], [v[order].astype(kind) for v, (_, kind) in zip(values, columns, strict=True)]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            yield from _messages([(int(bucket[i]), *(v[i:j].tobytes() for v in values)) for i, j in zip(first, np.append(first[1:], len(bucket)), strict=True)], schema)

        for part in each_run(batches, "chunk"):
            rows = part.to_pylist()
            heads, rows = [r for r in rows if r["head"]], [r for r in rows if not r["head"]]
            nodes, sizes = np.frombuffer(heads[0]["grams"], np.int64), np.frombuffer(heads[0]["owners"], np.int32).astype(np.int64)
            if len(heads) != 1 or sum(r["number"] for r in rows) != sizes.sum():
                raise RuntimeError("a task ran twice and read its rows in another order")
            low = [np.frombuffer(r["grams"], np.uint32) for r in rows]
            gram = np.concatenate([x.astype(np.uint64) | U64(r["bucket"] << 32) for x, r in zip(low, rows, strict=True)])
            owner = np.concatenate([_places(r["owners"], len(x)) for x, r in zip(low, rows, strict=True)])
            kind = np.frombuffer(b"".join(r["kinds"] for r in rows), np.uint8)
            order = np.lexsort((gram, kind, owner))
            gram, owner = gram[order], owner[order]
            number = np.bincount(owner, minlength=len(nodes))
            # grams that no other set has come first
            place = np.arange(len(gram)) - np.repeat(np.cumsum(number) - number, number) + (sizes - number)[owner]
            keep = place < prefix_length(sizes, threshold)[owner]
            gram, owner, place = gram[keep], owner[keep], place[keep]
            if len(gram):
                held.append((gram, nodes[owner], sizes[owner], np.minimum(place, 65535)))
            if sum(len(h[0]) for h in held) >= HELD_GRAMS:
                yield from flush()
        if held:
            yield from flush()

    return apply


def _met(threshold: float):
    """Edges of a bucket: nodes that may be linked and meet in a gram of the bucket are connected by them, and each of its nodes
    has one edge at most, however many it meets.  Holders of a gram that has too many are chained."""
    share = threshold / (1 + threshold)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, "bucket"):
            gram, node, size, place = (np.frombuffer(b"".join(part[c].to_pylist()), k) for c, k in (("grams", np.uint64), ("nodes", np.int64), ("sizes", np.int32), ("places", np.uint16)))
            order = np.lexsort((place, node, size, gram))
            gram, node, size, place = gram[order], node[order], size[order].astype(np.int64), place[order].astype(np.int64)
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
            gram, node, size, place = gram[new], node[new], size[new], place[new]
            start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            length = np.diff(np.append(start, len(gram)))
            names, node = np.unique(node, return_inverse=True)
            labels = np.arange(len(names))

            many = np.repeat(length > MOST_PAIRED, length)
            run = np.repeat(np.arange(len(start)), length)
            at = np.flatnonzero(many[:-1] & (run[1:] == run[:-1]))
            at = at[size[at] >= threshold * size[at + 1] - 1e-9]
            labels = hook(labels, node[at], node[at + 1])

            fewest = 2
            while fewest <= MOST_PAIRED:  # runs of like length at once
                most = min(4 * fewest - 1, MOST_PAIRED)
                here = np.repeat((length >= fewest) & (length <= most), length)
                n, s, p, r = node[here], size[here], place[here], run[here]
                pieces, held = [], 0
                for gap in range(1, most if len(n) else 1):
                    at = np.flatnonzero(r[gap:] == r[:-gap])
                    x, y = s[at], s[at + gap]
                    needed = np.ceil(share * (x + y) - 1e-6).astype(np.int64)
                    i, j = p[at], p[at + gap]
                    # the first common gram has so many others behind it; places beyond 65535 are not known
                    keep = (x >= threshold * y - 1e-9) & (np.minimum(x - i, y - j) >= needed)
                    at = at[keep]
                    at = at[labels[n[at]] != labels[n[at + gap]]]
                    pieces.append((n[at], n[at + gap]))
                    held += len(at)
                    if held > HELD_GRAMS or gap < 8:
                        labels = hook(labels, *(np.concatenate(c) for c in zip(*pieces, strict=True)))
                        pieces, held = [], 0
                if held:
                    labels = hook(labels, *(np.concatenate(c) for c in zip(*pieces, strict=True)))
                fewest = most + 1
            at = np.flatnonzero(labels != np.arange(len(labels)))
            for k in range(0, len(at), 1 << 16):
                some = at[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(names[labels[some]]), pa.array(names[some])], names=["u", "v"])

    return apply


def candidates(docs: DataFrame, rows: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Edges ``(u, v)`` of nodes that connect every two linked nodes."""
    grams = nodes.agg(F.sum("size")).first()[0] or 0
    # one row of each node is enough; a row that is another node's least stays, for ids may repeat
    copies = rows.join(nodes.where("copies > 1").select("node", F.col("least.row").alias("_least")), "node").where("row <> _least").select("row")
    copies = written(copies.join(nodes.select(F.col("least.row").alias("row")), "row", "left_anti").distinct(), "copies")
    texts = docs.join(_few(copies), "row", "left_anti").select("text")
    dealt = texts.mapInArrow(lean(_dealt(n, max(1, -(-grams // BUCKET_GRAMS)))), "bucket int, chunk long, head boolean, grams binary, owners binary")
    shared = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_counted), "chunk long, bucket int, head boolean, number int, grams binary, owners binary, kinds binary")
    packed = shared.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(_prefixes(threshold, max(1, -(-grams // PREFIX_GRAMS)))), "bucket int, grams binary, nodes binary, sizes binary, places binary")
    return written(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_met(threshold)), "u long, v long"), "met")


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``key`` so that no run of a key is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(key).to_numpy()
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0
        if cut or (held and held[-1].column(key)[-1].as_py() != values[0]):
            first = held + ([batch.slice(0, cut)] if cut else [])
            yield pa.Table.from_batches(first)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def each_run(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs one by one."""
    for part in whole_runs(batches, key):
        values = part[key].to_numpy()
        first = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield part.slice(a, b - a)


class Units:
    """Whole units of work: the nodes of a unit, or of two tiles of one."""

    def __init__(self, part: pa.Table, sets: list[np.ndarray], threshold: float):
        self.threshold = threshold
        column = lambda name: part[name].to_numpy(zero_copy_only=False)
        self.unit, self.node, self.size, self.tile, self.across = (column(c) for c in ("unit", "node", "size", "tile", "across"))
        self.counts = np.array([group_counts(s) for s in sets], np.uint16).reshape(-1, GROUPS)
        self.start = np.flatnonzero(np.concatenate([[True], self.unit[1:] != self.unit[:-1]]))
        self.length = np.diff(np.append(self.start, len(self.unit)))

    def _own(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows of a unit are this unit's: of different tiles if it has two."""
        return (self.node[a] != self.node[b]) & (~self.across[a] | (self.tile[a] != self.tile[b]))

    def few(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that no bound excludes of the units that fit in a leaf, all at once."""
        group, small = np.repeat(np.arange(len(self.start)), self.length), self.length <= FANOUT
        inside = small[group]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for gap in range(1, int(self.length[small].max(initial=1))):
            at = np.flatnonzero(inside[:-gap] & (group[gap:] == group[:-gap]))
            at = at[self._own(at, at + gap)]
            at = at[pair_passes_at(self.counts, self.size, at, at + gap, self.threshold)]
            left.append(at)
            right.append(at + gap)
        return np.concatenate(left), np.concatenate(right)

    def many(self) -> Iterator[tuple[slice, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """Each larger unit's rows, and its pairs in pieces: an R-tree of its nodes joined with itself, or the trees of its tiles."""
        for s, n in zip(self.start, self.length, strict=True):
            if n > FANOUT:
                yield slice(s, s + n), self._joined(s, n)

    def _joined(self, s: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.arange(s, s + n)
        parts = [rows[self.tile[rows] == t] for t in np.unique(self.tile[rows])] if self.across[s] else [rows]
        trees = [CountRTree(self.counts[p], self.size[p]) for p in parts]
        if self.across[s] and len(trees) < 2:
            return
        for a, b in trees[0].join(trees[1] if self.across[s] else None, self.threshold):
            a, b = parts[0][a], parts[-1][b]
            keep = self._own(a, b)
            a, b = a[keep], b[keep]
            keep = pair_passes_at(self.counts, self.size, a, b, self.threshold)
            yield a[keep], b[keep]


def shared_members(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common members of two sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    return x[y[np.minimum(at, len(y) - 1)] == x]


class Bits:
    """Sets of a unit as rows of bits, a column for each member of two sets or more, in their order."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        members, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        common = count > 1
        self.width = -(-int(common.sum()) // 64)
        self.fits = len(sets) * self.width * 8 <= MATRIX_BYTES
        if not self.fits:
            return
        place = np.cumsum(common) - 1
        edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        self.bits = np.zeros((len(sets), self.width), np.uint64)
        for r in range(len(sets)):
            mine = column[edge[r] : edge[r + 1]]
            row = np.zeros(self.width * 64, bool)
            row[place[mine[common[mine]]]] = True
            self.bits[r] = np.packbits(row, bitorder="little").view(np.uint64)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many members each pair shares."""
        n = np.zeros(len(a), np.int64)
        step = max(1, (16 << 20) // (8 * max(1, self.width)))
        for at in range(0, len(a), step):
            s = slice(at, at + step)
            n[s] = np.bitwise_count(self.bits[a[s]] & self.bits[b[s]]).sum(1, dtype=np.int64)
        return n


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least position of each connected group) after the edges are added."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _links(threshold: float):
    """``(node, links, root)``: how many links a node has in a unit, and the first node that these connect it to."""

    def linked(units: Units, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            common = shared_members(sets[x], sets[y])
            out[i] = len(common) >= threshold * (len(sets[x]) + len(sets[y]) - len(common)) - 1e-9
        return out

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, "unit"):
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in part["members"].combine_chunks()]
            units = Units(part, sets, threshold)
            number, labels = np.zeros(len(sets), np.int64), np.arange(len(sets))

            def add(a: np.ndarray, b: np.ndarray, number: np.ndarray = number) -> None:
                nonlocal labels
                number += np.bincount(a, minlength=len(number)) + np.bincount(b, minlength=len(number))
                labels = hook(labels, a, b)

            a, b = units.few()
            keep = linked(units, sets, a, b)
            add(a[keep], b[keep])
            for rows, pairs in units.many():
                bits = Bits(sets[rows])
                for a, b in pairs:
                    if not bits.fits:
                        keep = linked(units, sets, a, b)
                    else:
                        n = bits.shared(a - rows.start, b - rows.start)
                        keep = n >= threshold * (units.size[a].astype(np.int64) + units.size[b] - n) - 1e-9
                    add(a[keep], b[keep])
            at = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(units.node[at]), pa.array(number[at]), pa.array(units.node[labels[at]])], names=["node", "links", "root"])

    return apply


def _sets(n: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                sets = [s for s in gram_sets(batch.column("text").slice(a, b - a), n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    return apply


def _few(ids: DataFrame) -> DataFrame:
    """Ids, marked for broadcast if there are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows ``(row, doc_id, text)``: all with their node; nodes with their least row and number of rows; and ``(node,
    links, root)`` for linked nodes, a row for each unit of work in which one has links."""
    rows = written(sketches(docs, n), "sketches")
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("copies"), F.first("size").alias("size")), "nodes")
    units = written(components(candidates(docs, rows, nodes, threshold, n)).join(nodes.select("node", "size", F.col("least.row").alias("row")), "node"), "units")
    tiles = F.greatest(F.ceil(F.col("n") / TILE_NODES), F.ceil(F.col("grams") / TILE_GRAMS))
    tiled = units.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).select("group", F.least(tiles, "n").cast("int").alias("tiles"))
    placed = units.join(tiled, "group").select("group", "node", "size", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), "tiles")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = F.when(F.col("tiles") == 1, F.col("group")).otherwise(F.xxhash64("group", F.least("tile", "other"), F.greatest("tile", "other")))
    placed = placed.select(unit.alias("unit"), "node", "size", "tile", (F.col("tile") != F.col("other")).alias("across"))

    sets = docs.join(_few(units.select("row")), "row", "left_semi").select("text").mapInArrow(lean(_sets(n)), "node long, members binary").dropDuplicates(["node"])
    work = placed.join(sets, "node").select(*placed.columns, "members")
    found = work.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(_links(threshold)), "node long, links long, root long")
    return rows, nodes, written(found, "links")


def components(edges: DataFrame) -> DataFrame:
    """``(node, group)`` of the connected groups of edges ``(u, v)``, group the least node, by alternating stars.

    Every round writes its edges to the shared folder, so lineage stays short; rounds grow with the
    logarithm of the longest path.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges, before = written(edges.where("u <> v").distinct(), "edges"), None
    while True:
        # large star: every greater neighbour is linked to the least of the neighbourhood
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = near.join(least, "u").where("v > u").select("v", F.col("m").alias("w")).where("v <> w").distinct()
        # small star: every lesser neighbour and the node itself are linked to the least
        least = edges.groupBy("v").agg(F.min("w").alias("m"))
        joined = edges.join(least, "v")
        edges = joined.select(F.col("m").alias("u"), F.col("w").alias("v")).unionByName(joined.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()
        edges = written(edges, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("group")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("group")).distinct())


def _classes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``(node, least, n_links)`` of linked nodes: the least row of their class and how many nodes they are linked to."""
    number = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = written(components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))), "groups")
    own = nodes.select("node", "least").join(groups, "node")
    least = own.groupBy("group").agg(F.min("least").alias("least"))
    return groups.join(least, "group").join(number, "node").select("node", "least", "n_links")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """``(doc_id, class_id, n_copies, n_links)`` for every row with an id.

    A class is a group of documents connected by links, copies included, named by its least id.  ``n_copies`` are the
    rows of the very same n-gram set, the row itself among them; ``n_links`` the different other sets whose Jaccard with it is
    ``threshold`` or more.
    """
    docs = documents_only(docs).where("doc_id is not null")
    rows, nodes, found = links(docs.select(F.col("doc_id").alias("row"), "doc_id", "text"), threshold, n)
    known = nodes.select("node", F.col("least").alias("own"), "copies").join(_classes(nodes, found), "node", "left")
    known = known.select("node", F.coalesce("least.doc_id", "own.doc_id").alias("class_id"), F.col("copies").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("node is not null").join(known, "node").select("doc_id", "class_id", "n_copies", "n_links").unionByName(alone)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """``docs`` without copies and near copies: of the rows of each class, one of the least id stays.

    Every row is judged by its own text, whatever other rows are under its id, and repeated rows are copies.  Rows
    of a null id and texts without words stay.
    """
    docs, key = keyed(docs, "rows")
    mine = docs.where("doc_id is not null").select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, nodes, found = links(mine, threshold, n)
    classes = _classes(nodes, found).select("node", "least")
    copied = nodes.where("copies > 1").select("node", "least").join(classes.select("node"), "node", "left_anti")
    dropped = rows.select("node", F.col("row").alias("_dropped")).join(classes.unionByName(copied), "node").where("_dropped <> least.row").select("_dropped")
    dropped = _few(written(dropped, "dropped"))
    return docs.join(dropped, docs[key] == dropped["_dropped"], "left_anti").drop(key)


ORACLE_SQL = r"""
with recursive words as (
  select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents where doc_id is not null),
sets as (
  select r, doc_id, list_sort(list_distinct(case when len(w) = 0 then ['no words in row ' || r] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s
  from words),
nodes as materialized (select row_number() over () as node, s, min(doc_id) as least, count(*) as copies, len(s) as size from sets group by s),
members as (select node, size, unnest(s) as g from nodes),
pairs as (
  select a.node as a, b.node as b, count(*) as o, a.size as x, b.size as y
  from members a join members b on a.g = b.g and a.node <> b.node group by all),
edges as materialized (select a, b from pairs where o / (x + y - o)::double >= 0.5),
reach as (select node as a, node as b from nodes union select r.a, e.b from reach r join edges e on r.b = e.a),
classes as (select r.a as node, min(n.least) as class_id from reach r join nodes n on n.node = r.b group by r.a),
degrees as (select a as node, count(*) as n_links from edges group by a)
select s.doc_id, c.class_id, n.copies as n_copies, coalesce(d.n_links, 0)::bigint as n_links
from sets s join nodes n on s.s = n.s join classes c using (node) left join degrees d using (node)
"""
