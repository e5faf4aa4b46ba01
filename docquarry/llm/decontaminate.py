"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (``min_match`` words in a row) are tiled: the longest
common runs of unmarked words are found by running Karp-Rabin at falling search lengths and marked,
longest first, until no run of ``min_match`` words is left.  Tiles never overlap but may come in any
order, so a passage whose sentences were rearranged is covered as well as a verbatim one.  The pair is
reported when tiles cover ``coverage`` of the item's words.

Every tile consists of seeds, so only the words of a document inside seeds shared with the item are
tiled; that loses nothing.  Likewise an item position in no shared seed can't be covered, which bounds
the coverage before any tiling.

The seeds travel to the tasks while the benchmark has at most ``BROADCAST_BYTES`` of text: then the
documents are scanned once and nothing is shuffled.  A larger benchmark is joined with the documents on
seeds, and texts follow only for candidate pairs.

Defined cases: null texts match nothing; rows with a null id are in no result, but ``clean`` judges every row by its own
text; an item shorter than ``min_match`` words can't be told from chance and matches nothing; items with a null id are
left out of results yet still clean; of rows that repeat an id the best coverage counts; extra columns
pass through ``clean`` and are ignored elsewhere; without documents or items nothing is found.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import documents_only, keyed, lean, written
from docquarry.llm.tokens import U64, Words, grams, slices

MIN_MATCH = 5
COVERAGE = 0.5
BROADCAST_BYTES = 8 << 20
_BITS = 22
_MOD = (1 << 61) - 1
_RADIX = 1_000_003


def _windows(words: Sequence[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of every window of ``length`` unmarked words."""
    lead = pow(_RADIX, length - 1, _MOD)
    value = run = 0
    for i, word in enumerate(words):
        if marked[i]:
            value = run = 0
            continue
        if run == length:
            value = (value - words[i - length] * lead) % _MOD
            run -= 1
        value = (value * _RADIX + word) % _MOD
        run += 1
        if run == length:
            yield i - length + 1, value


def greedy_tiles(pattern: Sequence[int], text: Sequence[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles ``(pattern start, text start, length)``; of equal lengths the earliest in the pattern, then in the text."""
    pattern_marked, text_marked = [False] * len(pattern), [False] * len(text)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(pattern), len(text))
    while length >= min_match:
        table = defaultdict(list)
        for at, value in _windows(text, text_marked, length):
            table[value].append(at)
        found = []
        for p, value in _windows(pattern, pattern_marked, length):
            for t in table.get(value, ()):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not pattern_marked[p + n] and not text_marked[t + n]:
                    n += 1
                if n >= length:
                    found.append((-n, p, t))
        # A match that earlier tiles cut goes back on the heap in pieces, so the longest is always next.
        heapq.heapify(found)
        while found:
            n, p, t = heapq.heappop(found)
            pieces, start = [], None
            for k in range(-n + 1):
                if k < -n and not pattern_marked[p + k] and not text_marked[t + k]:
                    start = k if start is None else start
                elif start is not None:
                    pieces.append((start, k))
                    start = None
            if pieces == [(0, -n)]:
                pattern_marked[p : p - n] = [True] * -n
                text_marked[t : t - n] = [True] * -n
                tiles.append((p, t, -n))
            else:
                for x, y in pieces:
                    if y - x >= length:
                        heapq.heappush(found, (x - y, p + x, t + x))
        if length == min_match:
            break
        length = max(min_match, length // 2)
    return tiles


@dataclass(frozen=True)
class Seeds:
    """The benchmark's seeds: sorted hashes with their item, and a bitmap that rules most hashes out."""

    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray
    present: np.ndarray
    words: list[list[int]]
    ids: list[int | None]
    min_match: int

    @staticmethod
    def of(ids: list[int | None], texts: pa.Array, min_match: int) -> Seeds:
        words = Words(texts)
        hashes, at = grams(words.hashes, words.row, min_match)
        item = np.searchsorted(words.row, at, "right") - 1
        long = np.diff(words.row)[item] >= min_match
        hashes, at, item = hashes[long], at[long], item[long]
        order = np.argsort(hashes, kind="stable")
        present = np.zeros(1 << _BITS, bool)
        present[(hashes >> U64(64 - _BITS)).astype(np.int64)] = True
        lists = [[int(h) % _MOD for h in words.hashes[a:b]] for a, b in zip(words.row[:-1], words.row[1:], strict=True)]
        return Seeds(hashes[order], item[order], (at - words.row[item])[order], present, lists, ids, min_match)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``hashes``, index of the seed) of every match."""
        maybe = np.flatnonzero(self.present[(hashes >> U64(64 - _BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, hashes[maybe], "left"), np.searchsorted(self.hashes, hashes[maybe], "right")
        n = high - low
        first = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n)
        return np.repeat(maybe, n), first + np.arange(n.sum())


def covered(item_words: list[int], doc_words: np.ndarray, starts: np.ndarray, min_match: int) -> int:
    """Item words under tiles, given where in the document seeds shared with the item start."""
    inside = np.zeros(len(doc_words), bool)
    for k in range(min_match):
        inside[starts + k] = True
    at = np.flatnonzero(inside)
    text: list[int] = []
    for i, p in enumerate(at):
        if i and p != at[i - 1] + 1:
            text.append(-1 - i)  # a break that equals no word
        text.append(int(doc_words[p]) % _MOD)
    return sum(n for _, _, n in greedy_tiles(item_words, text, min_match))


def matches(texts: pa.Array, seeds: Seeds, coverage: float) -> Iterator[tuple[int, int, int]]:
    """(row, item, covered words) of every pair that reaches the coverage."""
    k = seeds.min_match
    if len(seeds.hashes) == 0:
        return
    for a, b in slices(texts):
        words = Words(texts.slice(a, b - a))
        hashes, at = grams(words.hashes, words.row, k)
        index, seed = seeds.hits(hashes)
        row = np.searchsorted(words.row, at[index], "right") - 1
        long = np.diff(words.row)[row] >= k
        row, start, seed = row[long], at[index][long], seed[long]
        pair = row * len(seeds.words) + seeds.item[seed]
        order = np.argsort(pair, kind="stable")
        row, start, seed, pair = row[order], start[order], seed[order], pair[order]
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, int)
        for s, e in zip(edge, np.append(edge, len(pair))[1:], strict=True):
            item = int(seeds.item[seed[s]])
            item_words = seeds.words[item]
            reach = np.zeros(len(item_words), bool)
            for j in range(k):
                reach[seeds.position[seed[s:e]] + j] = True
            if reach.sum() < coverage * len(item_words):
                continue
            r = int(row[s])
            n = covered(item_words, words.hashes[words.row[r] : words.row[r + 1]], np.unique(start[s:e]) - words.row[r], k)
            if n >= coverage * len(item_words):
                yield a + r, item, n


def _small(items: DataFrame) -> pa.Table | None:
    """The benchmark, if it is small enough to travel."""
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    return items.toArrow() if (size["bytes"] or 0) + 64 * size["rows"] <= BROADCAST_BYTES else None


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


_RESULT = "doc_id long, item_id long, covered_words int, item_words int, coverage double"


def _rows(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    doc, item, n, of = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(n, pa.int32()), pa.array(of, pa.int32()), pa.array([x / y for x, y in zip(n, of, strict=True)])],
        names=["doc_id", "item_id", "covered_words", "item_words", "coverage"],
    )


def contamination(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """One row for each document and item of which tiles cover ``coverage`` of the item or more."""
    docs, items = documents_only(docs).where("doc_id is not null and text is not null"), _items(items).where("item_id is not null")
    small = _small(items)
    if small is None:
        found = _joined(docs, items, coverage, min_match)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(Seeds.of(small["item_id"].to_pylist(), small["text"].combine_chunks(), min_match))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                if out := [(ids[r].as_py(), seeds.ids[i], n, len(seeds.words[i])) for r, i, n in matches(batch.column("text"), seeds, coverage)]:
                    yield _rows(out)

        found = docs.mapInArrow(lean(apply), _RESULT)
    best = F.max(F.struct("coverage", "covered_words", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.covered_words", "best.item_words", F.round("best.coverage", 6).alias("coverage"))


def _joined(docs: DataFrame, items: DataFrame, coverage: float, min_match: int) -> DataFrame:
    """The same for a benchmark of any size: candidates by a join on seeds, then texts for candidates alone."""

    def seed_rows(id_column: str):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column("text")):
                    words = Words(batch.column("text").slice(a, b - a))
                    hashes, at = grams(words.hashes, words.row, min_match)
                    row = np.searchsorted(words.row, at, "right") - 1
                    long = np.diff(words.row)[row] >= min_match
                    ids = batch.column(id_column).slice(a, b - a).take(pa.array(row[long]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(hashes[long].astype(np.int64))], names=[id_column, "seed"])

        return apply

    seeds = items.mapInArrow(lean(seed_rows("item_id")), "item_id long, seed long").distinct()
    pairs = docs.mapInArrow(lean(seed_rows("doc_id")), "doc_id long, seed long").distinct().join(seeds, "seed").select("doc_id", "item_id").distinct()
    work = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                seeds = Seeds.of([batch.column("item_id")[r].as_py()], batch.column("item_text").slice(r, 1), min_match)
                out += [(batch.column("doc_id")[r].as_py(), seeds.ids[i], n, len(seeds.words[i])) for _, i, n in matches(batch.column("text").slice(r, 1), seeds, coverage)]
            if out:
                yield _rows(out)

    return work.mapInArrow(lean(tile), _RESULT)


def clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns as they were.

    Every row is judged by its own text, rows of a null id or of an id that repeats included, for benchmarks of any size.
    """
    items = _items(items)
    small = _small(items)
    if small is None:
        docs, key = keyed(docs, "rows")
        items = written(items.withColumn("item_id", F.monotonically_increasing_id()), "items")
        found = contamination(docs.select(F.col(key).alias("doc_id"), "text"), items, coverage, min_match)
        return docs.join(found.select(F.col("doc_id").alias("_found")).distinct(), docs[key] == F.col("_found"), "left_anti").drop(key)
    shared = docs.sparkSession.sparkContext.broadcast(Seeds.of(small["item_id"].to_pylist(), small["text"].combine_chunks(), min_match))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for r, _, _ in matches(batch.column("text"), seeds, coverage):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(apply), docs.schema)
