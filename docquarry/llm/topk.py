"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments; with mean m and deviation s of each, a segment of length L contributes at least
``L * ((m - m')^2 + (s - s')^2)`` to a squared distance, because a segment's distance is that of the means plus that of
the centred parts.  Finer segments give tighter bounds.  Queries are the rows whose id is divisible by ``every``, searched
for among all rows: pairs are bounded with one segment, then four, then sixteen, those that could still enter a query's
k nearest go on, and survivors get their exact distance.

Rows are grouped into cells by medians of coarse statistics, so near rows share a cell, and cells are cut into blocks
of about ``block_rows``.  A query first searches its own block, which gives it a radius; the boxes of the cells' finest
statistics, of which there are ``2 ** SPLITS`` at most for a length, then say which cells can hold nearer rows, and the
query alone travels to the blocks of these.  A block is held by one task and its queries stream past it, so every
vector is shuffled once for the search whatever the number of queries.  The search is exact whatever the
blocks; they only decide how much is skipped.  Where no box excludes a cell, as for vectors without any structure, each
query meets each block, and the segment statistics are the only saving.

Defined cases: rows with a null id or vector, or a null, NaN or infinite element, are left out; only vectors of one
length are compared; repeated ids are one query each and not their own neighbours by row, so copies are found at distance
zero; ties go to the lower id; with fewer than k others all are listed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import written

TOP = 10
LEVELS = (1, 4, 16)
#: Queries are the rows whose id it divides.
EVERY = 100
#: Rows of a block, at least and at most; between, a 64th of all.
BLOCK_ROWS = (2048, 32768)
#: Halvings of coarse coordinates at most; a cell that stays larger than a block is cut by row.
SPLITS = 12
#: Boxes broadcast at most (8 MB); vectors of very many lengths have more, which are joined by shuffle.
BROADCAST_BOXES = 16384
#: Queries bounded at once; a matrix of them and a block stays in cache.
QUERY_ROWS = 256
#: Share of pairs left above which a matrix product is cheaper than single pairs.
_DENSE = 0.02
_SLACK = 2e-5


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Segment means and deviations, scaled so that squared differences add up to the bound."""
    edge = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    parts = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = vectors[:, a:b]
        parts += [own.mean(1) * np.sqrt(b - a), own.std(1) * np.sqrt(b - a)]
    return np.stack(parts, 1)


def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of statistics, in single precision and a little too small for its errors."""
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    out = a @ b.T
    out *= -2
    size *= 1 - _SLACK
    out += size
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs up to rounding, in double precision."""
    out = a @ b.T
    out *= -2
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None, :]
    return out


class Nearest:
    """The k nearest so far of a block of queries; ties by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int, limit: np.ndarray | None = None):
        """``limit``: what the squared distance of the k-th is known not to exceed."""
        self.ids, self.rows, self.vectors, self.k = ids, rows, vectors, k
        self.limit = np.full(len(ids), np.inf) if limit is None else limit * (1 + 1e-12)
        self.levels = [statistics(vectors, s) for s in LEVELS]
        self.distance = np.full((len(ids), k), np.inf)
        self.neighbour = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.neighbour_row = np.full((len(ids), k), np.iinfo(np.int64).max)

    @property
    def radius(self) -> np.ndarray:
        return np.minimum(self.distance[:, -1], self.limit)

    def add(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, levels: list[np.ndarray] | None = None) -> int:
        """Search a block of data, whose statistics may be given; returns how many exact distances that took."""
        levels = levels or [statistics(vectors, s) for s in LEVELS]
        low, high = levels[-1].min(0), levels[-1].max(0)
        gap = np.maximum(low - self.levels[-1], 0) + np.maximum(self.levels[-1] - high, 0)
        reach = np.flatnonzero((gap * gap).sum(1) * (1 - _SLACK) <= self.radius)  # queries that the block's box lets in
        levels = [x.astype(np.float32) for x in levels]
        exact = 0
        for at in range(0, len(reach), QUERY_ROWS):
            exact += self._add(reach[at : at + QUERY_ROWS], ids, rows, vectors, levels)
        return exact

    def _add(self, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, levels: list[np.ndarray]) -> int:
        radius, mine = self.radius[own], self.vectors[own]
        if np.isinf(radius).any():  # nothing is known yet: the k-th of this block bounds it, the row itself aside
            table = distances(mine, vectors)
            if len(ids) > self.k:
                radius = np.minimum(radius, np.partition(table, self.k, axis=1)[:, self.k] + self._rounding(mine, vectors))
            q, d = np.nonzero(table <= radius[:, None] + self._rounding(mine, vectors)[:, None])
        else:
            q = d = None
            for stats, theirs in zip(self.levels, levels, strict=True):
                stats = stats[own].astype(np.float32)
                if q is None:
                    left = bounds(stats, theirs) <= radius[:, None].astype(np.float32) * (1 + 1e-6)
                    n = np.count_nonzero(left)
                    if n <= _DENSE * left.size:
                        q, d = np.nonzero(left)
                else:
                    gap = stats[q] - theirs[d]
                    keep = (gap * gap).sum(1) * (1 - _SLACK) <= radius[q] * (1 + 1e-6)
                    q, d = q[keep], d[keep]
                if q is not None and len(q) == 0:
                    return 0
            if q is None:
                table = distances(mine, vectors)
                left &= table <= (radius + self._rounding(mine, vectors))[:, None]
                q, d = np.nonzero(left)
        keep = self.rows[own[q]] != rows[d]
        q, d = own[q[keep]], d[keep]
        for at in range(0, len(q), 1 << 16):
            s = slice(at, at + (1 << 16))
            self._merge(q[s], ids[d[s]], rows[d[s]], self.vectors[q[s]] - vectors[d[s]])
        return len(q)

    @staticmethod
    def _rounding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """More than the error of ``distances``, for each row of ``a``."""
        return 1e-12 * ((a * a).sum(1) + (b * b).sum(1).max(initial=0.0)) + 1e-300

    def _merge(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, gap: np.ndarray) -> None:
        distance = np.einsum("ij,ij->i", gap, gap)
        keep = distance <= self.radius[q]
        q, ids, rows, distance = q[keep], ids[keep], rows[keep], distance[keep]
        if len(q) == 0:
            return
        touched, where = np.unique(q, return_inverse=True)
        owner = np.concatenate([where, np.repeat(np.arange(len(touched)), self.k)])
        all_d = np.concatenate([distance, self.distance[touched].reshape(-1)])
        all_n = np.concatenate([ids, self.neighbour[touched].reshape(-1)])
        all_r = np.concatenate([rows, self.neighbour_row[touched].reshape(-1)])
        order = np.lexsort((all_r, all_n, all_d, owner))
        first = np.searchsorted(owner[order], np.arange(len(touched)))
        best = order[(first[:, None] + np.arange(self.k)).reshape(-1)].reshape(len(touched), self.k)
        self.distance[touched], self.neighbour[touched], self.neighbour_row[touched] = all_d[best], all_n[best], all_r[best]


def _vectors(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def _blocked(vectors: DataFrame, id_col: str, vector_col: str, block_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, row, vector, length, cell, block)``: sound vectors in blocks; and ``(length, cell, shards, base)``: the blocks of each cell."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "array<float>" if single else "array<double>"  # single precision stays so in shuffles; all sums are double
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    rows = written(rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & sound).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("length")).count().collect()
    n = sum(r["count"] for r in lengths)
    block_rows = block_rows or min(max(n // 64, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    depth = min(SPLITS, max(0, int(np.ceil(np.log2(max(1, n / block_rows))))))

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            stats = np.zeros((batch.num_rows, 8))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(sizes):
                at = np.flatnonzero(sizes == length)
                own = statistics(_vectors(batch.take(pa.array(at))), 4)
                stats[at, : own.shape[1]] = own
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "row")), pa.FixedSizeListArray.from_arrays(pa.array(stats.reshape(-1)), 8).cast(pa.list_(pa.float64()))], names=["vec_id", "vector", "row", "stats"])

    rows = rows.mapInArrow(coarse, f"vec_id long, vector {kind}, row long, stats array<double>")
    cell = F.lit(0)
    if depth:
        # Coordinates of most spread are halved at their medians; a coordinate may be cut again in quarters.
        spread = rows.select(*[F.stddev(F.col("stats")[i]).alias(f"s{i}") for i in range(8)]).first()
        best = sorted(range(8), key=lambda i: -(spread[i] or 0))
        cuts = {i: depth // 8 + (1 if r < depth % 8 else 0) for r, i in enumerate(best)}
        used = [i for i in best if cuts[i]]
        points = rows.select(*[F.percentile_approx(F.col("stats")[i], [(j + 1) / (1 << cuts[i]) for j in range((1 << cuts[i]) - 1)], 1000).alias(f"p{i}") for i in used]).first()
        for i in used:
            part = F.lit(0)
            for value in points[f"p{i}"]:
                part = part + (F.col("stats")[i] > F.lit(float(value))).cast("int")
            cell = cell * (1 << cuts[i]) + part
    rows = written(rows.withColumn("cell", cell.cast("long")).withColumn("length", F.size("vector")).drop("stats"), "cells")
    crowd = rows.groupBy("length", "cell").count().withColumn("shards", F.ceil(F.col("count") / block_rows).cast("long"))
    crowd = crowd.withColumn("base", F.coalesce(F.expr("sum(shards) over (order by length, cell rows between unbounded preceding and 1 preceding)"), F.lit(0)))
    crowd = written(crowd.select("length", "cell", "shards", "base"), "crowd")
    block = (F.col("base") + F.pmod(F.xxhash64("row"), F.col("shards"))).alias("block")
    return written(rows.join(crowd, ["length", "cell"]).select("vec_id", "row", "vector", "length", "cell", block), "blocked"), crowd


def _own(k: int, every: int):
    """A block's box, and its queries with the squared distance of their k-th nearest in the block."""
    query = pa.struct([("vec_id", pa.int64()), ("row", pa.int64()), ("radius", pa.float64()), ("vector", pa.list_(pa.float64())), ("fine", pa.list_(pa.float64()))])

    def apply(part: pa.Table) -> pa.Table:
        vectors, rows, ids = _vectors(part), part["row"].to_numpy(), part["vec_id"].to_numpy()
        fine = statistics(vectors, LEVELS[-1])
        mine = np.flatnonzero(ids % every == 0)
        near = Nearest(ids[mine], rows[mine], vectors[mine], k)
        near.add(ids, rows, vectors)
        columns = (x.tolist() for x in (ids[mine], rows[mine], near.radius, vectors[mine], fine[mine]))
        queries = [dict(zip(("vec_id", "row", "radius", "vector", "fine"), q, strict=True)) for q in zip(*columns, strict=True)]
        return pa.table(
            {
                "length": pa.array([vectors.shape[1]], pa.int32()),
                "cell": pa.array([part["cell"][0].as_py()], pa.int64()),
                "low": pa.array([fine.min(0).tolist()], pa.list_(pa.float64())),
                "high": pa.array([fine.max(0).tolist()], pa.list_(pa.float64())),
                "queries": pa.array([queries], pa.list_(query)),
            }
        )

    return apply


_OWN = "length int, cell long, low array<double>, high array<double>, queries array<struct<vec_id:long,row:long,radius:double,vector:array<double>,fine:array<double>>>"
_FOUND = "row long, vec_id long, neighbour_id long, neighbour_row long, distance double"


def _search(k: int):
    """Rows sorted by block: its data, which are held, then the queries that come to it, a batch at a time."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, data = None, [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block, query = batch.column("block").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (query[1:] != query[:-1])]))
            for a, b in zip(edge, np.append(edge[1:], batch.num_rows), strict=True):
                if block[a] != at:
                    at, held, data = block[a], [], None
                part = batch.slice(a, b - a)
                if not query[a]:
                    held.append(part)
                    continue
                if data is None:
                    whole = pa.Table.from_batches(held)
                    vectors = _vectors(whole)
                    data = (whole["vec_id"].to_numpy(), whole["row"].to_numpy(), vectors, [statistics(vectors, s) for s in LEVELS])
                    held = []
                near = Nearest(part.column("vec_id").to_numpy(), part.column("row").to_numpy(), _vectors(part), k, part.column("radius").to_numpy())
                near.add(*data)
                q, rank = np.nonzero(np.isfinite(near.distance))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (near.rows[q], near.ids[q], near.neighbour[q, rank], near.neighbour_row[q, rank], near.distance[q, rank])],
                    names=["row", "vec_id", "neighbour_id", "neighbour_row", "distance"],
                )

    return apply


def nearest(vectors: DataFrame, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, block_rows: int | None = None) -> DataFrame:
    """``(vec_id, neighbour_id, rank, distance)``: exactly the k nearest other rows of every row whose id ``every`` divides."""
    rows, crowd = _blocked(vectors, id_col, vector_col, block_rows)
    own = written(rows.groupBy("block").applyInArrow(_own(k, every), _OWN), "own")
    corner = F.posexplode(F.arrays_zip("low", "high")).alias("at", "corner")
    boxes = own.select("length", "cell", corner).groupBy("length", "cell", "at").agg(F.min("corner.low").alias("low"), F.max("corner.high").alias("high"))
    boxes = written(boxes.groupBy("length", "cell").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box")).join(crowd, ["length", "cell"]), "boxes")
    queries = own.select("length", F.explode("queries").alias("q")).select("length", "q.*")
    gap = F.aggregate(F.zip_with("fine", "box", lambda x, b: F.greatest(F.lit(0.0), b["low"] - x, x - b["high"])), F.lit(0.0), lambda total, x: total + x * x)
    routes = queries.join(F.broadcast(boxes) if boxes.count() <= BROADCAST_BOXES else boxes, "length").where(gap * (1 - 1e-9) <= F.col("radius"))
    routes = routes.withColumn("block", F.explode(F.sequence("base", F.col("base") + F.col("shards") - 1)))
    kind = rows.schema["vector"].dataType
    data = rows.select("block", F.lit(False).alias("query"), "row", "vec_id", "vector", F.lit(None).cast("double").alias("radius"))
    work = data.unionByName(routes.select("block", F.lit(True).alias("query"), "row", "vec_id", F.col("vector").cast(kind).alias("vector"), "radius"))
    found = work.repartition("block").sortWithinPartitions("block", "query").mapInArrow(_search(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "neighbour_id", "neighbour_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", F.round(F.sqrt("distance"), 6).alias("distance"))


ORACLE_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null),
pairs as (
  select a.vec_id, b.vec_id as neighbour_id, list_distance(a.e, b.e) as d
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
ranked as (select *, row_number() over (partition by vec_id order by d, neighbour_id) as r from pairs)
select vec_id, neighbour_id, r::int as rank, round(d, 6) as distance from ranked where r <= 10
"""
