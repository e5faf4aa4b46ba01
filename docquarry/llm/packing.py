"""Mixture-controlled packing: deficit round-robin over source queues.

Documents queue by source.  Every window of ``window`` tokens gives each source credit for its target
share of the window; sources are visited in turn and served while their credit lasts, and what a source
is owed, or was served too much, stays with it as a deficit.  A service is a piece of at least
``piece`` tokens (or a document's end), so after any number of windows each source is within ``piece``
tokens of its target for as long as its queue and the others hold documents.  Tokens are runs of
non-space characters; pieces keep the white space, and together they are the documents again.

Lanes spread this over the cluster: a lane is a set of queues of about ``lane_bytes`` of text that one
task packs.  At the target shares the corpus has a *schedule*: how many tokens of each source the first g tokens hold.  With
``r`` the tokens per unit of share, source s has given ``min(n_s, share_s r)``, so once a source is used up the
others go on at their shares; sources without a share follow when those with one are used up.  Documents go to lanes by their
place in the schedule, hash bucket by hash bucket, so each lane holds its part of every source up to a
bucket.  The deficit a lane starts with is known without packing those before it: what the schedule gives to the source in
the tokens of all earlier lanes, less the source's tokens in these, both prefix sums.  It is repaid evenly over the
lane.  Prefix sums are taken in two levels, so that no task sorts all buckets of a source.  Texts are shuffled once, to
their lane.

Defined cases: a null source is a queue of its own; texts that are null or without a token are in no
window; rows with a null id are packed and listed as null; repeated rows are packed each; a document
longer than a window goes on in the next; the last window of a lane may be short; extra columns are
ignored.  A target share of zero or of a source without documents is passed over, and sources without a
target share the windows left when all others are empty; a negative or NaN share is an error; an empty table has no window.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import release, small_batches, written
from docquarry.llm.tokens import runs, string_buffers

WINDOW = 2048
PIECE = 256
LANE_BYTES = 7 << 20
BUCKETS_A_LANE = 16
#: Tasks that pack at most; up to there a task has eight lanes or fewer.
MOST_TASKS = 200_000
#: Buckets or lanes of the upper level of a prefix sum.
LEVEL = 4096
#: Rows of the bucket table that are broadcast at most (about 50 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n\f\v")] = True

Piece = tuple[int, int, int]


def round_robin(queues: list[list[tuple[int, int]]], shares: list[float], carried: list[float], window: int = WINDOW, piece: int = PIECE) -> Iterator[tuple[list[Piece], list[float]]]:
    """Windows of pieces ``(document, first token, end token)``, with every source's deficit after each.

    ``queues`` hold (document, tokens) by source; ``carried`` is spread over the windows.
    """
    waiting = [deque((d, 0, n) for d, n in q if n > 0) for q in queues]
    left = [sum(n for _, n in q) for q in queues]
    windows = -(-sum(left) // window)
    extra = [c / windows if windows else 0.0 for c in carried]
    deficit = [0.0] * len(queues)
    turn = 0
    while any(waiting):
        live = [s for s in range(len(queues)) if waiting[s]]
        space = min(window, sum(left))
        weight = sum(shares[s] for s in live)
        for s in range(len(queues)):
            deficit[s] = 0.0 if not waiting[s] else deficit[s] + extra[s] + (shares[s] / weight if weight > 0 else 1 / len(live)) * space
        out: list[Piece] = []

        def serve(s: int, most: int, out: list[Piece] = out) -> int:
            """Up to ``most`` tokens of a source's first document."""
            d, a, end = waiting[s][0]
            n = min(end - a, most)
            out.append((d, a, a + n))
            deficit[s] -= n
            left[s] -= n
            waiting[s][0] = (d, a + n, end)
            if a + n == end:
                waiting[s].popleft()
            return n

        idle = 0
        while space:
            if idle == len(queues):  # nobody has credit for a piece: the one that is owed most advances
                space -= serve(max((s for s in live if waiting[s]), key=lambda s: (deficit[s], -s)), min(piece, space))
                idle = 0
                continue
            turn = (turn + 1) % len(queues)
            idle += 1
            while space and waiting[turn] and deficit[turn] >= min(piece, waiting[turn][0][2] - waiting[turn][0][1]):
                space -= serve(turn, min(int(deficit[turn]), space))
                idle = 0
        yield out, list(deficit)


_PIECE_TYPE = pa.struct([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
_SCHEMA = "lane long, window long, n_tokens int, doc_ids array<long>, pieces array<struct<doc_id:long,source:string,start:int,end:int,text:string>>, deficits array<struct<source:string,deficit:double>>"


def _pack_lane(window: int, piece: int):
    def apply(docs: pa.Table, plan: pa.Table) -> pa.Table:
        lane = plan["lane"][0].as_py() if plan.num_rows else docs["lane"][0].as_py()
        docs = docs.sort_by([("rank", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        names = sorted(plan["source"].to_pylist(), key=lambda s: (s is None, s or ""))
        place = {s: i for i, s in enumerate(names)}
        told = {s: (p, c) for s, p, c in zip(plan["source"].to_pylist(), plan["share"].to_pylist(), plan["carried"].to_pylist(), strict=True)}
        ids, sources = docs["doc_id"].to_pylist(), docs["source"].to_pylist()
        data, offsets = string_buffers(docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.string()))
        starts, _ = runs(~_SPACE[data], offsets)
        edge = np.searchsorted(starts, offsets)
        queues: list[list[tuple[int, int]]] = [[] for _ in names]
        for d, s in enumerate(sources):
            queues[place[s]].append((d, int(edge[d + 1] - edge[d])))
        raw = data.tobytes()

        def text(d: int, a: int, b: int) -> str:
            first = offsets[d] if a == 0 else starts[edge[d] + a]
            last = offsets[d + 1] if b == edge[d + 1] - edge[d] else starts[edge[d] + b]
            return raw[first:last].decode("utf-8", "replace")

        rows = []
        for k, (pieces, deficit) in enumerate(round_robin(queues, [told[s][0] for s in names], [told[s][1] for s in names], window, piece)):
            rows.append(
                {
                    "lane": lane,
                    "window": k,
                    "n_tokens": sum(b - a for _, a, b in pieces),
                    "doc_ids": list(dict.fromkeys(ids[d] for d, _, _ in pieces)),
                    "pieces": [{"doc_id": ids[d], "source": sources[d], "start": a, "end": b, "text": text(d, a, b)} for d, a, b in pieces],
                    "deficits": [{"source": s, "deficit": round(x, 6)} for s, x in zip(names, deficit, strict=True)],
                }
            )
        schema = pa.schema([("lane", pa.int64()), ("window", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(_PIECE_TYPE)), ("deficits", pa.list_(pa.struct([("source", pa.string()), ("deficit", pa.float64())])))])
        packed = pa.Table.from_pylist(rows, schema)
        del rows, raw, data
        release()
        return packed

    return apply


def earlier(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``df`` with ``_before``, the sum of ``value`` over the rows of the same keys and a lesser ``at``, in two levels."""
    df = df.withColumn("_level", F.floor(F.col(at) / LEVEL))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_level").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    above = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_level").rowsBetween(Window.unboundedPreceding, -1))
    levels = df.groupBy(*keys, "_level").agg(F.sum(value).alias("_sum")).withColumn("_above", above).drop("_sum")
    total = F.coalesce(inside, F.lit(0)) + F.coalesce("_above", F.lit(0))
    return df.join(levels, [*keys, "_level"]).withColumn("_before", total).drop("_level", "_above")


class Schedule:
    """How many tokens of each source the first tokens of the corpus hold, at target shares of a few named sources."""

    def __init__(self, sizes: dict[str, int], shares: dict[str, float], rest: int):
        """``sizes``: tokens of the sources with a share; ``rest``: of all others."""
        whole = sum(shares[s] for s in sizes)
        self.share = {s: shares[s] / whole for s in sizes}
        self.sizes, self.named, self.rest = sizes, sum(sizes.values()), rest

    def _of(self, source: Column, values: dict[str, float]) -> Column:
        """A source's value, null for sources without a share."""
        return F.element_at(F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, float(v))]), source) if values else F.lit(None).cast("double")

    def share_of(self, source: Column) -> Column:
        return F.coalesce(self._of(source, self.share), F.lit(0.0))

    def place(self, source: Column, tokens: Column, n: Column) -> Column:
        """Where in the schedule a source of ``n`` tokens has given ``tokens``."""
        r = tokens / self._of(source, self.share)
        named = sum((F.least(F.lit(float(self.sizes[s])), r * x) for s, x in self.share.items()), F.lit(0.0))
        return F.when(r.isNotNull(), named).otherwise(self.named + tokens * self.rest / n)

    def given(self, source: Column, n: Column, at: Column) -> Column:
        """How much a source of ``n`` tokens has given in the first ``at`` tokens."""
        r, full, left = F.lit(0.0), 0.0, 1.0
        ends = sorted(self.share, key=lambda s: self.sizes[s] / self.share[s])
        cases = None
        for s in ends:  # up to where this source is used up, G(r) = full + left * r
            top = full + left * self.sizes[s] / self.share[s]
            piece = (at - full) / left
            cases = F.when(at <= top, piece) if cases is None else cases.when(at <= top, piece)
            full, left = full + self.sizes[s], max(left - self.share[s], 1e-12)
        r = F.lit(0.0) if cases is None else cases.otherwise(F.lit(float("inf")))
        named = F.least(n.cast("double"), self._of(source, self.share) * r)
        return F.when(self._of(source, self.share).isNotNull(), named).otherwise(F.greatest(F.lit(0.0), at - self.named) * n / max(1, self.rest))


def pack(docs: DataFrame, shares: dict[str, float] | None = None, window: int = WINDOW, piece: int = PIECE, lane_bytes: int = LANE_BYTES) -> DataFrame:
    """Windows ``(lane, window, n_tokens, doc_ids, pieces, deficits)``; ``shares`` default to the corpus's own."""
    if any(not 0 <= w < math.inf for w in (shares or {}).values()):
        raise ValueError("a share is a number of zero or more")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    docs = docs.where("text is not null").withColumn("rank", F.xxhash64("doc_id", "text"))
    lanes = max(1, round((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / lane_bytes))
    docs = docs.withColumn("bucket", F.pmod("rank", F.lit(lanes * BUCKETS_A_LANE))).withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    sums = docs.groupBy("queue", "source", "bucket").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).where("n > 0")
    sums = written(sums, "sums")  # counted once
    sums = written(earlier(sums, ["queue"], "bucket", "n").withColumn("middle", F.col("_before") + F.col("n") / 2), "buckets")
    sizes = written(sums.groupBy("queue", "source").agg(F.sum("n").alias("all")), "queues")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    if shares is None:
        plan = None
        place, share = F.col("middle") * total / F.col("all"), F.col("all") / F.lit(max(1, total))
    else:
        wanted = [s for s, w in shares.items() if w > 0]
        named = {r["source"]: r["all"] for r in sizes.where(F.col("source").isin(wanted)).collect()}
        plan = Schedule(named, shares, total - sum(named.values()))
        place, share = plan.place(F.col("source"), F.col("middle"), F.col("all")), plan.share_of(F.col("source"))
    lane = F.least(F.floor(place * lanes / max(1, total)), F.lit(lanes - 1)).cast("long")
    sums = written(sums.join(sizes.select("queue", "all"), "queue").select("queue", "source", "bucket", "n", "all", lane.alias("lane"), share.alias("share")), "placed")

    here = sums.groupBy("lane", "queue", "source", "all", "share").agg(F.sum("n").alias("n"))
    starts = earlier(here.groupBy("lane").agg(F.sum("n").alias("lane_n")).withColumn("one", F.lit(0)), ["one"], "lane", "lane_n").select("lane", F.col("_before").alias("start"))
    here = earlier(here, ["queue"], "lane", "n").join(starts, "lane")
    due = F.col("share") * F.col("start") if plan is None else plan.given(F.col("source"), F.col("all"), F.col("start"))
    lots = written(here.select("lane", "source", "share", (due - F.col("_before")).alias("carried")), "lanes")

    lane_of = sums.select(F.col("queue").alias("_queue"), F.col("bucket").alias("_bucket"), "lane")
    if sums.count() <= BROADCAST_ROWS:
        lane_of = F.broadcast(lane_of)
    placed = docs.join(lane_of, (F.col("queue") == F.col("_queue")) & (F.col("bucket") == F.col("_bucket"))).select("lane", "rank", "doc_id", "source", "text")
    tasks = min(MOST_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), lanes // 8))
    placed, lots = placed.repartition(tasks, "lane"), lots.repartition(tasks, "lane")
    return placed.groupBy("lane").cogroup(lots.groupBy("lane")).applyInArrow(_pack_lane(window, piece), _SCHEMA)
