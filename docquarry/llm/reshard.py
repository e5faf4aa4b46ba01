"""Resharding by minimum-cost flow: the fewest bytes move, and only files that lose rows are rewritten.

Shards are files, blocks runs of ``BLOCK_ROWS`` rows of a file.  From the old shards' bytes and the new
capacities a flow network decides how many bytes go where: bytes that stay cost nothing, bytes that
move cost one each.  Instead of an edge for each pair of shards, movers pass a hub, so the network grows with
the number of shards, and the primal-dual solver needs one blocking flow for each distinct path cost.

Flows become blocks without another search: a donor gives blocks from its end until its outflow is met, and the
receivers' intervals are laid along that sequence.  Capacities are lowered by two blocks first, where
the total allows, so rounding to blocks stays within them.

Rows that move are the only ones shuffled.  Donors are rewritten without them, receivers get the rows as a further
file, and shards that keep all of theirs stay as they are.

Defined cases: an empty table has no shards and no rows; null texts weigh nothing but their row; rows may repeat and
ids may be null, rows are told apart by place; capacities below the total bytes are an error; new shards may
be more or fewer than the old ones, shard k keeping the place of old file k in order of names; extra columns are kept,
columns named as an added one are not.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import shared_dir, written

BLOCK_ROWS = 128
TARGET_BYTES = 64 << 20
SLACK = 0.02
ROW_BYTES = 32
#: Moves (one for each donor and receiver) and files broadcast at most, 20 MB with paths of 200 bytes; beyond, they are joined by shuffle.
BROADCAST_MOVES = 100_000
ADDED = ["old_shard", "new_shard", "moved"]


class MinCostFlow:
    """Primal-dual minimum-cost maximum flow: shortest distances, then a blocking flow on tight edges."""

    def __init__(self, nodes: int):
        self.head: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow_on(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def _distances(self, source: int) -> list[float]:
        """Shortest distances over edges with room (Bellman-Ford with a queue; residual costs may be negative)."""
        far = [float("inf")] * len(self.head)
        far[source] = 0
        queue, waiting = deque([source]), [False] * len(self.head)
        while queue:
            a = queue.popleft()
            waiting[a] = False
            for e in self.head[a]:
                if self.room[e] > 0 and far[a] + self.cost[e] < far[self.to[e]]:
                    far[self.to[e]] = far[a] + self.cost[e]
                    if not waiting[self.to[e]]:
                        waiting[self.to[e]] = True
                        queue.append(self.to[e])
        return far

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost)."""
        flow = cost = 0
        while True:
            far = self._distances(source)
            if far[sink] == float("inf"):
                return flow, cost
            # Tight edges may form cycles of cost zero; levels among them keep every path short and the search finite.
            while True:
                level = [-1] * len(self.head)
                level[source] = 0
                queue = deque([source])
                while queue:
                    a = queue.popleft()
                    for e in self.head[a]:
                        b = self.to[e]
                        if self.room[e] > 0 and level[b] < 0 and far[a] + self.cost[e] == far[b]:
                            level[b] = level[a] + 1
                            queue.append(b)
                if level[sink] < 0:
                    break
                current, path, a = [0] * len(self.head), [], source
                while True:
                    if a == sink:
                        n = min(self.room[e] for e in path)
                        for e in path:
                            self.room[e] -= n
                            self.room[e ^ 1] += n
                        flow, cost = flow + n, cost + n * int(far[sink])
                        path, a = [], source
                        continue
                    while current[a] < len(self.head[a]):
                        e = self.head[a][current[a]]
                        b = self.to[e]
                        if self.room[e] > 0 and level[b] == level[a] + 1 and far[a] + self.cost[e] == far[b]:
                            break
                        current[a] += 1
                    if current[a] < len(self.head[a]):
                        path.append(self.head[a][current[a]])
                        a = self.to[path[-1]]
                    elif path:
                        a = self.to[path.pop() ^ 1]
                        current[a] += 1
                    else:
                        break


@dataclass(frozen=True)
class Move:
    """Bytes ``[low, high)`` of what ``donor`` gives go to ``receiver``."""

    donor: int
    receiver: int
    low: int
    high: int


def transfers(sizes: list[int], capacities: list[int]) -> list[Move]:
    """Moves of the fewest bytes that bring shards of ``sizes`` within ``capacities``."""
    if sum(sizes) > sum(capacities):
        raise ValueError("the capacities hold fewer bytes than there are")
    old, new = len(sizes), len(capacities)
    net = MinCostFlow(old + new + 3)
    source, sink, hub = old + new, old + new + 1, old + new + 2
    given, got = [], []
    for i, n in enumerate(sizes):
        net.edge(source, i, n)
        if i < new:
            net.edge(i, old + i, n)
        given.append(net.edge(i, hub, n, 1))
    for j, n in enumerate(capacities):
        got.append(net.edge(hub, old + j, n))
        net.edge(old + j, sink, n)
    net.run(source, sink)
    out, receivers = [], deque((j, net.flow_on(e)) for j, e in enumerate(got) if net.flow_on(e))
    for i, e in enumerate(given):
        low, n = 0, net.flow_on(e)
        while n:
            j, room = receivers[0]
            take = min(n, room)
            out.append(Move(i, j, low, low + take))
            low, n = low + take, n - take
            if take == room:
                receivers.popleft()
            else:
                receivers[0] = (j, room - take)
    return out


def new_capacities(sizes: list[int], largest_block: int, target_bytes: int = TARGET_BYTES, slack: float = SLACK, count: int | None = None) -> list[int]:
    """Equal capacities for ``count`` shards, or as many as the target asks for."""
    count = count or max(1, -(-sum(sizes) // target_bytes))
    return [int(sum(sizes) / count * (1 + slack)) + 2 * largest_block + 1] * count


def _free(names: list[str], columns: list[str]) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def reshard(spark: SparkSession, path: str, capacities: list[int] | None = None, target_bytes: int = TARGET_BYTES, block_rows: int = BLOCK_ROWS, count: int | None = None) -> DataFrame:
    """The table of Parquet files at ``path`` in its new shards, with ``old_shard``, ``new_shard`` and ``moved``."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c.lower() not in ADDED]
    file, block, donor, first, last = _free(["_path", "_block", "_from", "_first", "_last"], kept)
    place = lambda df: (df.metadataColumn("_metadata")["file_path"].alias(file), F.floor(df.metadataColumn("_metadata")["row_index"] / block_rows).alias(block))
    at = rows.select(*kept, *place(rows))
    weight = row_weight() if "text" in kept else F.lit(ROW_BYTES)
    blocks = written(at.groupBy(file, block).agg(F.sum(weight).alias("bytes")), "blocks")
    files = blocks.groupBy(file).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")).orderBy(file).collect()
    if not files:
        return rows.select(*kept).select("*", F.lit(0).alias("old_shard"), F.lit(0).alias("new_shard"), F.lit(False).alias("moved"))
    names, sizes, largest = [f[file] for f in files], [int(f["bytes"]) for f in files], max(int(f["largest"]) for f in files)
    limits = capacities or new_capacities(sizes, largest, target_bytes, count=count)
    inner = [max(0, c - 2 * largest) for c in limits]
    moves = transfers(sizes, inner if sum(inner) >= sum(sizes) else limits)

    shards = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{file} string, old_shard int")
    ways = spark.createDataFrame([(names[m.donor], m.receiver, m.low, m.high) for m in moves], f"{file} string, new_shard int, low long, high long")
    from_end = Window.partitionBy(file).orderBy(F.desc(block))
    placed = blocks.withColumn("middle", F.sum("bytes").over(from_end) - F.col("bytes") / 2)
    runs = placed.join(ways, file).where("middle >= low and middle < high").groupBy(file, "new_shard").agg(F.min(block).alias(first), F.max(block).alias(last))
    plan = written(runs.select(F.col(file).alias(donor), "new_shard", first, last), "moves")
    if len(moves) + len(names) <= BROADCAST_MOVES:
        plan, shards = F.broadcast(plan), F.broadcast(shards)

    out = shared_dir(spark, "shards")
    goes = (F.col(file) == F.col(donor)) & F.col(block).between(F.col(first), F.col(last))
    moving = at.join(plan, goes).join(shards, file).select(*kept, "old_shard", "new_shard")
    moving.repartition("new_shard").write.partitionBy("new_shard").parquet(f"{out}/moved")
    donors = {m.donor for m in moves}
    parts = [spark.read.parquet(f"{out}/moved").select(*kept, "old_shard", F.col("new_shard").cast("int").alias("new_shard"), F.lit(True).alias("moved"))] if moves else []
    if donors:
        own = [names[i] for i in sorted(donors)]
        staying = spark.read.parquet(*own)
        staying = staying.select(*kept, *place(staying))
        staying = staying.join(plan, goes, "left_anti").join(shards, file).select(*kept, "old_shard")
        staying.write.partitionBy("old_shard").parquet(f"{out}/kept")
        again = spark.read.schema(staying.schema).parquet(f"{out}/kept")
        parts.append(again.select(*kept, "old_shard", F.col("old_shard").alias("new_shard"), F.lit(False).alias("moved")))
    whole = [n for i, n in enumerate(names) if i not in donors]
    if whole:
        same = spark.read.parquet(*whole)
        same = same.select(*kept, place(same)[0]).join(shards, file)
        parts.append(same.select(*kept, "old_shard", F.col("old_shard").alias("new_shard"), F.lit(False).alias("moved")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def row_weight(text: str = "text") -> F.Column:
    """Bytes that a row counts for."""
    return F.lit(ROW_BYTES) + F.coalesce(F.octet_length(text), F.lit(0))


def uneven_shards(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> tuple[str, int]:
    """Write ``docs`` as shards of about 1, 2, 3 and 4 parts in ten of four targets, and so on; returns their folder and number.

    A row's shard follows from its id, and rows lie in a shard by id and text, so the same table gives the same shards.
    """
    groups = max(1, math.ceil((docs.agg(F.sum(row_weight())).first()[0] or 0) / (4 * target_bytes)))
    part = F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(10 * groups)), F.lit(0))
    digit = part % 10
    shard = F.floor(part / 10) * 4 + F.when(digit < 1, 0).when(digit < 3, 1).when(digit < 6, 2).otherwise(3)
    path = shared_dir(docs.sparkSession, "uneven")
    placed = docs.drop("old_shard").withColumn("old_shard", F.format_string("%06d", shard.cast("int")))
    placed.repartition("old_shard").sortWithinPartitions("old_shard", "doc_id", "text").write.partitionBy("old_shard").parquet(path)
    return path, 4 * groups


def evened(docs: DataFrame, block_rows: int = 16, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``docs`` from uneven shards in one more, equal ones."""
    path, count = uneven_shards(docs, target_bytes)
    return reshard(docs.sparkSession, path, target_bytes=target_bytes, block_rows=block_rows, count=count + 1)


#: The same by the closed form: what is beyond a capacity goes, donors and receivers in order.
ORACLE_SQL = f"""
with d as (select doc_id, text, {ROW_BYTES} + coalesce(strlen(text), 0) as w from documents),
t as (select sum(w) as total, greatest(1, ceil(sum(w) / (4.0 * {TARGET_BYTES})))::int as m from d),
p as (select doc_id, text, w, r // 10 * 4 + case when r % 10 < 1 then 0 when r % 10 < 3 then 1 when r % 10 < 6 then 2 else 3 end as k
  from (select d.*, coalesce((doc_id % (10 * m) + 10 * m) % (10 * m), 0) as r from d, t)),
s as (select *, (dense_rank() over (order by k) - 1)::int as old_shard,
  (row_number() over (partition by k order by doc_id nulls first, text nulls first) - 1) // 16 as block from p),
b as (select old_shard, block, sum(w) as bytes from s group by all),
c as (select 4 * m + 1 as n, floor(total::double / (4 * m + 1) * 1.02::double)::bigint + 1 as cap from t),
shards as (select j, coalesce(size, 0) as size, cap, least(coalesce(size, 0), cap) as stay
  from (select unnest(range(n)) as j, cap from c) left join (select old_shard as j, sum(bytes) as size from b group by 1) using (j)),
give as (select j as i, size - stay as n, sum(size - stay) over (order by j) - (size - stay) as start from shards),
room as (select j, cap - stay as n, sum(cap - stay) over (order by j) - (cap - stay) as start from shards),
moves as (select i, j, greatest(g.start, r.start) - g.start as low, least(g.start + g.n, r.start + r.n) - g.start as high
  from give g join room r on greatest(g.start, r.start) < least(g.start + g.n, r.start + r.n)),
placed as (select old_shard, block, sum(bytes) over (partition by old_shard order by block desc) - bytes / 2.0::double as middle from b),
goes as (select old_shard, block, j from placed join moves on i = old_shard and middle >= low and middle < high)
select doc_id, old_shard, coalesce(j, old_shard)::int as new_shard, j is not null as moved, length(text)::int as n_chars
from s left join goes using (old_shard, block)
"""
