"""Chat formatting in budgeted windows.

A conversation's turns are ordered and their tokens (runs of non-space characters) summed from the first on.
Windows are spans of whole turns chosen on those prefix sums: each keeps the system turn, repeats a limited
history (the longest run of turns just before the span within ``history_turns`` and ``history_tokens`` that leaves room
for the span's first turn), and takes new turns as long as the budget holds.  Loss falls on assistant
turns that are new; system, user and repeated turns are masked, so each answer is a target exactly once.

Where a window may start decides all of it, so span and history are found for every turn at once by binary search
in the prefix sums and followed from the first.  Turns reach a task in order and are let go as soon as they are in no
window to come, so a conversation of any length takes little memory; it is not cut, because every window depends on all
before it.

Defined cases: rows with a null conv_id are left out; a null text is an empty one, a null role
is "unknown"; turns are ordered by turn, role and text, nulls last, so ties and repeated rows have one
result; only the first system turn is retained throughout, later ones are ordinary turns; a turn that
alone exceeds the budget is kept whole in a window of its own, marked ``over_budget``; a conversation of
a system turn alone is one window without targets; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import lean

BUDGET = 256
HISTORY_TURNS = 2
HISTORY_TOKENS = 96
#: Bytes of turns after which a conversation's sure windows are written.
HELD_BYTES = 1 << 20


def spans(tokens: np.ndarray, system: int, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, first: int = 0) -> list[tuple[int, int, int]]:
    """(first repeated turn, first new turn, end) of each window over ordinary turns, the first of them new from ``first`` on."""
    n = len(tokens)
    sums = np.concatenate([[0], np.cumsum(tokens)])
    start = np.arange(n)
    room = np.minimum(history_tokens, budget - system - tokens)
    history = np.where(room >= 0, np.searchsorted(sums, sums[:-1] - np.maximum(room, 0), "left"), start)
    history = np.maximum(np.minimum(history, start), start - history_turns).clip(0)
    end = np.searchsorted(sums, sums[history] + budget - system, "right") - 1
    end = np.maximum(end, start + 1)
    out, at = [], first
    while at < n:
        out.append((int(history[at]), at, int(end[at])))
        at = int(end[at])
    return out


def formatted(turns: list[tuple[str, str]], targets: list[bool]) -> tuple[str, str]:
    """The text, and the character spans under loss: an answer with its end mark."""
    parts, marks, at = [], [], 0
    for (role, text), target in zip(turns, targets, strict=True):
        head = f"<|{role}|>\n"
        parts.append(f"{head}{text}<|end|>\n")
        if target:
            marks.append(f"{at + len(head)}:{at + len(head) + len(text) + 7}")
        at += len(parts[-1])
    return "".join(parts), ",".join(marks)


_SCHEMA = "conv_id long, window int, n_tokens int, n_repeated int, n_new int, n_targets int, over_budget boolean, text string, loss_spans string"


class Conversation:
    """The turns of a conversation that may still be in a window."""

    def __init__(self, name: int, budget: int, history_turns: int, history_tokens: int):
        self.name, self.limits = name, (budget, history_turns, history_tokens)
        self.lead: tuple[str, str, int] | None = None
        self.found = False  # the lead among the turns
        self.turns: list[tuple[str, str, int]] = []
        self.at, self.window, self.held = 0, 0, 0

    def add(self, role: str, text: str, n: int) -> list[tuple]:
        """One more turn; returns the windows that are sure, now and then."""
        if role == "system" and self.lead is not None and not self.found:
            self.found = True
            return []
        self.turns.append((role, text, n))
        self.held += 64 + len(text)
        return self.windows(last=False) if self.held > HELD_BYTES else []

    def windows(self, last: bool) -> list[tuple]:
        """Windows that end before the last known turn, or all."""
        fixed = [] if self.lead is None else [self.lead]
        base, (budget, history_turns, _) = sum(t[2] for t in fixed), self.limits
        found = spans(np.array([t[2] for t in self.turns], np.int64), base, *self.limits, first=self.at)
        if last and not found and self.window == 0:
            found = [(0, 0, 0)]
        out = []
        for a, b, c in found:
            if c == len(self.turns) and not last:
                break
            used = fixed + self.turns[a:c]
            targets = [False] * (len(fixed) + b - a) + [t[0] == "assistant" for t in self.turns[b:c]]
            text, marks = formatted([t[:2] for t in used], targets)
            total = sum(t[2] for t in used)
            out.append((self.name, self.window, total, b - a, c - b, sum(targets), total > budget, text, marks))
            self.at, self.window = c, self.window + 1
        gone = max(0, self.at - history_turns)
        self.turns, self.at, self.held = self.turns[gone:], self.at - gone, 0
        return out


def format_chats(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row for each window of each conversation."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("part"), F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), text.alias("text"), F.regexp_count(text, F.lit(r"\S+")).alias("n"),
    )
    leads = turns.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("late", "turn", "role", "text", "n")).alias("lead")).select("conv_id", F.lit(0).alias("part"), "lead.*")
    names = ["conv_id", "window", "n_tokens", "n_repeated", "n_new", "n_targets", "over_budget", "text", "loss_spans"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            rows: list[tuple] = []
            for name, part, role, words, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", "n")), strict=True):
                if now is None or now.name != name:
                    rows += now.windows(last=True) if now is not None else []
                    now = Conversation(name, budget, history_turns, history_tokens)
                if part == 0:
                    now.lead = (role, words, n)
                else:
                    rows += now.add(role, words, n)
            if rows:
                yield made(rows)
        if now is not None and (rows := now.windows(last=True)):
            yield made(rows)

    ordered = turns.unionByName(leads).repartition("conv_id").sortWithinPartitions("conv_id", "part", "late", "turn", "role", "text")
    return ordered.mapInArrow(lean(apply), _SCHEMA)


ORACLE_SQL = r"""
with recursive turns as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) as n,
    row_number() over (partition by conv_id order by turn nulls last, coalesce(role, 'unknown'), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
lead_turns as (select conv_id, min(pos) as pos from turns where role = 'system' group by conv_id),
systems as (select t.* from turns t join lead_turns using (conv_id, pos)),
convs as (select c.conv_id, coalesce(s.n, 0) as base from (select distinct conv_id from turns) c left join systems s using (conv_id)),
rest as (
  select t.*, row_number() over w as i, sum(n) over w as p
  from turns t left join lead_turns l using (conv_id) where l.pos is null or t.pos <> l.pos
  window w as (partition by t.conv_id order by t.pos)),
starts as (
  select a.conv_id, a.i as a, c.base, min(h.i) as h
  from rest a join convs c using (conv_id)
  join rest h on h.conv_id = a.conv_id and h.i <= a.i and (h.i = a.i or (h.i >= a.i - 2
    and a.p - a.n - (h.p - h.n) <= least(96, 256 - c.base - a.n)))
  group by a.conv_id, a.i, c.base),
ends as (
  select s.conv_id, s.a, s.h, greatest(coalesce(max(x.i), 0), s.a) as b
  from starts s join rest h on h.conv_id = s.conv_id and h.i = s.h
  left join rest x on x.conv_id = s.conv_id and x.i >= s.a and s.base + x.p - (h.p - h.n) <= 256
  group by s.conv_id, s.a, s.h),
walk as (
  select conv_id, 0 as win, a, h, b from ends where a = 1
  union all
  select e.conv_id, w.win + 1, e.a, e.h, e.b from walk w join ends e on e.conv_id = w.conv_id and e.a = w.b + 1),
windows as (
  select * from walk
  union all
  select conv_id, 0, 1, 1, 0 from convs where conv_id not in (select conv_id from rest)),
used as (
  select w.conv_id, w.win, w.a, w.h, w.b, 0 as i, s.role, s.text, s.n, false as target from windows w join systems s using (conv_id)
  union all
  select w.conv_id, w.win, w.a, w.h, w.b, r.i, r.role, r.text, r.n, r.i >= w.a and r.role = 'assistant'
  from windows w join rest r on r.conv_id = w.conv_id and r.i between w.h and w.b),
placed as (
  select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as f,
    coalesce(sum(length(role) + length(text) + 13) over (partition by conv_id, win order by i rows between unbounded preceding and 1 preceding), 0) + length(role) + 5 as s
  from used)
select conv_id, win::int as "window", sum(n)::int as n_tokens, (any_value(a) - any_value(h))::int as n_repeated, (any_value(b) - any_value(a) + 1)::int as n_new,
  count(*) filter (where target)::int as n_targets, sum(n) > 256 as over_budget, string_agg(f, '' order by i) as text,
  coalesce(string_agg((s::bigint)::varchar || ':' || ((s + length(text) + 7)::bigint)::varchar, ',' order by i) filter (where target), '') as loss_spans
from placed group by conv_id, win
"""
