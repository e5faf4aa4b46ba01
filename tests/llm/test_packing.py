import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from docquarry.llm import packing
from tests.llm.conftest import SF


def rebuilt(windows):
    """Texts by id from the pieces in order."""
    out = {}
    for w in sorted(windows, key=lambda w: (w["lane"], w["window"])):
        for p in w["pieces"]:
            out.setdefault(p["doc_id"], []).append(p)
    return out


def test_query_loses_no_text(spark, docs):
    from docquarry.llm.queries import op7_packing

    windows = op7_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if (r["text"] or "").split()}
    got = rebuilt(windows)
    assert {d: "".join(p["text"] for p in ps) for d, ps in got.items()} == texts
    assert all(a["end"] == b["start"] for ps in got.values() for a, b in zip(ps, ps[1:], strict=False))
    last = {w["lane"]: max(v["window"] for v in windows if v["lane"] == w["lane"]) for w in windows}
    assert all(w["n_tokens"] == packing.WINDOW for w in windows if w["window"] < last[w["lane"]])
    assert all(w["n_tokens"] == sum(p["end"] - p["start"] for p in w["pieces"]) for w in windows)


@pytest.mark.parametrize("seed", range(5))
def test_deficits_stay_within_a_piece_while_queues_last(seed):
    rng = random.Random(seed)
    queues = [[(100 * s + d, rng.choice([1, 40, 300, 5000])) for d in range(60)] for s in range(3)]
    shares = [0.5, 0.3, 0.2]
    served = [0, 0, 0]
    total = [sum(n for _, n in q) for q in queues]
    for k, (pieces, _) in enumerate(packing.round_robin(queues, shares, [0.0] * 3), 1):
        for d, a, b in pieces:
            served[d // 100] += b - a
        if any(s >= t for s, t in zip(served, total, strict=True)):
            break
        assert all(abs(n - w * k * packing.WINDOW) <= packing.PIECE + 1 for n, w in zip(served, shares, strict=True))
    assert k > 3


def slowly(queues, shares, carried, window, piece):
    """The same round robin, a token at a time."""
    waiting = [deque((d, i) for d, n in q for i in range(n)) for q in queues]
    last = {d: n for q in queues for d, n in q}
    windows = -(-sum(map(len, waiting)) // window)
    deficit, turn, out = [0.0] * len(queues), 0, []
    while any(waiting):
        live = [s for s, q in enumerate(waiting) if q]
        space = min(window, sum(map(len, waiting)))
        weight = sum(shares[s] for s in live)
        for s in range(len(queues)):
            credit = (shares[s] / weight if weight > 0 else 1 / len(live)) * space + carried[s] / windows
            deficit[s] = deficit[s] + credit if waiting[s] else 0.0
        tokens, idle = [], 0

        def serve(s, most):
            d, n = waiting[s][0][0], 0
            while n < most and waiting[s] and waiting[s][0][0] == d:
                tokens.append(waiting[s].popleft())
                n += 1
            deficit[s] -= n
            return n

        while space:
            if idle == len(queues):
                owed = max((s for s in live if waiting[s]), key=lambda s: (deficit[s], -s))
                space -= serve(owed, min(piece, space))
                idle = 0
                continue
            turn = (turn + 1) % len(queues)
            idle += 1
            while space and waiting[turn]:
                d, i = waiting[turn][0]
                if deficit[turn] < min(piece, last[d] - i):
                    break
                space -= serve(turn, min(int(deficit[turn]), space))
                idle = 0
        out.append((tokens, list(deficit)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_round_robin_against_a_token_at_a_time(seed):
    rng = random.Random(seed)
    queues = [[(1000 * s + d, rng.choice([1, 3, 9, 70])) for d in range(rng.randint(0, 12))] for s in range(rng.randint(1, 4))]
    shares = [rng.choice([0.0, 0.2, 0.5]) for _ in queues]
    carried = [rng.choice([0.0, -7.5, 12.0]) for _ in queues]
    got = list(packing.round_robin(queues, shares, carried, 32, 6))
    expected = slowly(queues, shares, carried, 32, 6)
    assert [[(d, i) for d, a, b in pieces for i in range(a, b)] for pieces, _ in got] == [tokens for tokens, _ in expected]
    for (_, a), (_, b) in zip(got, expected, strict=True):
        assert a == pytest.approx(b)


def test_query_against_a_token_at_a_time(spark, docs):
    """Every window of the query's whole table, which is one lane here."""
    from docquarry.llm.queries import MIXTURE, op7_packing

    rows = docs.withColumn("rank", F.xxhash64("doc_id", "text")).orderBy("rank", "doc_id").collect()
    names = sorted({r["source"] for r in rows if r["text"].split()})
    queues = [[(r["doc_id"], len(r["text"].split())) for r in rows if r["source"] == s and r["text"].split()] for s in names]
    expected = slowly(queues, [MIXTURE.get(s, 0.0) / len(names) for s in names], [0.0] * len(names), packing.WINDOW, packing.PIECE)
    windows = sorted(op7_packing(spark, SF).collect(), key=lambda w: (w["lane"], w["window"]))
    assert len({w["lane"] for w in windows}) == 1
    assert [[(p["doc_id"], i) for p in w["pieces"] for i in range(p["start"], p["end"])] for w in windows] == [tokens for tokens, _ in expected]
    for w, (_, deficit) in zip(windows, expected, strict=True):
        assert [d["source"] for d in w["deficits"]] == names and [d["deficit"] for d in w["deficits"]] == pytest.approx(deficit, abs=1e-5)


def mixed(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    rows = [(i, s, " ".join(["word"] * rng.randint(20, 60))) for i, (_, s) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string"), rows


def by_lane(windows):
    out = {}
    for w in sorted(windows, key=lambda w: (w["lane"], w["window"])):
        for p in w["pieces"]:
            own = out.setdefault(w["lane"], {})
            own[p["source"]] = own.get(p["source"], 0) + p["end"] - p["start"]
    return out


def due(sizes, shares, at):
    """Tokens of each source among the first ``at`` at the target shares, by small steps of r."""
    given, step = dict.fromkeys(sizes, 0.0), 1.0
    while sum(given.values()) < at - 1e-6:
        live = [s for s in sizes if shares.get(s) and given[s] < sizes[s]] or [s for s in sizes if given[s] < sizes[s]]
        weights = {s: shares.get(s) or sizes[s] for s in live}
        for s in live:
            given[s] = min(sizes[s], given[s] + min(step, at - sum(given.values())) * weights[s] / sum(weights.values()))
    return given


def test_a_target_mixture_is_met_and_carried_over_lanes(spark):
    """Equal parts of a corpus that has not got equal parts, then the others; no lane drifts from the schedule."""
    df, rows = mixed(spark, {"a": 900, "b": 500, "c": 250, "": 40, None: 60})
    shares = {"a": 1.0, "b": 1.0, "c": 1.0, "absent": 3.0}
    windows = packing.pack(df, shares, window=256, piece=32, lane_bytes=24_000).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    lanes = by_lane(windows)
    assert len(lanes) > 8
    so_far, bucket = dict.fromkeys(sizes, 0), max(sizes.values()) / (len(lanes) * packing.BUCKETS_A_LANE) * 2 + 60 * 4
    for lane in sorted(lanes):
        for s, n in lanes[lane].items():
            so_far[s] += n
        wanted = due(sizes, shares, sum(so_far.values()))
        assert all(abs(so_far[s] - wanted[s]) < 3 * bucket for s in sizes), (lane, so_far, wanted)
    assert so_far == sizes
    # while all three last, every whole window has equal parts of them up to what is carried and a piece
    for w in windows:
        if lanes[w["lane"]].keys() == {"a", "b", "c"} and min(lanes[w["lane"]].values()) > 0.3 * sum(lanes[w["lane"]].values()) and w["n_tokens"] == 256:
            if w["window"] < max(v["window"] for v in windows if v["lane"] == w["lane"]) - 2:
                parts = [sum(p["end"] - p["start"] for p in w["pieces"] if p["source"] == s) for s in "abc"]
                assert max(parts) - min(parts) <= 3 * 32 + 20, parts
    # the deficit a lane begins with is what its sources are owed from the lanes before
    first = {w["lane"]: {d["source"]: d["deficit"] for d in w["deficits"]} for w in windows if w["window"] == 0}
    assert any(abs(x) > 1 for d in first.values() for x in d.values())


def test_prefix_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEVEL", 7)
    rng = random.Random(2)
    rows = [(k, at, rng.randrange(9)) for k in "xy" for at in rng.sample(range(300), 90)]
    got = packing.earlier(spark.createDataFrame(rows, "k string, at long, n long"), ["k"], "at", "n").collect()
    assert {(r["k"], r["at"]): r["_before"] for r in got} == {(k, at): sum(n for k2, at2, n in rows if k2 == k and at2 < at) for k, at, _ in rows}


def test_carried_deficits_over_lanes(docs):
    windows = packing.pack(docs, lane_bytes=100_000).collect()
    assert len({w["lane"] for w in windows}) > 2
    assert {d for w in windows for d in w["doc_ids"]} == {r["doc_id"] for r in docs.collect() if (r["text"] or "").split()}


def test_messy_documents(messy, empty):
    windows = packing.pack(messy).collect()
    words = sum(len((r["text"] or "").split()) for r in messy.collect())
    assert sum(w["n_tokens"] for w in windows) == words
    assert {p["source"] for w in windows for p in w["pieces"]} == {"a", "b", None}
    assert packing.pack(empty).count() == 0
    assert sum(w["n_tokens"] for w in packing.pack(messy, shares={"a": 0.0, "zz": 1.0}).collect()) == words
    assert {d["source"] for w in windows for d in w["deficits"]} == {"a", "b", None}
    for bad in (-1.0, float("nan")):
        with pytest.raises(ValueError):
            packing.pack(messy, shares={"a": bad})
