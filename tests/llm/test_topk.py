from collections import Counter

import numpy as np
import pytest

from docquarry.llm import topk
from tests.llm.conftest import SF


def slowly(rows, k, every=1):
    """The nearest of all rows of each query by definition."""
    out = Counter()
    for i, (d, v) in enumerate(rows):
        if d % every:
            continue
        others = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), e) for j, (e, w) in enumerate(rows) if j != i and len(w) == len(v))
        for rank, (x, e) in enumerate(others[:k], 1):
            out[d, e, rank, round(x**0.5, 6)] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("vec_id", "neighbour_id", "rank", "distance").collect())


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_ties_copies_and_lengths(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    rows = [(int(i), rng.integers(0, 3, 16).astype(float).tolist()) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 230)] + [(7, rows[3][1])] + [(300 + i, [float(i)] * 4) for i in range(5)] + [(400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk.nearest(df, 5, every=1, block_rows=block_rows)) == slowly(rows, 5)
    assert found(topk.nearest(df, 5, every=7, block_rows=block_rows)) == slowly(rows, 5, 7)


def test_spread_clusters_in_many_blocks(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 30, (6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(0, 1, 24)).tolist()) for i in range(400)]
    assert found(topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, every=3, block_rows=32)) == slowly(rows, 10, 3)


def test_far_clusters(spark, monkeypatch):
    """Boxes exclude most cells; boxes joined by shuffle change nothing."""
    rng = np.random.default_rng(5)
    rows = [(i, (np.repeat(rng.normal(0, 1, 4) + 100.0 * (i % 4 - 1.5), 4) + rng.normal(0, 0.1, 16)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = slowly(rows, 5, 2)
    assert found(topk.nearest(df, 5, every=2, block_rows=32)) == expected
    monkeypatch.setattr(topk, "BROADCAST_BOXES", 0)
    assert found(topk.nearest(df, 5, every=2, block_rows=32)) == expected


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 37)), rng.normal(size=(50, 37))
    exact = ((a[:, None] - b[None]) ** 2).sum(2)
    last = np.zeros_like(exact)
    for s in topk.LEVELS:
        low = topk.bounds(topk.statistics(a, s), topk.statistics(b, s))
        assert (low <= exact).all()
        last = low
    assert last.mean() > topk.bounds(topk.statistics(a, 1), topk.statistics(b, 1)).mean()


def test_messy_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (None, [1.0, 2.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, []), (6, [float("inf"), 0.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "2 as row", "'x' as vector")
    assert found(topk.nearest(df, every=1)) == Counter({(1, 7, 1, 0.0): 1, (7, 1, 1, 0.0): 1})
    assert topk.nearest(df.limit(0)).count() == 0


def test_query(spark):
    from docquarry.llm.queries import op6_topk

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = op6_topk(spark, SF).collect()
    near = Counter(k[:2] for k in slowly([(d, np.asarray(v, np.float64)) for d, v in rows], topk.TOP, 100))
    assert len(got) == sum(near.values()) and {(r["vec_id"], r["neighbour_id"]) for r in got} == set(near)
