import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import jaccard
from docquarry.llm.jaccard import components, jaccard_join, one_of_each
from docquarry.llm.rtree import CountRTree, pair_passes
from tests.llm.conftest import SF

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def gram_set(text, n=3):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(sets, threshold=0.5):
    """Pairs of different sets by definition."""
    out, holders = set(), {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, a in enumerate(sets):
        for j, n in Counter(j for g in a for j in holders[g] if j > i).items():
            if n / (len(a) + len(sets[j]) - n) >= threshold:
                out.add((i, j))
    return out


def brute(rows, threshold=0.5):
    """(doc_id, class_id, n_copies, n_links) of every row with an id, by definition."""
    rows = [(d, gram_set(t) or frozenset([("none", i)])) for i, (d, t) in enumerate(rows) if d is not None]
    sets = list(dict.fromkeys(s for _, s in rows))
    pairs, label = linked(sets, threshold), list(range(len(sets)))
    for _ in sets:
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    place = {s: i for i, s in enumerate(sets)}
    least = {}
    for d, s in rows:
        c = label[place[s]]
        least[c] = min(d, least.get(c, d))
    degree, copies = Counter(x for p in pairs for x in p), Counter(s for _, s in rows)
    return sorted((d, least[label[place[s]]], copies[s], degree[place[s]]) for d, s in rows)


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "class_id", "n_copies", "n_links").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_query_against_brute_force(spark, docs):
    from docquarry.llm.queries import op2_jaccard

    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert found(op2_jaccard(spark, SF)) == expected and any(r[3] for r in expected) and any(r[2] > 1 for r in expected)


def test_messy_documents(messy, empty):
    rows = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    got = found(jaccard_join(messy))
    assert got == brute(rows)
    assert [r for r in got if r[0] in (1, 7)] == [(1, 1, 3, 0), (1, 1, 3, 0), (7, 1, 3, 0), (7, 7, 1, 0)]
    assert jaccard_join(empty).count() == 0


def near_copies(seed, groups, size, change, lengths=(5, 30, 120, 400)):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice(lengths))]
        for _ in range(rng.randint(1, size)):
            rows.append((at, " ".join(w if rng.random() > change else f"n{rng.randrange(9999)}" for w in base)))
            at += 1
    return rows


def test_recall_and_no_false_link(spark):
    rows = near_copies(5, 60, 9, 0.07)
    expected, got = brute(rows), found(jaccard_join(frame(spark, rows)))
    assert all(g[3] <= e[3] for g, e in zip(got, expected, strict=True))
    assert sum(g[3] for g in got) >= 0.99 * sum(e[3] for e in expected)


def test_small_sets_lose_no_link(spark):
    """Sets of 1 to 6 grams, many of them at the threshold."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for i in range(1500)]
    for i in range(1500, 3000):
        text = rows[i - 1500][1].split()
        text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    expected = brute(rows)
    assert found(jaccard_join(frame(spark, rows))) == expected and sum(r[3] for r in expected) > 500


def test_large_sets_at_the_threshold_lose_no_link(spark):
    """Pairs of 90 grams each and Jaccard 0.5 that shared no key of 32 pairs of group minima, which the join once relied on."""
    rows = [(2 * i + (c == "c"), " ".join([f"a{i}x{k}" for k in range(62)] + [f"{c}{i}x{k}" for k in range(30)])) for i in (10531, 12006, 16341) for c in "bc"]
    expected = brute(rows)
    assert found(jaccard_join(frame(spark, rows))) == expected and [r[3] for r in expected] == [1] * 6


def test_grams_of_many_holders_lose_no_link(spark, monkeypatch):
    """Grams of too many holders to pair: some are found by the sample, some in a second turn, some are all that a text has."""
    monkeypatch.setattr(jaccard, "MOST_PAIRED", 4)
    monkeypatch.setattr(jaccard, "SAMPLE_TIMES", 12)
    rng = random.Random(12)
    common = [" ".join(f"c{g}x{k}" for k in range(6)) for g in range(12)]
    rows = near_copies(13, 12, 12, 0.05, (20, 60))
    rows = [(i, f"{t} {' '.join(rng.sample(common, 4))}") for i, t in rows] + [(1000 + i, " ".join(rng.sample(common, rng.randint(1, 6)))) for i in range(60)]
    expected = brute(rows)
    assert found(jaccard_join(frame(spark, rows))) == expected and max(r[3] for r in expected) > 5


@pytest.mark.parametrize("number", [100, 200])
def test_candidates_grow_with_the_sets(spark, monkeypatch, number):
    """Each pair of near copies shares some hundred grams; the table that connects them has a row for each set and bucket."""
    rows = {}
    kept = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, what: rows.setdefault(what, kept(df, what)) if what == "met" else kept(df, what))
    rng = random.Random(21)
    texts = [" ".join(f"w{k}" if rng.random() > 0.01 else f"n{i}x{k}" for k in range(150)) for i in range(number)]
    jaccard_join(frame(spark, list(enumerate(texts))))
    assert number / 2 < rows["met"].count() < number


def test_candidates_of_the_stage_grow_with_the_sets(spark, monkeypatch):
    """The same of the pipeline's stage, in many buckets of grams: a row for each gram that sets share, whatever the pairs."""
    met = []
    kept = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, what: met.append(kept(df, what)) or met[-1] if what == "met" else kept(df, what))
    monkeypatch.setattr(jaccard, "BUCKET_GRAMS", 1 << 10)
    texts = [" ".join(f"w{k}" if (i + 7 * k) % 97 else f"n{i}x{k}" for k in range(150)) for i in range(120)]
    assert [r["doc_id"] for r in one_of_each(frame(spark, list(enumerate(texts)))).collect()] == [0]
    assert sum(m.count() for m in met) < 120 * 8


def test_copies_under_ids_of_other_texts_lose_no_link(spark):
    """A row that copies another's text has an id that is used for a text of its own, too."""
    rng = random.Random(22)
    text = lambda name, n=40: [f"{name}{k}" for k in range(n)]
    rows = []
    for i in range(20):
        own, other = text(f"a{i}x"), text(f"b{i}x")
        near = list(other)
        near[rng.randrange(3, 37)] = "new"
        rows += [(10 * i, " ".join(own)), (10 * i + 1, " ".join(own)), (10 * i + 1, " ".join(other)), (10 * i + 2, " ".join(near)), (10 * i, " ".join(near))]
    expected = brute(rows)
    assert found(jaccard_join(frame(spark, rows))) == expected and sum(r[3] for r in expected) == 60


@pytest.mark.parametrize("tile", [4096, 20])
def test_one_large_group_goes_through_trees_and_tiles(spark, monkeypatch, tile):
    """Near copies of one text, and short texts that share a gram, in one tile or many."""
    monkeypatch.setattr(jaccard, "TILE_NODES", tile)
    rows = near_copies(6, 1, 1, 0.0, (120,)) * 150
    rng = random.Random(9)
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"n{rng.randrange(9999)}" for w in t.split())) for i, (_, t) in enumerate(rows)]
    rows += [(1000 + i, f"once upon a time {' '.join(str(rng.randrange(6)) for _ in range(rng.randint(1, 5)))}") for i in range(120)]
    expected, got = brute(rows), found(jaccard_join(frame(spark, rows)))
    assert got == expected and max(r[3] for r in expected) > 100


def test_sets_beyond_the_matrix_are_merged(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MATRIX_BYTES", 0)
    rows = near_copies(3, 1, 1, 0.0, (80,)) * 40
    rng = random.Random(2)
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"n{rng.randrange(9999)}" for w in t.split())) for i, (_, t) in enumerate(rows)]
    assert found(jaccard_join(frame(spark, rows))) == brute(rows)


def test_tree_keeps_every_pair_that_the_bound_keeps():
    rng = np.random.default_rng(3)

    def points(n):
        counts = rng.poisson(rng.choice([0.5, 3.0], (n, 1)), (n, 8)).astype(np.uint16)
        return counts, np.maximum(1, counts.sum(1)).astype(np.int32)

    def passes(x, y, i, j):
        return pair_passes(x[0][i], y[0][j], x[1][i], y[1][j], 0.6) & (np.minimum(x[1][i], y[1][j]) >= 0.6 * np.maximum(x[1][i], y[1][j]))

    for n, m in ((1, 1), (2, 40), (17, 3), (300, 5), (300, 700)):
        x, y = points(n), points(m)
        got = {tuple(sorted(p)) for a, b in CountRTree(*x).join(None, 0.6) for p in zip(a.tolist(), b.tolist(), strict=True)}
        i, j = np.triu_indices(n, 1)
        ok = passes(x, x, i, j)
        assert set(zip(i[ok].tolist(), j[ok].tolist(), strict=True)) <= got
        across = [p for a, b in CountRTree(*x).join(CountRTree(*y), 0.6) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(across) == len(set(across))
        i, j = (v.reshape(-1) for v in np.indices((n, m)))
        ok = passes(x, y, i, j)
        assert set(zip(i[ok].tolist(), j[ok].tolist(), strict=True)) <= set(across)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(35)] + [(i + 1, i) for i in range(100, 117)] + [(3, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["group"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_row_of_each_class_stays(spark, messy, empty, docs):
    import corpus_pipeline

    kept = corpus_pipeline.drop_near_copies(spark, messy.withColumn("_row", F.lit("own")), SF)
    assert kept.columns == [*messy.columns, "_row"]
    # of id 1 one of two equal rows, of id 7 the row that is no copy
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "2", "3", "4", "5", "6", "7", "None", "None"])
    assert [r["text"] for r in rows if r["doc_id"] == 7] == ["another text under an id that is used twice, mail me at a.b@c.example.com"]
    assert one_of_each(empty).count() == 0
    # the least id stays wherever its row lies
    classes = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    turned = one_of_each(docs.orderBy(F.desc("doc_id")))
    assert sorted(r["doc_id"] for r in turned.collect()) == [d for d, c, _, _ in classes if c == d]
