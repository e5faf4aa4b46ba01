import random
import re

from docquarry.llm import decontaminate
from docquarry.llm.decontaminate import clean, contamination, greedy_tiles
from tests.llm.conftest import SF

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def naive_tiles(p, t, m):
    """The definition: again and again the longest unmarked match, earliest first."""
    pm, tm, tiles = [False] * len(p), [False] * len(t), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not pm[i + n] and not tm[j + n]:
                    n += 1
                if n >= m and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return tiles
        n, i, j = best
        for k in range(n):
            pm[i + k] = tm[j + k] = True
        tiles.append((i, j, n))


def test_tiles_are_those_of_the_definition():
    rng = random.Random(4)
    for _ in range(1500):
        letters = rng.choice([2, 3, 6])
        p = [rng.randrange(letters) for _ in range(rng.randrange(18))]
        t = [rng.randrange(letters) for _ in range(rng.randrange(26))]
        m = rng.choice([1, 2, 3, 4])
        assert greedy_tiles(p, t, m) == naive_tiles(p, t, m)


def brute(docs, items, coverage=0.5, m=5):
    out = {}
    for d, text in docs:
        words = WORD.findall((text or "").lower())
        held = {tuple(words[i : i + m]) for i in range(len(words) - m + 1)}
        for i, item in items:
            own = WORD.findall(item.lower())
            if len(own) < m or not any(tuple(own[k : k + m]) in held for k in range(len(own) - m + 1)):
                continue
            n = sum(x[2] for x in naive_tiles(own, words, m))
            if n >= coverage * len(own):
                out[d, i] = max(n, out.get((d, i), 0))
    return out


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def cases():
    w = ITEM.split()
    return [
        (1, "before it " + ITEM.upper().replace(" ", "*** ") + " behind"),
        (2, " ".join(w[10:20] + ["x"] + w[:10])),  # reordered
        (3, " ".join(w[:9])),  # too little
        (4, " ".join(w[:10])),  # just half
        (5, "nothing of it"),
        (6, None),
        (7, ""),
        (8, " ".join(x for i in range(0, 20, 4) for x in w[i : i + 4] + ["gap"])),  # no run of five
        (9, "filler words " * 30_000 + ITEM),
        (1, "the same id with another text"),
        (None, ITEM),
    ]


def test_reordered_partial_and_messy_documents(spark):
    docs = spark.createDataFrame(cases(), "doc_id long, text string").selectExpr("*", "1 as coverage", "'z' as item_id")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (None, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in contamination(docs, items).collect()}
    assert got == {(1, 1): 20, (2, 1): 20, (4, 1): 10, (9, 1): 20}
    kept = clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect() if r["doc_id"] != 9) == sorted((d, t or "") for d, t in cases() if d in (3, 5, 6, 7, 8) or t == "the same id with another text")


def test_a_large_benchmark_gives_the_same_by_joins(spark, monkeypatch):
    docs = spark.createDataFrame(cases(), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (4, ITEM + " and more words than that")], "item_id long, text string")
    small = sorted(map(tuple, contamination(docs, items).collect()))
    kept = sorted(map(repr, clean(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, contamination(docs, items).collect())) == small and small
    assert sorted(map(repr, clean(docs, items).collect())) == kept


def test_pipeline_judges_rows_alike_on_either_side_of_the_limit(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([*cases(), (None, "no id and nothing of it"), (None, ITEM)], "doc_id long, text string").selectExpr("*", "1 as coverage", "'z' as _row")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (None, ITEM + " and more words than that")], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: items)
    small = corpus_pipeline.drop_contaminated(spark, docs, SF)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    large = corpus_pipeline.drop_contaminated(spark, docs, SF)
    rows = sorted(map(repr, small.collect()))
    assert large.columns == docs.columns and sorted(map(repr, large.collect())) == rows
    assert len(rows) == 7 and sum("the same id" in r or "no id" in r for r in rows) == 2


def test_empty_tables(spark, empty, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contamination(empty, items).count() == 0
    assert contamination(docs, items.limit(0)).count() == 0
    assert clean(docs, items.limit(0)).count() == docs.count()


def test_query_against_brute_force(spark, docs):
    from docquarry.llm.queries import op1_decontaminate

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], items)
    assert {(r["doc_id"], r["item_id"]): r["covered_words"] for r in op1_decontaminate(spark, SF).collect()} == expected and expected
