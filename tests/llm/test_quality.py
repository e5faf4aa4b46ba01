import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import quality
from docquarry.llm.tokens import span_hashes
from tests.llm.conftest import SF

TABLES = "/root/testdata/sf0.01"


def test_held_out_grades(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    told = labels.where("doc_id % 2 = 1").select("doc_id", quality.grade_column().alias("grade"))
    rows = quality.score(docs, model).join(told, "doc_id").select("tail_probability", "expected_grade", "grade").collect()
    assert len(rows) > 50
    tail, expected, grade = (np.array([r[i] for r in rows]) for i in range(3))
    assert ((tail >= 0.5) == (grade == 2)).mean() > 0.85
    assert expected[grade == 2].mean() > expected[grade == 1].mean()


def slowly(model, text):
    """Expected grade and tail probability of a text, a word at a time."""
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    marks = re.findall("[^0-9a-z\x80-\U0010ffff \t\r\n\f\v]+", (text or "").lower())
    if not words:
        return 0.0, 0.0
    score, half = 0.0, model.bits - 1
    for kind, tokens in ((0, words), (1, marks)):
        buckets = Counter()
        for t in tokens:
            data = np.frombuffer(t.encode(), np.uint8)
            buckets[int(span_hashes(data, np.array([0]), np.array([len(data)]))[0]) >> (64 - half)] += 1
        for b, n in buckets.items():
            score += model.weights[b + (kind << half)] * (n / len(tokens)) ** 0.5
    letters = [c for c in text if c.isascii() and c.isalpha()]
    data = text.encode()
    inside = sum(len(m.encode()) for m in marks)
    for k, figure in enumerate((sum(c.isupper() for c in letters) / max(1, len(letters)), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), inside / max(1, len(data)))):
        score += model.weights[(1 << model.bits) + k] * figure
    above = 1 / (1 + np.exp(model.thresholds - score))
    return above.sum(), above[-1]


def test_query_against_brute_force(spark, docs):
    """Every document's grade by a slow reading of the same model, and the selection that follows."""
    from docquarry.llm.queries import op5_quality

    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = {r["doc_id"]: slowly(model, r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: (r["expected_grade"], r["tail_probability"]) for r in quality.score(docs, model).collect()}
    assert got.keys() == expected.keys() and all(got[d] == pytest.approx(expected[d], abs=2e-4) for d in got)
    chosen = {r["doc_id"] for r in op5_quality(spark, SF).collect()}
    assert {d for d, (_, t) in expected.items() if t >= quality.KEEP_AT + 1e-3} <= chosen <= {d for d, (_, t) in expected.items() if t >= quality.KEEP_AT - 1e-3}
    assert 0 < len(chosen) < len(expected)


def test_thresholds_rise_and_tails_are_the_last_cut():
    rng = np.random.default_rng(3)
    grade = rng.integers(0, 3, 300)
    row, feature = np.arange(300), grade * 7
    model = quality.fit_cumulative_link(row, feature, np.ones(300), grade, bits=10)
    assert (np.diff(model.thresholds) > 0).all()
    score = model.weights[[0, 7, 14]]
    assert score[0] < score[1] < score[2]


def test_messy_documents(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 1, 0), (None, 1, 1), (5, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(messy, labels)
    scored = quality.score(messy, model)
    rows = scored.collect()
    assert len(rows) == 11 and scored.columns == [c for c in messy.columns if c != "expected_grade"] + ["expected_grade", "tail_probability"]
    assert all((r["expected_grade"], r["tail_probability"]) == (0, 0) for r in rows if not (r["text"] or "").strip())
    kept = quality.kept(messy, model)
    assert kept.schema == messy.schema
    assert kept.count() == scored.where(f"tail_probability >= {quality.KEEP_AT}").count()
    assert quality.kept(empty, model).count() == quality.score(empty, model).count() == 0


def test_no_labels_keep_every_text_with_words(spark, messy):
    model = quality.fit(messy, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.kept(messy, model).count() == messy.where("length(trim('\n\t ' from text)) > 0").count()


def test_slices_do_not_change_scores():
    texts = pa.array(["one two, three!", None, "", "A B c " * 1000])
    model = quality.CumulativeLink(np.random.default_rng(1).normal(size=(1 << quality.BITS) + quality.SURFACE), np.array([-1.0, 1.0]))
    whole = model.grades(texts)[0]
    assert np.allclose(whole, [model.grades(texts.slice(i, 1))[0][0] for i in range(4)])
