import pyarrow as pa
import pytest

import corpus_pipeline
from docquarry.llm import decontaminate, jaccard, packing, pii, quality
from docquarry.llm.common import written
from tests.llm import test_decontaminate, test_jaccard, test_packing, test_quality
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def stages(spark, docs):
    """What each stage returns, from the documents on."""
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_keep_columns_and_take_effect(spark, docs, stages):
    counts = [s.count() for s in stages[:-1]]
    assert all(s.columns == docs.columns for s in stages[:-1]) and counts == sorted(counts, reverse=True)
    assert jaccard.jaccard_join(stages[2]).where("n_links > 0 or n_copies > 1").isEmpty()
    assert decontaminate.contamination(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()
    assert counts[3] == counts[4] and not stages[4].where("text like '%[EMAIL]%'").isEmpty()


def test_stages_against_brute_force(spark, docs, stages):
    """What each stage should do with its own input, by slow definitions."""
    rows = [[tuple(r) for r in s.select("doc_id", "text").collect()] for s in stages[:-1]]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {d: test_quality.slowly(model, t)[1] for d, t in rows[0]}
    assert {d for d, p in good.items() if p >= quality.KEEP_AT + 1e-3} <= {d for d, _ in rows[1]} <= {d for d, p in good.items() if p >= quality.KEEP_AT - 1e-3}
    assert sorted(d for d, _ in rows[2]) == [d for d, c, _, _ in test_jaccard.brute(rows[1]) if d == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {d for d, _ in test_decontaminate.brute(rows[2], items)}
    assert sorted(rows[3]) == sorted(r for r in rows[2] if r[0] not in dirty) and dirty
    crf = pii.train()
    assert sorted(rows[4]) == sorted((d, pii.redacted(t, pii.find(pa.array([t]), crf)[0])) for d, t in rows[3])
    packed = test_packing.rebuilt(stages[5].collect())
    assert {d: "".join(p["text"] for p in ps) for d, ps in packed.items()} == {d: t for d, t in rows[4] if t.split()}


def test_last_stage_packs_every_token(stages):
    tokens = sum(len((r["text"] or "").split()) for r in stages[4].collect())
    assert stages[5].agg({"n_tokens": "sum"}).first()[0] == tokens
    assert packing.pack(stages[4]).count() == stages[5].count()


def test_run_is_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_ids", "pieces").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, stages[5].select("doc_ids", "pieces").collect()))


@pytest.mark.parametrize("which", ["messy", "empty"])
def test_messy_and_empty_documents(spark, request, which):
    docs = request.getfixturevalue(which)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, SF), "test-messy")
        assert kept.columns == docs.columns
    assert (corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() > 0) == (which == "messy")
