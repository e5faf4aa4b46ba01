from collections import Counter
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.llm import lm
from docquarry.llm.tokens import Words
from tests.llm.conftest import SF


def doubled(model):
    return lm.Gru(*(getattr(model, f.name).astype(np.float64) for f in fields(model)))


def test_gradient_against_differences():
    rng = np.random.default_rng(5)
    model = doubled(lm.Gru.initial(4, 5, 6))
    words, targets = rng.integers(0, 20, (7, 3)), rng.integers(0, 20, (7, 3))
    fresh, h = words == lm.END, rng.normal(size=(3, 6))
    _, slope, _ = lm.window_gradient(model, words, targets, fresh, h)
    for f in fields(model):
        values, got = getattr(model, f.name).reshape(-1), getattr(slope, f.name).reshape(-1)
        for i in rng.choice(len(values), min(6, len(values)), replace=False):
            kept, loss = values[i], []
            for d in (1e-5, -1e-5):
                values[i] = kept + d
                loss.append(lm.window_gradient(model, words, targets, fresh, h)[0])
            values[i] = kept
            assert np.isclose(got[i], (loss[0] - loss[1]) / 2e-5, atol=1e-5)


def test_probabilities_sum_to_one():
    model, h = lm.Gru.initial(4, 5, 6), np.random.default_rng(2).normal(size=(1, 6)).astype(np.float32)
    assert np.isclose(np.exp(model.log_probability(np.repeat(h, 20, 0), np.arange(20))).sum(), 1, atol=1e-5)


def test_batched_scores_against_one_word_at_a_time():
    rng, model = np.random.default_rng(4), lm.Gru.initial()
    documents = [rng.integers(1, 900, n).astype(np.int16) for n in (0, 3, 700, 1, 41)]

    def slowly(ids):
        h, word, total = np.zeros((1, lm.HIDDEN), np.float32), lm.END, 0.0
        for target in [*ids.tolist(), lm.END]:
            h = model.step(np.array([word]), h)[0]
            total += float(model.log_probability(h, np.array([target]))[0])
            word = target
        return total

    assert np.allclose(lm.document_scores(model, documents), [slowly(d) for d in documents], rtol=1e-4)


def test_gradient_and_sum_with_tails():
    rng = np.random.default_rng(6)
    model = doubled(lm.Gru.initial(3, 4, 5, tails=6))
    words, targets = rng.integers(0, 18, (7, 3)), rng.integers(0, 18, (7, 3))
    fresh, h = words == lm.END, rng.normal(size=(3, 5))
    loss = lambda: lm.window_gradient(model, words, targets, fresh, h)[0]
    _, slope, _ = lm.window_gradient(model, words, targets, fresh, h)
    for f in fields(model):
        values, got = getattr(model, f.name).reshape(-1), getattr(slope, f.name).reshape(-1)
        for i in rng.choice(len(values), 6, replace=False):
            kept = values[i]
            values[i] = kept + 1e-5
            up = loss()
            values[i] = kept - 1e-5
            assert np.isclose(got[i], (up - loss()) / 2e-5, atol=1e-5)
            values[i] = kept
    one = h[:1].astype(np.float32)
    assert np.isclose(np.exp(lm.Gru.initial(3, 4, 5, tails=6).log_probability(np.repeat(one, 18, 0), np.arange(18))).sum(), 1, atol=1e-5)


def test_targets_below_zero_count_for_nothing():
    rng = np.random.default_rng(7)
    model = doubled(lm.Gru.initial(3, 4, 5, tails=6))
    words, targets = rng.integers(0, 18, (6, 4)), rng.integers(0, 18, (6, 4))
    fresh, h = words == lm.END, rng.normal(size=(4, 5))
    targets[4:, 3] = -1
    loss, slope, _ = lm.window_gradient(model, words, targets, fresh, h)
    one, first, _ = lm.window_gradient(model, words[:, :3], targets[:, :3], fresh[:, :3], h[:3])
    two, second, _ = lm.window_gradient(model, words[:4, 3:], targets[:4, 3:], fresh[:4, 3:], h[3:])
    assert np.isclose(loss, one + two)
    assert all(np.allclose(getattr(slope, f.name), getattr(first, f.name) + getattr(second, f.name)) for f in fields(model))


def test_every_token_is_a_target_once(monkeypatch):
    met = Counter()
    plain = lm.window_gradient

    def counted(model, words, targets, fresh, h):
        met.update(targets[targets >= 0].tolist())
        return plain(model, words, targets, fresh, h)

    monkeypatch.setattr(lm, "window_gradient", counted)
    for n in (1, 2, 63, 64, 65, 1000, 5003):
        met.clear()
        trainer = lm.Trainer(lm.Gru.initial(100, 100, tails=4))
        trainer.train(np.arange(n + 1))
        assert met == Counter(range(1, n + 1)) and trainer.tokens == n


def test_vocabulary_and_counts_follow_the_corpus(spark, docs):
    plain = lm.documents_only(docs)
    counts = lm.word_counts(plain)
    words = lm.vocabulary(counts)
    seen = Words(pa.array([r["text"] for r in plain.collect()]))
    distinct, n = np.unique(seen.hashes, return_counts=True)
    got = {r["key"]: r["n"] for r in counts.where("kind = 0").collect()}
    assert got == dict(zip(distinct.astype(np.int64).tolist(), n.tolist(), strict=True))
    classes, size, tails = words.shape
    assert classes == size == max(lm.CLASSES, int(np.ceil((n > 1).sum() ** (1 / 3))))
    code = words.encode(seen)
    assert (np.bincount(code, minlength=len(words.counts))[lm.FIRST :] == words.counts[lm.FIRST :]).all()
    assert n[np.isin(distinct, words.hashes)].min() >= n[~np.isin(distinct, words.hashes)].max()
    # counts of a tail's words, and what words seen once have of it, make one
    tail = words.encode(Words(pa.array([" "])))
    assert len(tail) == 0
    for t in range(tails):
        mine = ~np.isin(distinct, words.hashes) & (distinct.astype(np.int64) % tails == t)
        total = (n[mine & (n > 1)] / np.exp(words.mass[t])).sum() + np.exp(words.once[t]) / tails
        assert not mine.any() or np.isclose(total, 1, atol=0.02)
    assert lm.fit(plain, words).shape == (classes, size, lm.HIDDEN, tails)


def test_query_scores_words_beyond_the_classes_by_their_counts(spark):
    rng = np.random.default_rng(9)
    common = [f"c{i}" for i in range(1100)]
    texts = [" ".join(common) for _ in range(9)] + [" ".join(["qzxj", *rng.choice(common, 30)]) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate([*texts, "qzxj", "jxzq"])]
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.log_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # seen nine times and in a tail, against a word of the same letters seen once and spelled
    assert got[17] > got[18] + 3


def test_repeated_documents_are_told_apart_by_their_likelihood(spark):
    """Rare words of a document that occurs twice have counts; those of one that occurs once are spelled."""
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(1500)]
    name = lambda: "".join(rng.choice(list("bcdfgklmnprstvaeiou"), 9))
    texts = [" ".join([*rng.choice(common, 40), *(name() for _ in range(12))]) for _ in range(300)]
    rows = list(enumerate([*texts, *texts[:60]])) + [(1000 + i, " ".join(common)) for i in range(3)]
    got = {r["doc_id"]: r["log_likelihood"] / r["n_words"] for r in lm.log_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice, once = np.array([got[i] for i in range(60)]), np.array([got[i] for i in range(60, 300)])
    assert (twice > np.quantile(once, 0.95)).mean() > 0.9


def test_held_out_text_is_likelier_than_under_word_frequencies(spark, docs):
    """A model of one half scores the other half's symbols above a unigram model of that half."""
    plain = lm.documents_only(docs)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    known, held = plain.where(half), plain.where(~half)
    words = lm.vocabulary(lm.word_counts(known))
    model = lm.fit(known, words, rounds=2)
    ids = [words.encode(Words(pa.array([r["text"]]))) for r in held.collect()]
    share = np.log((words.counts + 1) / (words.counts + 1).sum())
    unigram = sum(share[i].sum() + share[lm.END] for i in ids)
    assert lm.document_scores(model, ids).sum() > unigram


def test_byte_pairs_have_two_ways():
    words = Words(pa.array(["one äb", "", "x y"]))
    assert (np.bincount(lm.byte_pairs(words.data, words.starts, words.ends), minlength=257 * 257) == lm.pair_counts(words)).all()


def test_training_helps_and_query_scores_all(spark, docs):
    from docquarry.llm.queries import op9_lm

    got = {r["doc_id"]: r for r in op9_lm(spark, SF).collect()}
    plain = lm.documents_only(docs)
    counts = lm.word_counts(plain)
    words = lm.vocabulary(counts)
    untrained = {r["doc_id"]: r for r in lm.score(plain, lm.Gru.initial(*words.shape[:2], tails=words.shape[2]), words, counts).collect()}
    assert len(got) == docs.count()
    better = [got[d]["per_word"] > untrained[d]["per_word"] for d in got if got[d]["n_words"] > 20]
    assert np.mean(better) > 0.95


def test_scores_against_one_word_at_a_time(spark, docs):
    """Every document's log-likelihood from the model, the counts and the spelling, a word at a time."""
    plain = lm.documents_only(docs).limit(60)
    counts = lm.word_counts(plain)
    words = lm.vocabulary(counts, classes=6)
    model, n = lm.fit(plain, words, rounds=1), {r["key"]: r["n"] for r in counts.where("kind = 0").collect()}
    first = words.shape[0] * words.shape[1]
    texts = {r["doc_id"]: r["text"] for r in plain.collect()}

    def slowly(text):
        got = Words(pa.array([text]))
        h, word, total = np.zeros((1, lm.HIDDEN), np.float32), lm.END, 0.0
        for i, target in enumerate([*words.encode(got).tolist(), lm.END]):
            h = model.step(np.array([word]), h)[0]
            total += float(model.log_probability(h, np.array([target]))[0])
            word = target
            if target >= first:
                key = int(got.hashes[i].astype(np.int64))
                spelled = bytes(got.data[got.starts[i] : got.ends[i]])
                edges = [256, *spelled, 256]
                total += np.log(n[key]) - words.mass[target - first] if n[key] > 1 else words.once[target - first] + sum(words.spelling[a, b] for a, b in zip(edges, edges[1:], strict=False))
        return total

    got = {r["doc_id"]: r["log_likelihood"] for r in lm.score(plain, model, words, counts).collect()}
    assert got.keys() == texts.keys()
    short = [d for d in texts if len(texts[d]) < 3000]
    assert len(short) > 20 and np.allclose([got[d] for d in short], [slowly(texts[d]) for d in short], rtol=1e-4, atol=1e-3)


def test_messy_documents(messy, empty):
    rows = lm.log_likelihood(messy).collect()
    assert len(rows) == 11
    assert all((r["log_likelihood"] is None) == (r["doc_id"] == 3 or r["doc_id"] is None and r["n_words"] == 0) for r in rows)
    assert len({r["log_likelihood"] for r in rows if r["doc_id"] == 1}) == 1
    assert lm.log_likelihood(empty).count() == 0
