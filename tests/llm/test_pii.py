import itertools
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import pii
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def model():
    return pii.train()


@pytest.fixture(scope="module")
def unseen():
    rng = random.Random(99)
    return [pii.generated_document(rng) for _ in range(150)]


def test_unseen_documents(model, unseen):
    texts, truth = [t for t, _ in unseen], np.concatenate([y for _, y in unseen])
    got = np.concatenate(model.label(texts, [list(range(len(t))) for t in texts]))
    right = ((got == truth) & (truth > 0)).sum()
    assert right / (truth > 0).sum() > 0.9 and right / (got > 0).sum() > 0.9


def test_active_tokens_stand_for_the_whole_graph(model, unseen):
    texts = [t for t, _ in unseen]
    nodes = [pii.active(t) for t in texts]
    whole = model.label(texts, [list(range(len(t))) for t in texts])
    part = model.label(texts, nodes)
    agree = np.concatenate([w[n] == p for w, n, p in zip(whole, nodes, part, strict=True) if n])
    assert agree.mean() > 0.99


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary, pair = rng.normal(size=(3, pii.K)), rng.normal(size=(3, pii.K, pii.K))
    edges = np.array([[0, 1, 0], [1, 2, 2]])
    joint = unary[0][:, None, None] + unary[1][None, :, None] + unary[2] + pair[0][:, :, None] + pair[2][None]
    p = np.exp(joint)
    p /= p.sum()
    node, _ = pii.propagate(unary, edges, pair, rounds=60)
    assert np.allclose(node, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-6)


def test_skip_edges_join_distant_repeats():
    tokens = ["+1", "(555)", "123-4567", *["word"] * 500, "123-4567", "987-6543"]
    nodes = [0, 1, 2, 503, 504]
    got = pii.skip_edges(tokens, nodes).tolist()
    assert [2, 3, pii.SAME] in got and [3, 4, pii.ALIKE] in got


def test_skip_edges_against_a_walk(unseen):
    """The nearest earlier token of the same text, or with it as a piece, or of a like shape."""
    for tokens, _ in unseen[:60]:
        nodes, expected = [i for i, t in enumerate(tokens) if pii.evident(t)], []
        for n, i in enumerate(nodes):
            text, form = pii.skip_keys(tokens[i])
            keys = [pii.skip_keys(tokens[j]) for j in nodes[:n]]
            same = [m for m, (t, _) in enumerate(keys) if t == text]
            part = [m for m, (t, _) in enumerate(keys) if text in re.findall(r"[0-9a-z]{4,}(?:-[0-9a-z]{4,})*", t)]
            alike = [m for m, (_, f) in enumerate(keys) if f == form]
            if hit := same or part or alike:
                expected.append([hit[-1], n, pii.SAME if same or part else pii.ALIKE])
        assert pii.skip_edges(tokens, nodes).tolist() == expected


def test_labels_against_all_labelings_where_there_is_no_loop(model):
    """Documents whose graph is a tree: every labeling is tried."""
    for text in ("mail jane.roe@site.example.com", "call (555) 123-4567 now", 'token = "9f86d081884c7d659a2feaa0c55ad015"', "from 10.20.30.40 to 1999", "it cost 17 euros"):
        tokens = text.split()
        nodes = pii.active(tokens)
        graph = model.graph([tokens], [nodes])
        assert len(graph.edges) < len(nodes)
        unary, best = graph.unary(model.weights), []
        labelings = np.array(list(itertools.product(range(pii.K), repeat=len(nodes))))
        weight = unary[np.arange(len(nodes)), labelings].sum(1)
        for a, b, kind in graph.edges.tolist():
            weight += model.pair[kind, labelings[:, a], labelings[:, b]]
        p = np.exp(weight - weight.max())
        best = [np.bincount(labelings[:, n], p, pii.K).argmax() for n in range(len(nodes))]
        assert model.label([tokens], [nodes])[0].tolist() == best


def test_a_clear_mention_reaches_all_its_repeats(model):
    """However many there are, and a fragment's own evidence is the same each time."""
    text = "+1 (555) 123-4567 and " + "words go by and 123-4567 again " * 60
    spans = pii.find(pa.array([text]), model)[0]
    assert len(spans) == 61 and {y for _, _, y in spans} == {pii.PHONE}


@pytest.mark.parametrize(
    ("text", "label", "entity"),
    [
        ("Please write to Maria Lopez at maria.lopez-77@correo.ejemplo.es before Friday.", pii.EMAIL, "maria.lopez-77@correo.ejemplo.es"),
        ("Bei Fragen: +49 30 1234567 (werktags bis 18 Uhr).", pii.PHONE, "+49 30 1234567"),
        ("The card 4111111111111111 was declined twice in the shop.", pii.CARD, "4111111111111111"),
        ("Access was logged from 192.168.17.254 at the gateway.", pii.IP, "192.168.17.254"),
        ('export api_key = "d41d8cd98f00b204e9800998ecf8427e" # remove', pii.SECRET, "d41d8cd98f00b204e9800998ecf8427e"),
        ('set token = "qwmzxkvjplthrgnbdfcsyqkzxwvjmplt" first', pii.SECRET, "qwmzxkvjplthrgnbdfcsyqkzxwvjmplt"),
    ],
)
def test_texts_that_the_generator_did_not_write(model, text, label, entity):
    spans = pii.find(pa.array([text]), model)[0]
    assert [(text.encode()[a:b].decode(), y) for a, b, y in spans] == [(entity, label)]


@pytest.mark.parametrize("text", ["In 1998 about 2,300 people lived there, 17.5 % more than in 1990.", "die Donaudampfschifffahrtsgesellschaftskapitaene reisen", "§ 12 Abs. 3 Nr. 4 des Gesetzes vom 01.02.2003", "see chapter 3.2.1 and figure 7", "a well-known-but-seldom-mentioned-detail remains"])
def test_harmless_texts(model, text):
    assert pii.find(pa.array([text]), model) == [[]]


def test_digits_of_other_scripts_and_odd_numbers(model):
    texts = ["1.2.3.²", "1.2.3." + "5" * 5000, "call +٤٤ ٢٠ ٧٩٤٦٠٩٥٨ now", "٣", "999.999.999.999"]
    found = pii.find(pa.array(texts), model)
    assert found[2] and len(found) == 5 and not found[3]
    # what is looked at is what the predicate names, in every script
    words = "plain ٣ x² naïve １２ क ०९ über a@b Straße 7 token_of_twenty_letters Фёдор ⅷ ①".split()
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = ends - [len(w.encode()) for w in words]
    assert pii._evident(raw, data, starts, ends).tolist() == [i for i, w in enumerate(words) if pii.evident(w)]


def test_a_long_row_of_numbers_takes_bounded_memory():
    code = """
import random, resource, pyarrow as pa
from docquarry.llm import pii
from tests.llm.conftest import SF
model, rng = pii.train(), random.Random(1)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
text, before = " ".join(str(rng.randrange(10 ** rng.randint(1, 16))) for _ in range(120_000)), peak()
pii.find(pa.array([text]), model)
print((peak() - before) / (len(text) / 1e6))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert float(said.stdout.split()[-1]) < 120  # MB for a MB of text


def test_distant_mention_in_a_long_text(model):
    text = "mail jane.roe@site.example.com now " + "filler words go on " * 20_000 + "jane.roe@site.example.com"
    spans = pii.find(pa.array([text, None, ""]), model)
    assert [y for _, _, y in spans[0]] == [pii.EMAIL] * 2 and spans[1:] == [[], []]
    assert "jane" not in pii.redacted(text, spans[0])


def test_query_against_whole_graphs(spark, docs, model):
    """Every document on its own, all its tokens in the graph, against the query's spans and texts."""
    from docquarry.llm.queries import op10_pii

    got = {r["doc_id"]: r for r in op10_pii(spark, SF).collect()}
    agree = 0
    for r in docs.collect():
        tokens = r["text"].split()
        labels = model.label([tokens], [list(range(len(tokens)))])[0] if len(tokens) < 1500 and tokens else np.zeros(0, int)
        if len(tokens) < 1500:
            agree += bool(labels.any()) == (r["doc_id"] in got)
        else:
            agree += 1
    assert agree >= 0.99 * docs.count() and got
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, r in got.items():
        parts, at = [], 0
        for e in r["entities"]:
            assert at <= e["start"] < e["end"]
            parts += [texts[d][at : e["start"]], f"[{e['label']}]"]
            at = e["end"]
        assert "".join([*parts, texts[d][at:]]) == r["redacted_text"] and r["n_entities"] == len(r["entities"])


def test_messy_documents(messy, empty, model):
    out = pii.redact(messy, model)
    assert out.schema == messy.schema and out.count() == 11 and pii.redact(empty, model).count() == 0
    key = lambda r: (r["doc_id"] or -1, r["text"] or "")
    before, after = (sorted(df.collect(), key=key) for df in (messy, out))
    changed = [(a, b) for a, b in zip(before, after, strict=True) if a["text"] != b["text"]]
    assert [b["text"][-7:] for _, b in changed] == ["[EMAIL]"] and changed[0][1]["n_chars"] == len(changed[0][1]["text"])
    found = pii.entities(messy, model).collect()
    assert [(r["doc_id"], r["n_entities"]) for r in found] == [(7, 1)] and pii.entities(empty, model).count() == 0
