"""Functions, query languages and sources on their own."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions.text import filter_text, filter_text_of_number, fold_column, osa, osa_column, osa_many, osa_possible, osa_within_one, words, words_column
from docquarry.operators.postings import postings, vocabulary, vocabulary_of
from docquarry.plans.query import SearchRequest, max_typos, parse_facets, parse_filters, parse_query, parse_sort, parse_vector
from docquarry.plans.settings import Settings, TypoTolerance
from docquarry.sources import scratch
from docquarry.sources.documents import MAX_BODY_BYTES, bodies, decode_body, generated_products, read_json
from docquarry.sources.index import Index

PAIRS = [("", "", 0), ("a", "", 1), ("", "a", 1), ("hello", "hello", 0), ("teh", "the", 1), ("hello", "helo", 1), ("hello", "helllo", 1), ("kitten", "sitting", 3), ("godfather", "godfahter", 1), ("ca", "abc", 3), ("abcd", "badc", 2)]


@pytest.mark.parametrize(("a", "b", "d"), PAIRS)
def test_distance(a, b, d):
    assert osa(a, b) == osa(b, a) == d


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abü", max_size=7), st.text("abü", max_size=7)), max_size=12))
def test_many_distances_are_those_of_one(pairs):
    assert osa_many(pairs).tolist() == [osa(a, b) for a, b in pairs]


def test_distance_columns(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    rows = []
    for _ in range(600):
        a = word()
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "b"])
        rows.append((a, "".join(b) if rng.random() < 0.8 else word()))
    rows += [(a, b) for a, b, _ in PAIRS]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", osa_column(a, b).alias("d"), osa_within_one(a, b).alias("one"), osa_possible(a, b, 2).alias("two")).collect()
    assert all(r["d"] == osa(r["a"], r["b"]) and r["one"] == (r["d"] <= 1) and (r["two"] or r["d"] > 2) for r in got)


def test_search_with_two_typos(spark, tmp_path):
    docs = spark.createDataFrame([("1", "encyclopedia"), ("2", "encyclopaedia"), ("3", "bicycle")], "doc_id string, text string")
    index = Index.build(docs, Settings(), f"file://{tmp_path}/i")
    for query, fuzziness, found in (("encyclpoeida", "", {"1": 10.0 - 2}), ("encyclopedai", "", {"1": 9.0, "2": 8.0}), ("encyclpoeida", "1", {}), ("bicylce", "2", {"3": 9.0})):
        assert {r["doc_id"]: r["score"] for r in index.search([query], fuzziness).collect()} == found, query


def test_many_matched_terms_are_joined(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"ab{i} abc") for i in range(40)], "doc_id string, text string")
    index = Index.build(docs, Settings(), f"file://{tmp_path}/i")
    expected = sorted(map(tuple, index.search(["ab", "ab7 abc"]).collect()))
    monkeypatch.setattr("docquarry.sources.index.LOOKUP_TERMS", 3)
    assert sorted(map(tuple, index.search(["ab", "ab7 abc"]).collect())) == expected and len(expected) > 40


TEXTS = ["Café crème", "O'Connor's ½ x² naïve", "Ａｂｃ ÅNGSTRÖM", "e\u0301tude \u0301 x", "", " ", "ΑΣ", "ǅ ß ﬁ", "भाषा", "a_b-c.d", "漢字 かな", "İstanbul"]


def test_words_of_columns_and_strings(spark):
    got = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select("t", words_column(F.col("t")).alias("w"), fold_column(F.col("t")).alias("f")).collect()
    for r in got:
        if r["t"] is None:
            assert r["w"] is None
        elif "Σ" not in r["t"] and "İ" not in r["t"]:
            assert r["w"] == words(r["t"]), r["t"]


NUMBERS = [0.0, 1.0, 100.0, 1.5, -2.5, 1e7, 12345678.0, 1.25e10, 1e21, 1e26, 1e30, 123456789.125, 1e-3, 1.5e-7, -1e-300, 1.7976931348623157e308, 0.1 + 0.2]


def test_number_texts(spark):
    values = [*NUMBERS, math.nan, math.inf, -math.inf]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").select("i", filter_text_of_number(F.col("x")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: filter_text(v) for i, v in enumerate(values)}
    assert [filter_text(x) for x in (100.0, 1e30, 1.5, 0.0, -2.5e-7, 1200.0)] == ["1", "1", "1.5", "", "-0.00000025", "12"]


@pytest.mark.parametrize(
    ("raw", "must", "any_of", "exclude"),
    [
        ("a b", ["a", "b"], [], []), ("a OR b", [], ["b", "a"], []), ("sci-fi OR drama", ["sci"], ["drama", "fi"], []), ("a OR", ["a", "or"], [], []),
        ("OR a", [], ["a"], []), ("a -b-c", ["a"], [], ["b", "c"]), ("a - b", ["a", "b"], [], []), ("OR the", ["or"], [], []), ("a or b", ["a", "or", "b"], [], []),
    ],
)
def test_boolean_queries(raw, must, any_of, exclude):
    got = parse_query(raw, frozenset({"the"}))
    assert [list(got.must), list(got.any_of), list(got.exclude)] == [must, any_of, exclude]


def test_typo_budgets():
    typo = TypoTolerance()
    assert [max_typos("x" * n, typo) for n in (1, 3, 4, 7, 8, 20)] == [0, 0, 1, 1, 2, 2]
    assert [max_typos("x", typo, f) for f in ("0", "1", "2", "AUTO")] == [0, 1, 2, 0]
    assert max_typos("x" * 9, TypoTolerance(enabled=False)) == 0 and max_typos("x" * 9, TypoTolerance(enabled=False), "2") == 2
    assert max_typos("ööööö", TypoTolerance(True, 5, 6)) == 1


def test_small_languages():
    assert [(f.field, f.operator, f.value) for f in parse_filters("a>=1, b != x ,distance(_geo,1,2)<5,junk,c:d,=e")] == [("a", ">=", "1"), ("b", "!=", "x"), ("distance(_geo,1,2)", "<", "5"), ("c", "=", "d")]
    assert parse_sort("a:desc,b,c:DESC,d:up") == [("a", True), ("b", False), ("c", True), ("d", False)] and parse_sort("") == []
    assert parse_facets("a,b,a") == ["a", "b"] and parse_facets("") == []
    assert parse_vector("1, x,2.5,,-3e1") == [1.0, 2.5, -30.0] and parse_vector("") == []


def test_requests():
    request = SearchRequest.of({"q": "url", "limit": "7", "offset": "4", "facets": "a,b", "vector": "1,2"})
    assert (request.query, request.limit, request.offset, request.facets, request.vector) == ("url", 7, 4, "a,b", (1.0, 2.0))
    merged = SearchRequest.of({"q": "url", "filter": "x=1", "limit": "7", "offset": "4"}, {"q": "body", "limit": 3, "facets": ["c", "d"], "vector": [3, 4]})
    assert (merged.query, merged.filter, merged.limit, merged.offset, merged.facets, merged.vector) == ("body", "x=1", 3, 0, "c,d", (3.0, 4.0))
    assert SearchRequest.of({"limit": "nonsense", "offset": "-3"}).limit == 20 and SearchRequest.of({"limit": "5000"}).limit == 1000
    assert SearchRequest(query="é" * 500).checked()
    with pytest.raises(ValueError):
        SearchRequest.of({"q": "é" * 501})
    for bad in ("3", "auto", "-1"):
        with pytest.raises(ValueError):
            SearchRequest.of({"q": "x", "fuzziness": bad})


def test_bodies_of_requests(spark, tmp_path):
    rows = [('[{"id":"a","n":1},{"_id":"b"},{"id":7},{"id":"","_id":"z"}]',), (' {"id":"c"}',), ("{broken",), (None,), ("",), ("[]",)]
    assert sorted(r["doc_id"] for r in bodies(spark.createDataFrame(rows, "value string")).collect()) == ["a", "b", "c"]
    (tmp_path / "lines.json").write_text('{"id":"x"}\n\n{"id":3}\nnot json\n{"_id":"y","t":"é"}\n')
    got = {r["doc_id"]: json.loads(r["doc"]) for r in read_json(spark, f"file://{tmp_path}/lines.json").collect()}
    assert got == {"x": {"id": "x"}, "y": {"_id": "y", "t": "é"}}
    (tmp_path / "file.json").write_text('[\n {"id":"p"},\n {"id":"q"}\n]')
    assert sorted(r["doc_id"] for r in read_json(spark, f"file://{tmp_path}/file.json", whole_file=True).collect()) == ["p", "q"]
    with pytest.raises(ValueError):
        decode_body(b" " * (MAX_BODY_BYTES + 1))


def test_generated_products_follow_from_their_number(spark):
    a, b = (generated_products(spark, n).where("doc_id = 'prod_41'").collect() for n in (50, 5000))
    assert a == b and generated_products(spark, 120).select("doc_id").distinct().count() == 120


def test_the_shared_folder_is_the_sessions(spark, monkeypatch):
    assert scratch.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Session:
        def __init__(self, **conf):
            self.values, self.conf = {k.replace("_", "."): v for k, v in conf.items()}, self

        def get(self, key, default=None):
            return self.values.get(key, default)

    with pytest.raises(ValueError):
        scratch.shared_dir(Session(spark_master="yarn"), "x")
    assert scratch.shared_dir(Session(spark_master="local[2]"), "x").startswith("file:///")


def test_vocabulary_without_postings(spark):
    """Marks after a space, a final sigma, spaces of other kinds, stop words and synonyms."""
    texts = ["ΟΔΟΣ ΟΔΟΣ. ΣΟΦΟΣ,ΣΑ", " \u0301e \u0301", "größer\u00a0Über\tstraße  x-1", "", None, "the Cold\ncold-ICE the", "a" * 300]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for settings in (Settings(), Settings(searchable_fields=("text",), stop_words=frozenset({"the"}), synonyms={"cold": ("cool",), "the": ("not",)})):
        expected = sorted(r["term"] for r in vocabulary(postings(docs, settings)).collect())
        assert sorted(r["term"] for r in vocabulary_of(docs, settings).collect()) == expected and len(expected) > 8


def test_similar_terms_need_no_postings(spark, monkeypatch):
    """The terms of a folder whose index is not built come from its vocabulary alone."""
    from docquarry import queries

    monkeypatch.setattr(queries, "_INDEXES", {})
    assert queries.fuzzy_terms_k1(spark, "/root/testdata/sf0.001").count() > 0 and not queries._INDEXES
    assert queries.edit_distances(spark, "/root/testdata/sf0.001").count() > 0 and not queries._INDEXES
