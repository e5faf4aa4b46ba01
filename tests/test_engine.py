"""The engine from the outside: search semantics, filters, facets, sorts, changes, recovery."""

import json

import pytest

from docquarry.engine import Engine, IndexExists, NoIndex, ResultCache
from docquarry.operators.filters import apply_filters
from docquarry.plans.query import SearchRequest, parse_filters
from docquarry.plans.settings import Settings
from docquarry.sources.documents import decode_body, document_id
from docquarry.streaming.ingest import stream_into

TITLES = Settings(searchable_fields=("title",))
CORPUS = [{"id": "1", "title": "The Matrix"}, {"id": "2", "title": "The Godfather"}, {"id": "3", "title": "Goodfellas"}]


@pytest.fixture(scope="module")
def films(spark, tmp_path_factory):
    engine = Engine.open(spark, str(tmp_path_factory.mktemp("films")))
    engine.create_index("films", TITLES)
    assert engine.add_documents("films", CORPUS) == (3, 0)
    return engine


def scores(engine, name, query, **options):
    return [(h["id"], h["score"]) for h in engine.search(name, query, **options).hits]


@pytest.mark.parametrize(
    ("query", "options", "expected"),
    [
        ("matrix", {}, [("1", 12.0)]),
        ("matrx", {}, [("1", 9.0)]),
        ("matrx", {"fuzziness": "0"}, []),
        ("mat", {"fuzziness": "0"}, [("1", 7.0)]),
        ("godfahter", {}, [("2", 9.0)]),
        ("teh", {"fuzziness": "1"}, []),
        ("matrix matrix", {}, [("1", 24.0)]),
        ("the OR matrix", {}, [("1", 24.0), ("2", 12.0)]),
        ("godfather the OR matrix", {}, [("1", 24.0), ("2", 24.0)]),
        ("the -matrix", {}, [("2", 12.0)]),
        ("-matrix", {}, []),
        ("", {}, []),
    ],
)
def test_scores(films, query, options, expected):
    assert scores(films, "films", query, **options) == expected


def test_batch_gives_what_single_queries_give(films):
    queries = ["matrix", "the", "godfahter", "the -matrix", "nothing"]
    rows = films.scores("films", queries).collect()
    for i, query in enumerate(queries):
        assert sorted((r["doc_id"], r["score"]) for r in rows if r["query_id"] == i) == sorted(scores(films, "films", query))


def test_exact_search_and_highlights(films):
    assert films.search_exact("films", "the matrix") == ["1"]
    hit = films.search("films", "godfahter").hits[0]
    assert hit["highlights"] == {"title": "The <em>Godfather</em>", "id": "2"}


def test_cache_returns_the_same_result_until_a_change(films):
    request = SearchRequest(query="goodfellas")
    first = films.search("films", request)
    assert films.search("films", request) is first


def test_weights_synonyms_and_displayed_fields(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("shop", Settings(searchable_fields=("name", "description"), field_weights={"name": 5.0, "description": 1.0}, synonyms={"apple": ("pomme", "red fruit")}, displayed_fields=("name",)))
    engine.add_documents("shop", [{"id": "1", "name": "apple", "description": "x"}, {"id": "2", "name": "pear", "description": "apple colored"}])
    assert scores(engine, "shop", "apple") == [("1", 60.0), ("2", 12.0)]
    assert scores(engine, "shop", "pomme") == [("1", 60.0), ("2", 12.0)]
    assert engine.search("shop", "apple").hits[0]["document"] == {"name": "apple", "id": "1"}


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    engine = Engine.open(spark, str(tmp_path_factory.mktemp("places")))
    engine.create_index("p", Settings(searchable_fields=("title",)))
    docs = [
        {"id": "a", "title": "place Milano", "genre": "Sci-Fi", "year": 1999, "ok": True, "_geo": {"lat": 45.4642, "lng": 9.19}, "_vector": [0.9, 0.1, 0]},
        {"id": "b", "title": "place Roma", "genre": "drama", "year": 2008.5, "ok": False, "_geo": {"lat": "41.9", "lng": 12.49}, "_vector": ["0.1", 0.9, 0]},
        {"id": "c", "title": "place Pisa", "year": "2020", "tags": ["x"], "_vector": ["no", 1, 2]},
        {"id": "d", "title": "place Bari", "genre": None, "year": 100},
    ]
    engine.add_documents("p", docs)
    return engine


@pytest.mark.parametrize(
    ("clause", "ids"),
    [
        ("year>=1999", "abc"), ("year>2000", "bc"), ("genre=sci-fi", "a"), ("genre:DRAMA", "b"), ("genre!=Horror", "ab"), ("rating>4", ""),
        ("genre>drama", "b"), ("year=1999,genre=sci-fi", "a"), ("ok=true", "a"), ("ok!=true", "b"), ("rating!=4", ""), ("nonsense", "abcd"),
        ("distance(_geo,45.46,9.19)<5000", "a"), ("distance(_geo,45.46,9.19)<600000", "ab"), ("distance(_geo,45.46)<5", ""),
    ],
)
def test_filters(places, clause, ids):
    assert sorted(h["id"] for h in places.search("p", "place", filter=clause).hits) == list(ids)


def test_facets_sorts_and_pages(places):
    result = places.search("p", "place", facets="genre,year,none", sort="year:desc", limit=2, offset=1)
    assert result.total_hits == 4
    assert result.facets == {"genre": {"Sci-Fi": 1, "drama": 1}, "year": {"1999": 1, "2008.5": 1, "2020": 1, "100": 1}, "none": {}}
    assert [h["id"] for h in result.hits] == ["a", "d"]  # 2008.5, 1999, 100, then the string
    assert [h["id"] for h in places.search("p", "place", sort="genre,year").hits] == ["c", "d", "a", "b"]
    assert places.search("p", "place", offset=9).hits == []


def test_vectors(places):
    assert [h["id"] for h in places.search("p", "", vector=(1.0, 0.0, 0.0)).hits] == ["a", "b"]
    hybrid = places.search("p", "milano", vector=(1.0, 0.0, 0.0)).hits
    assert hybrid[0]["score"] == pytest.approx(12 + 20 * 0.9 / 0.82**0.5)
    assert places.search("p", "-milano", vector=(1.0, 0.0, 0.0)).total_hits == 2


def test_changes(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("x", TITLES)
    with pytest.raises(IndexExists):
        engine.create_index("x")
    for bad in ("", " ", "a/b", "..", "a" * 256):
        with pytest.raises(ValueError):
            engine.create_index(bad)
    assert engine.add_documents("x", [{"id": "1", "title": "first"}, {"_id": "2", "title": "second"}, {"id": 3}, {"id": "", "_id": "z"}, {"id": "1", "title": "again"}]) == (3, 2)
    assert engine.count("x") == 2
    assert engine.get_document("x", "1") == {"id": "1", "title": "again"}
    assert scores(engine, "x", "first") == []
    engine.delete_document("x", "2")
    engine.delete_document("x", "nobody")
    assert engine.list_documents("x") == ([{"id": "1", "title": "again"}], 1)
    engine.replace_settings("x", {"stop_words": ["again"], "searchable_fields": ["title"]})
    assert scores(engine, "x", "again") == []
    assert not engine.settings("x").typo_tolerance.enabled
    engine.merge_settings("x", stop_words=frozenset())
    assert scores(engine, "x", "again") == [("1", 12.0)]
    assert engine.health() == {"status": "ok", "indexes": 1, "documents": 1}
    assert "Sitemap: http://h/indexes/x/sitemap.xml" in engine.robots("http://h/")
    engine.delete_index("x")
    with pytest.raises(NoIndex):
        engine.search("x", "again")


def test_recovery_folds_the_log(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("x", TITLES)
    engine.add_documents("x", CORPUS)
    saved = (tmp_path / "catalogue.json").read_text()
    engine.add_documents("x", [{"id": "3", "title": "Casino"}, {"id": "4", "title": "Heat"}])
    engine.delete_document("x", "1")
    (tmp_path / "catalogue.json").write_text(saved)  # as if the process had died before saving
    with open(tmp_path / "log" / "zz.json", "w") as f:
        f.write("\nnot json\n")
    again = Engine.open(spark, str(tmp_path))
    assert [d["title"] for d in again.list_documents("x")[0]] == ["The Godfather", "Casino", "Heat"]
    assert scores(again, "x", "heat") == [("4", 12.0)]
    assert again.settings("x") == TITLES
    assert again.truncate_log() > 0
    assert Engine.open(spark, str(tmp_path)).count("x") == 3


def written_bytes(root):
    return sum(f.stat().st_size for f in root.rglob("*") if f.is_file())


def test_a_change_costs_what_it_brings(spark, tmp_path):
    """The bytes of one more document don't depend on what the index holds."""
    grown = []
    for n in (5, 3000):
        root = tmp_path / str(n)
        engine = Engine.open(spark, str(root))
        engine.create_index("x", TITLES)
        engine.add_documents("x", [{"id": f"d{i}", "title": f"title {i} of many words in a row {i * 7}"} for i in range(n)])
        before = written_bytes(root)
        engine.add_documents("x", [{"id": "d1", "title": "another"}])
        engine.delete_document("x", "d2")
        grown.append(written_bytes(root) - before)
        assert engine.count("x") == n - 1 and scores(engine, "x", "another") == [("d1", 12.0)] and engine.search_exact("x", "title 1") == []
    assert grown[1] < 1.2 * grown[0]


def test_segments_are_merged_and_left_files_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("docquarry.engine.TIER", 3)
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("x", TITLES)
    expected = {}
    for i in range(7):
        docs = [{"id": str(j), "title": f"step{i} word{j}"} for j in range(i, i + 3)]
        engine.add_documents("x", docs)
        expected |= {d["id"]: d["title"] for d in docs}
        if i % 3 == 2:
            engine.delete_document("x", str(i))
            del expected[str(i)]
    got, total = engine.list_documents("x")
    assert {d["id"]: d["title"] for d in got} == expected and total == len(expected)
    assert len(engine.catalogue["x"]["segments"]) < 7
    assert engine.search_exact("x", "step4") == [d for d, t in sorted(expected.items()) if t.startswith("step4")]
    engine.compact("x")
    assert len(engine.catalogue["x"]["segments"]) == 1 and not engine.catalogue["x"]["segments"][0]["gone"]
    again = Engine.open(spark, str(tmp_path))
    assert {d["id"]: d["title"] for d in again.list_documents("x")[0]} == expected
    again.delete_index("x")
    again.create_index("y")
    assert not list((tmp_path / "indexes").iterdir())


def test_held_changes_are_one_segment_and_survive_a_crash(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("x", TITLES)
    with engine.hold():
        engine.add_documents("x", CORPUS)
        engine.delete_document("x", "2")
        engine.add_documents("x", [{"id": "1", "title": "Reloaded"}])
        assert engine.count("x") == 0
    assert len(engine.catalogue["x"]["segments"]) == 1
    assert sorted(d["title"] for d in engine.list_documents("x")[0]) == ["Goodfellas", "Reloaded"]
    with pytest.raises(RuntimeError), engine.hold():
        engine.add_documents("x", [{"id": "9", "title": "Heat"}])
        engine.create_index("y")  # saves the catalogue meanwhile
        assert Engine.open(spark, str(tmp_path)).search_exact("x", "heat") == ["9"]  # as after a crash here
        raise RuntimeError
    assert engine.search_exact("x", "heat") == ["9"] and Engine.open(spark, str(tmp_path)).list_indexes() == ["x", "y"]


def test_recovery_of_settings_and_of_deleted_indexes(spark, tmp_path, monkeypatch):
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("x", TITLES)
    engine.add_documents("x", CORPUS)
    engine.create_index("y", TITLES)
    monkeypatch.setattr(engine, "_save", lambda: None)  # from here on as if the process had died before saving
    engine.merge_settings("x", stop_words=frozenset({"the"}))
    engine.delete_index("y")
    engine.create_index("y")
    engine.add_documents("y", [{"id": "1", "title": "Heat"}])
    engine.create_index("z")
    again = Engine.open(spark, str(tmp_path))
    assert again.list_indexes() == ["x", "y", "z"] and again.settings("x").stop_words == {"the"}
    assert again.search_exact("x", "the") == [] and again.search_exact("x", "matrix") == ["1"]
    assert [d["title"] for d in again.list_documents("y")[0]] == ["Heat"] and again.count("z") == 0


def test_a_damaged_catalogue_is_an_error(spark, tmp_path):
    Engine.open(spark, str(tmp_path)).create_index("x")
    (tmp_path / "catalogue.json").write_text('{"seq": 3, "ind')
    with pytest.raises(ValueError):
        Engine.open(spark, str(tmp_path))


def test_health_and_exact_pages(spark, films, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    assert engine.health() == {"status": "ok", "indexes": 0, "documents": 0}
    assert films.health() == {"status": "ok", "indexes": 1, "documents": 3}
    assert films.search_exact("films", "the", limit=1) == ["1"] and films.search_exact("films", "the") == ["1", "2"]


def test_tables_take_the_last_row_of_an_order(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("t", Settings(searchable_fields=("title",)))
    rows = [("a", "first", 1), ("a", "last", 9), ("a", "middle", 5), (None, "lost", 3)]
    engine.add_table("t", spark.createDataFrame(rows, "doc_id string, title string, at long").repartition(3), order="at")
    assert engine.list_documents("t") == ([{"id": "a", "title": "last"}], 1)


def test_filters_of_huge_and_odd_numbers(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("n", Settings(searchable_fields=("title",)))
    engine.add_documents("n", [{"id": str(i), "title": "thing", "price": p} for i, p in enumerate([1e30, 0, -2.5e-7, 100, "abc", True, None])])
    ids = lambda f: sorted(h["id"] for h in engine.search("n", "thing", filter=f).hits)
    assert ids("price!=abc") == ["0", "1", "2", "3", "5"] and ids("price=abc") == ["4"] and ids("price>=1e30") == ["0"]
    typed = spark.createDataFrame([(1, 1e30), (2, float("nan")), (3, float("inf")), (4, 1.5), (5, None)], "k long, x double")
    kept = lambda f: sorted(r["k"] for r in apply_filters(typed, parse_filters(f)).collect())
    assert kept("x!=abc") == [1, 2, 3, 4] and kept("x>2") == [1, 2, 3] or kept("x>2") == [1, 3]


def test_cache(films):
    cache = ResultCache(2)
    for i in range(3):
        cache.put(("x", i), i)
    assert cache.get(("x", 0)) is None and cache.get(("x", 1)) == 1
    cache.put(("y", 0), 5)
    assert cache.get(("x", 2)) is None  # 1 was used since
    cache.invalidate("x")
    assert cache.get(("x", 1)) is None and cache.get(("y", 0)) == 5
    cache.clear()
    assert cache.get(("y", 0)) is None


def test_sitemap(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    engine.create_index("s", Settings.of({"sitemap": {"base_url": "https://e.org/"}}))
    engine.add_documents("s", [{"id": "1", "url": "/p?a=1&b=2"}, {"id": "2"}])
    xml = engine.sitemap("s")
    assert "<loc>https://e.org/p?a=1&amp;b=2</loc>" in xml and "<loc>https://e.org/2</loc>" in xml and "<lastmod>" in xml


def test_streaming_ingest(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path / "root"))
    engine.create_index("x", TITLES)
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(d) for d in CORPUS) + "\n{broken\n")
    for _ in range(2):  # the second run finds nothing new
        stream_into(engine, "x", str(source), str(tmp_path / "cp")).awaitTermination()
        assert engine.count("x") == 3
    (source / "2.json").write_text(json.dumps({"id": "1", "title": "Reloaded"}) + "\n")
    stream_into(engine, "x", str(source), str(tmp_path / "cp")).awaitTermination()
    assert scores(engine, "x", "reloaded") == [("1", 12.0)]
    assert scores(engine, "x", "matrix") == []


def test_bodies_and_ids():
    assert decode_body('[{"id":"a"}]') == [{"id": "a"}]
    assert decode_body('{"id":"a"}') == [{"id": "a"}]
    with pytest.raises(ValueError):
        decode_body('{"id":"a"}', array_only=True)
    assert [document_id(d) for d in ({"id": "a"}, {"_id": "b"}, {"id": 1, "_id": "b"}, {"id": ""}, 7)] == ["a", "b", None, None, None]
