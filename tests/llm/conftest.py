import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1, 0.5),
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1, 0.5),
        (2, "", "en", "a", 0, None),
        (3, None, None, None, None, None),
        (None, "a text whose row has no id at all but has words enough to matter here", "en", "b", 9, 0.1),
        (4, " \n\t ", "en", None, 4, 0.1),
        (5, LONG, "en", "b", len(LONG), 0.2),
        (6, "short", None, "b", 5, 0.3),
        (7, "The QUICK brown fox, jumps over the lazy dog near the river bank today!", "en", None, 71, 0.4),
        (7, "another text under an id that is used twice, mail me at a.b@c.example.com", "en", "a", 70, 0.4),
        (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, jaccard double").selectExpr("*", "1 as lane", "'x' as key", "2 as size", "0.0 as expected_grade", "'y' as _path")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
