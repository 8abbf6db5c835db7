import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, _key bigint"
BASE = " ".join(f"word{i} Zug{i % 7}" for i in range(60))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and white texts, ties, repeated rows and ids, clashing names, near copies."""
    near = BASE.replace("word30", "other")
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, near, "en", "b"), (3, near, "en", "b"), (4, "", "de", "b"), (5, None, None, None), (6, "  \n\t ", "de", None), (None, "loose words here", "en", "a"),
        (None, BASE + " tail", "en", "c"), (7, "one", "en", "c"), (8, "One", "en", "c"), (9, "x " * 3000 + "end", "fr", "a"), (10, "Ünïcödé 😀 text's 'll ١٢   done\r\n\n", "fr", "b"), (11, "line\nline\nother line", "en", "b"), (7, "another text of id seven", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "clash", "clash", 1) for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    """An empty table."""
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
