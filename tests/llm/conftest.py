import pytest

#: Null and empty texts, a very long one, blanks only, ties and repeated rows; columns whose names operators use inside.
LONG = " ".join(f"word{i % 977} filler{i % 313}" for i in range(6000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, " \n\t ", "de", "b"),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b"),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b"),
    (6, LONG, "en", None),
    (7, "Écoute « ça » ÉTÉ — naïve 漢字 😀 tail", "fr", "a"),
    (None, "A row without an id.", None, "a"),
    (None, None, None, None),
    (9, "12345 !!! 67", "en", "a"),
]
CLASHING = {"key": "'k'", "pos": "7", "score": "'s'", "comp": "'c'", "block": "'b'", "node": "'n'", "term": "0", "line": "''", "size": "-1", "removed": "true"}


@pytest.fixture(scope="session")
def nasty(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return rows.selectExpr("*", "cast(length(text) as long) AS n_chars", *(f"{v} AS {k}" for k, v in CLASHING.items()))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 10)] + [(None, 1, 0), (4, None, None), (5, 1, 1), (5, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
