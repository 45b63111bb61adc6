import pytest

from rowferry.llm.queries import prepare

LONG = "A long tale of many words. " * 8000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nThe quick brown fox jumps over the lazy dog.", "en", "a"),
    (2, None, None, None), (3, "", "en", None), (4, LONG, "en", "a"), (5, LONG, "en", "b"), (5, LONG, "en", "b"),
    (None, "text without an id", "en", "a"), (7, "   \n\t ", None, "b"), (8, "élan 漢字 🙂 x <|endoftext|>", "fr", "c"),
    (9, "one", "en", "c"), (10, "one", "en", "c"),
]
CLASHING = ("ids score size taken keep_id group_size kept n_tokens n_bytes text_sha256 license path failed_bits n_words class_id "
            "n_links spans predicted decoded target copies").split()


@pytest.fixture(scope="session")
def docs_of(spark):
    prepare(spark)

    def build(rows, clashing=False):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        if clashing:
            df = df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])
        return df

    return build


@pytest.fixture(scope="session")
def documents(spark, folder):
    prepare(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")
