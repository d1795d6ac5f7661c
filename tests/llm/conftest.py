import pytest

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, a very long text, ties and repeated rows."""
    sentence = "One two three four five six seven eight nine ten eleven twelve words stand here now. "
    return [
        (1, None, "en", "s", None),
        (2, "", None, "s", 0),
        (3, " \t\n ", "en", None, 4),
        (4, "word", "en", "s", 4),
        (5, "two  Words", "en", "s", 10),
        (6, "two words", "en", "s", 9),
        (6, "two words", "en", "s", 9),
        (7, sentence * 3000, "en", "s", 1),
        (None, sentence, "en", "s", 1),
        (None, "two words", "en", "s", 1),
        (8, "a b\tc\n", "en", "s", 1),
        (9, "ab c  ", "en", "s", 1),
        (10, "x" * 5000 + " 'tis 12345 été 　 한글 \U0001f600\x1c!  ?\n\n end ", "en", "s", 1),
        (11, "".join(chr(0x4E00 + i * 7 % 9000) for i in range(3000)), "zh", "s", 1),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, KIND)
    from pyspark.sql import functions as F

    for name in ("fp", "key", "sha", "body", "blob", "path", "block", "word", "votes", "score", "kept", "spans", "root"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
