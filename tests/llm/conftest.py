import pytest

#: Names that operators use inside: an input may have columns called so.
CLASH = "key rep blob score piece length digest row spans items base kept bits token gram n a b u v g".split()


def prose(k: int, n: int = 60) -> str:
    return " ".join(f"w{k}x{i * 7 % 53}" for i in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang): nulls, empty, blank, no letters, ties, repeated rows, a very long text."""
    long_text = "\n".join(prose(9, 80) + f" line {i}." for i in range(1500))
    return [
        (1, None, "en"), (2, "", "en"), (3, " \t\n\x0b ", None), (4, "12 34 !!", "en"), (None, prose(1), "en"), (5, prose(1), "en"), (6, prose(1), None),
        (6, prose(1), None), (7, long_text, "fr"), (8, "é ß 漢字   x", "de"), (9, "one two", "fr"), (10, "ONE two", None), (11, "a" * 5000, "de"),
    ]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if clash:
        from pyspark.sql import functions as F

        for c in CLASH:
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, edge_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
