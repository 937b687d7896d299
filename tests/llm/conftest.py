import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 6000


@pytest.fixture(scope="session")
def messy():
    """(doc_id, text): null and empty texts, a very long one, copies, near copies and repeated rows."""
    base = " ".join(f"word{i}" for i in range(120))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, base), (7, base.upper()), (8, base.replace("word60", "other")), (9, LONG),
        (10, base + " tail"), (11, "é" * 500), (12, "É" * 500), (13, "a b c\x0bd"), (14, "4111 1111 1111 1111 on 2024-02-29 from 10.0.0.1"), (14, "4111 1111 1111 1111 on 2024-02-29 from 10.0.0.1"), (None, "nobody"), (None, "nobody"),
    ]


@pytest.fixture(scope="session")
def messy_df(spark, messy):
    """The same with further columns, of names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy, "doc_id long, text string")
    for name in ("id", "h", "fp", "key", "normal", "n", "head", "zone", "doc", "start", "end", "length", "piece", "shard", "row", "ids", "tie", "sketch", "kept", "slot", "offset", "_found", "_new", "lang"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty_df(messy_df):
    return messy_df.limit(0)
