import pytest
from pyspark.sql import functions as F

LONG = "Pathétique words, again and again: " * 6000  # 200,000 characters and more
#: A long text of many lines, as comments, with candidates of every kind.
LINES = "\n".join(f"# line {k} of a very long text, call +1 (375) 555-{k:04} or 10.0.{k % 256}.{k % 200} (id a{k})" for k in range(4000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, repeated ids, and clashing columns."""
    rows = [(1, "the cat sat on the mat and looked at the dog", "s1"), (2, None, "s1"), (3, "", None), (4, " \t\n ", "s2"),
            (5, LONG, "s2"), (6, "one line\nthe cat sat on the mat and looked at the dog\nlast", None), (7, "one line\nend", "s3"),
            (7, "one line\nend", "s3"), (7, "one line\nother end", "s3"), (None, "no id here", "s1"), (None, None, None),
            (8, "mail a.b@c-d.example.org, call +1 (375) 555-4393 or 10.0.0.1", "s9"), (9, "😀 ünïcode 😀 x@y.z", "s9"),
            (10, LINES, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"lang": F.lit(None).cast("string"), **{c: F.lit("clash") for c in (
        "row", "uid", "size", "place", "score", "node", "bucket", "line", "f0", "task", "length", "kind", "print", "print_", "at", "range", "opens")}})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
