import pytest
from pyspark.sql import functions as F

from reckoner.llm.common import on_workers

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(5000))
#: (doc_id, text, lang, source): NULLs in every column, empty and very long texts, ties, repeated rows.
ODD = [(1, "All rights reserved.", "en", "a"), (1, "All rights reserved.", "en", "a"), (2, None, "en", None), (None, "one two three four", None, "b"),
       (3, "", None, ""), (4, LONG, "de", "b"), (5, " \n\t ", "fr", "a"), (6, "one two three four", "en", "b"), (7, "é. a  b c\n\nd.", "fr", "c"), (None, None, None, None)]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with columns whose names clash with those of the operators."""
    extra = ["_id", "_digest", "size", "piece", "length", "target", "key", "fp", "n", "score", "_score", "_text", "part", "ids"]
    return on_workers(spark).createDataFrame(ODD, COLUMNS).withColumn("n_chars", F.length("text").cast("long")).select("*", *[F.lit(7).alias(c) for c in extra])


@pytest.fixture(scope="session")
def none(spark):
    """Documents without a row."""
    return on_workers(spark).createDataFrame([], COLUMNS + ", n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return on_workers(spark).read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
