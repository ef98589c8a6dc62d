"""Row-wise jobs over arriving data. There is no state and no window: each row is answered alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reckoner.functions.text import response_text
from reckoner.operators.decide import resolve, with_parsed
from reckoner.schema import RESPONSES


def stream_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of responses as they arrive in a folder."""
    return spark.readStream.schema(RESPONSES).json(path)


def score_stream(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Arriving responses to (truth, prediction) by an inner join with the finished pair table."""
    answered = responses.join(pairs, "pair_id").withColumn("response_text", response_text(F.col("choices")))
    return resolve(with_parsed(answered))
