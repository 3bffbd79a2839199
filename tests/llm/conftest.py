"""The session of the suite, and a table whose other columns clash with names used inside the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def texts(spark):
    """rows -> DataFrame(doc_id, text) with further columns named like inner ones of the operators."""

    def build(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.select("doc_id", F.lit("x").alias("id"), F.lit(1).alias("n"), "text", F.lit("y").alias("h"), F.lit(0).alias("part"), F.lit(2.0).alias("score"))

    return build
