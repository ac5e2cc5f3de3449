"""Tables too large to be sent to all workers are refused, not cut."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import subjects


def test_too_many_subjects_raise(spark):
    text = spark.createDataFrame([(1, "aspirin", "default")], "id long, text string, domain string")
    with pytest.raises(ValueError, match="more than 10000"):
        subjects.fit(text, text, spark.range(10_001).select(F.col("id").cast("string").alias("subject")))
