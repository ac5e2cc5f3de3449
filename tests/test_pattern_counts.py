"""Counts of the general rules."""

from lectern.plans.registry import QUERIES


def test_all_general_rules_are_counted(spark, tmp_path):
    spark.createDataFrame([("call 1-555-123-4567 or 555-123-4567",), ("a@b.example on 2020-01-02",), (None,)], "text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.rule: r.n for r in QUERIES["pattern_counts_general"](spark, str(tmp_path)).collect()}
    assert got == {"email": 1, "phone_us": 2, "url": 0, "date_iso": 1}
