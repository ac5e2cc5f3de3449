"""Labels of long chains of names."""

from lectern.llm.names import components


def test_components_of_a_long_chain(spark):
    chain = [(f"s{i:02d}", f"e{i + k:02d}", 1.0) for i in range(15) for k in (0, 1)]
    got = components(spark.createDataFrame(chain, "spelling string, entity_id string, score double")).select("component").distinct().collect()
    assert [r.component for r in got] == ["e00"]
