"""The divergence gate keeps every divergent pair."""

from tallyloom.operators import divergence
from tallyloom.plans import gates


def test_all_divergent_pairs(spark, tmp_path):
    def parser(value):
        return f"CARD {{ X {{ {value} }} }}", None

    one, two = [f"a{k:03}" for k in range(101)], [f"b{k:03}" for k in range(100)]
    items = spark.createDataFrame([(i, i, "ONE") for i in one] + [(i, i, "TWO") for i in two], "item string, name string, source string")
    encoded = divergence.encode(items, parser, "source").cache()
    asked = spark.createDataFrame([(a, b) for a in one for b in two], "a string, b string")
    found = gates.run_divergence({"numeric": asked}, encoded, str(tmp_path))["divergent"]
    assert found["count"] == 10_100
    written = spark.read.option("header", True).csv(found["path"])
    assert written.count() == 10_100 and written.columns == ["source", "name_a", "name_b", "note", "canonical_a", "canonical_b"]
    assert len(gates.run_divergence({"numeric": asked}, encoded)["divergent"]) == 10_100
