import pytest
from pyspark.sql import functions as F

from skyquarry.operators import instants


@pytest.mark.parametrize("most", [1, 20_000])
def test_each_source_has_its_own_weights(spark, monkeypatch, most):
    """A feed in milliseconds beside a larger one in seconds, however many sources are broadcast."""
    monkeypatch.setattr(instants, "MOST_SOURCES", most)
    ids = spark.range(9000)
    df = ids.select("id", F.when(F.col("id") < 6000, "s").otherwise("ms").alias("f"), F.when(F.col("id") < 6000, F.col("id") + 1_000_000_000).otherwise(F.col("id") + 1_000_000_000_000).cast("string").alias("v"))
    df = df.unionByName(spark.createDataFrame([(9001, "s", "1000000000"), (9002, "ms", "1000000000")], "id long, f string, v string"))
    got = {r.id: (r.utc_ms, r.fmt) for r in instants.to_utc(df, "id", F.col("v"), F.col("f"), numbers="feed").collect()}
    assert len(got) == 9002 and got[9001] == (1_000_000_000_000, "unix s") and got[9002] == (1_000_000_000, "unix ms")
