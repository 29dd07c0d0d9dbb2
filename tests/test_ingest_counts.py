from pyspark.sql import Observation

from leadloom.operators import ingest


def test_counts_come_from_the_pass_that_writes(spark):
    rows = [("Acme", " "), ("B", "b.io"), ("C", None), ("D", "d.io"), ("E", "")]
    for raw in (spark.createDataFrame(rows, "Company string, Website string").repartition(3), spark.createDataFrame([], "Company string, Website string")):
        seen = Observation("intake")
        out = ingest.ingest(raw, 1, "b", counts=seen)
        want = ingest.ingest_counts(ingest.pick_columns(raw)).first().asDict()
        assert seen.get == want and out.count() == want["inserted"]
