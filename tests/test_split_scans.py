"""How often a split reads its table."""

from pyspark.sql import functions as F

from logsieve.operators import split as sp


def test_splits_read_the_hashed_table_twice(spark):
    """Once to store the hashes, once for the flags: all passes are over the stored hashes."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(v):
        read.add(1)
        return str(v % 40)

    table = spark.range(1200).select("id", key.asNondeterministic()("id").alias("k"), (F.col("id") % 3).alias("label"))
    flags = sp.stratified_split(table, "k", test_size=0.25)
    assert read.value <= 1200
    assert {r.label: r.n for r in flags.groupBy("label").agg(F.count_if("is_train").alias("n")).collect()} == dict.fromkeys(range(3), 300)
