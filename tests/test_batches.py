"""What runs in Python for a query gets batches of bounded bytes, whatever the table's partitions hold."""

from pyspark.sql import functions as F

from ragframe.plans.registry import table
from ragframe.sources import store

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def _measured(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})


def _large(spark):
    return spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text")).mapInArrow(_measured, "n long")


def test_tables_are_written_with_small_batches(spark):
    spark.conf.set(LIMIT, 1 << 26)
    try:
        sizes = [r.n for r in store.materialised(_large(spark), "t").collect()]
        assert sum(sizes) > 15_000_000 and max(sizes) < 2 * store.ARROW_BYTES
        assert int(spark.conf.get(LIMIT)) == 1 << 26
    finally:
        spark.conf.unset(LIMIT)


def test_queries_run_with_small_batches(spark):
    spark.conf.unset(LIMIT)
    try:
        table(spark, "/root/testdata/sf0.001", "documents")
        assert max(r.n for r in _large(spark).collect()) < 2 * store.ARROW_BYTES
    finally:
        spark.conf.unset(LIMIT)
