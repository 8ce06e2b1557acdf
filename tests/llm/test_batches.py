"""How much goes to a Python worker at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from driftwell.plans.lineage import BATCH_BYTES, cut


def test_rows_go_to_workers_in_small_batches(spark):
    def sizes(found):
        for b in found:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = cut(spark.range(40, numPartitions=1)).withColumn("text", F.repeat(F.lit("x"), 1 << 19))
    found = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 40 and max(r.size for r in found) < 2 * BATCH_BYTES


def test_a_smaller_limit_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "65536")
    try:
        cut(spark.range(1))
        assert spark.conf.get(key).rstrip("b") == "65536"
    finally:
        spark.conf.unset(key)
