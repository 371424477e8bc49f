"""What Python workers keep between tasks."""

import pyarrow as pa
from pyspark.sql import functions as F

from locusframe.llm import common


def test_a_worker_keeps_what_its_last_operator_needs(spark):
    def keeping(batches):
        for batch in batches:
            common.held("table", lambda: bytearray(1 << 20))
            yield batch

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._held)] * batch.num_rows)], ["id"])

    rows = spark.range(4).coalesce(1)
    common.map_batches(rows, keeping, "id long", "table").count()
    assert common.map_batches(rows, seen, "id long", "table").agg(F.max("id")).first()[0] == 1
    assert common.map_batches(rows, seen, "id long").agg(F.max("id")).first()[0] == 0
