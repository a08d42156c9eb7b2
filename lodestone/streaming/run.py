"""Running a stream to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def drain(spark: SparkSession, folder: str, pattern: str, schema_of: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str, out: str, checkpoint: str) -> DataFrame:
    """Read the files of ``folder`` that match ``pattern`` as a stream, write ``plan`` of it as Parquet
    (append) or through a per-batch overwrite (complete), and return what was written."""
    stream = spark.readStream.schema(schema_of.schema).option("pathGlobFilter", pattern).parquet(folder)
    rows = plan(stream)
    writer = rows.writeStream.option("checkpointLocation", f"{checkpoint}/{uuid.uuid4().hex}").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        query = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
