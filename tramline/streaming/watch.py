"""A folder watched for new feed archives, each checked once by a micro-batch; an addition to the batch analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tramline.plans.analyses import validate


def watch(spark: SparkSession, folder: str, findings: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Findings of every new .zip in folder go to the Parquet folder `findings`, under the archive's name as feed.

    Each micro-batch has a folder of its own, batch=<number>, which a batch that is run again after a failure overwrites.
    """

    def batch(names: DataFrame, number: int) -> None:
        parts = [validate(spark, r.path, r.path.rsplit("/", 1)[-1]) for r in names.select("path").distinct().collect()]  # names of archives, one row each
        if parts:
            reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{findings}/batch={number}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    seen = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").load(folder).select("path")
    writer = seen.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
