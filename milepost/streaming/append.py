"""Monthly files as they arrive: keyed append with exactly one row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_new_months(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str]) -> None:
    """Read files that are new in source, add rows whose keys target doesn't have, then stop (availableNow)."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.schema(batch.schema).parquet(target).select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(target)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
