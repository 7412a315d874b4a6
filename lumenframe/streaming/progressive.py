"""Progressive accumulation: a stream of samples whose running result equals the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.lineage import shared_path


def measures(samples: DataFrame) -> DataFrame:
    """Count, sum and extremes by event type; the same plan for batches and streams."""
    return samples.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def accumulate(spark: SparkSession, path: str) -> DataFrame:
    """The final state of the stream of all files at path, run until nothing is left.

    Each run has a checkpoint and results of its own in the shared folder. A batch writes the whole running result, one
    row a key, as a table named by its number, so a batch that is run again writes the same; the last one is read.
    """
    samples = spark.read.parquet(path)
    schema, stream = samples.schema, spark.readStream.schema(samples.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    # a stream reads folders: a table of one file is what its folder holds under that name
    one_file = any(f.rpartition("/")[2] == name for f in samples.inputFiles())
    source = stream.option("pathGlobFilter", name).parquet(folder) if one_file else stream.parquet(path)
    place = shared_path(spark, "progressive")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/result-{number}")
        last.append(number)

    query = measures(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return measures(spark.createDataFrame([], schema))
    return spark.read.parquet(f"{place}/result-{last[-1]}")
