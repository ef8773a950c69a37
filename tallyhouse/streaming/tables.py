"""Streams over growing tables, and the tables they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.session import run_folder


def stream_table(
    spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """A parquet table, a file or a folder of files, as a stream; the intake of
    one micro-batch is bounded."""
    # as a pattern, because a plain path would have to be a folder
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/{{{name}}}")
    )


def drain(stream: DataFrame, mode: str, name: str) -> tuple[DataFrame, str]:
    """Run a stream over all available input and read back what it wrote.

    Every micro-batch is written to a folder of its own below the shared
    folder; a repeated batch overwrites itself, so nothing is written twice.
    Without any batch the table is empty.
    """
    spark = stream.sparkSession
    folder = run_folder(spark, name)
    table, progress = f"{folder}/table", f"{folder}/progress"

    spark.createDataFrame([], stream.schema).write.parquet(f"{table}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(table), folder


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return updates.withColumn("_n", F.row_number().over(newest)).filter("_n <= 1").drop("_n", "batch_id")
