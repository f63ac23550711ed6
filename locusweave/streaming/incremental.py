"""Incremental merging of files as they arrive: a file stream whose batches are added to the call store.

The store keeps every batch under its number, and reading takes the latest call of a sample and locus; a batch that is run again after a failure
writes the same rows under the same number, so results don't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import by_locus
from ..sources.sinks import write_rejects, write_store
from ..sources.vcf import parse_checked, rejected, sample_of


def follow(spark: SparkSession, incoming: str, store: str, checkpoint: str, columns: tuple[int, ...] = (9,), rejects: str | None = None) -> StreamingQuery:
    """Add each new file of a folder to the store, then stop (availableNow).

    Lines that are no call, and all lines of files without a sample number, never reach the store. rejects: a second output for them: text folders by batch and reason,
    each line after its file's name. A batch that is run again replaces its own folders.
    """
    text = spark.readStream.text(incoming).select("value", F.col("_metadata.file_name").alias("file_name"), sample_of(F.col("_metadata.file_name")).alias("sample_id"))

    def add(batch: DataFrame, i: int) -> None:
        write_store(parse_checked(batch, columns), store, i)
        if rejects:
            write_rejects(rejected(batch, columns), rejects, i)

    return text.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(store: DataFrame) -> DataFrame:
    """The latest call for each sample and locus."""
    last = Window.partitionBy("chrom_num", "pos", "sample_id").orderBy(F.col("batch").desc(), F.col("qual").desc_nulls_last(), F.col("texts" if "texts" in store.columns else "gts").desc_nulls_last(), F.col("info").desc_nulls_last())
    return by_locus(store).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "batch")
