"""A merged result that is kept up to date: a batch of calls merges again only the bins of positions that it touches.

The call store and the merged table are folders by (chrom_num, bin), and the store has a folder for each batch below. Adding a batch writes its own
folders, reads the store in the bins that these name (folders of all other bins are pruned), and replaces those folders of the merged table. A batch that is run
again replaces what it wrote. There are at most genome length / BIN bins, whatever the number of calls, so their list is a filter of literals. Every folder costs the
driver some kilobytes (names that tasks send when they end, lists of files), so a size below BIN goes with width(), which bounds their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove
from ..streaming.incremental import current
from .merge import merge_tped

#: Positions of a bin.
BIN = 1_000_000
#: Bins of a table at most, where width() chooses their size.
MOST_BINS = 2_000


def width(loci: DataFrame, size: int = BIN) -> int:
    """Positions of a bin: `size`, or so many times twice it that these loci lie in MOST_BINS bins at most (chromosomes count from position 0). For all batches of a store."""
    last = [r["last"] for r in loci.groupBy("chrom_num").agg(F.max("pos").alias("last")).where("last is not null").collect()]  # a row for each chromosome
    while size < BIN and sum(x // size + 1 for x in last) > MOST_BINS:
        size *= 2
    return size


def bin_of(size: int = BIN) -> Column:
    return F.floor(F.col("pos") / size).cast("int").alias("bin")


def in_bins(keys: list[tuple[int, int]]) -> Column:
    """Whether a row lies in one of the bins, as a filter on the folders' columns."""
    by: dict[int, list[int]] = {}
    for c, b in keys:
        by.setdefault(c, []).append(b)
    each = [(F.col("chrom_num") == c) & F.col("bin").isin(*bins) for c, bins in sorted(by.items())]
    return reduce(lambda x, y: x | y, each, F.lit(False))


def add_calls(calls: DataFrame, store: str, batch: int, size: int = BIN) -> None:
    """Write a batch to the store; run again, it replaces its own folders."""
    out = calls.withColumns({"bin": bin_of(size), "batch": F.lit(batch)}).repartitionByRange("chrom_num", "bin", "pos")
    out = out.sortWithinPartitions("chrom_num", "bin", "batch", "pos", "sample_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom_num", "bin", "batch").parquet(store)


def touched(spark: SparkSession, store: str, batch: int) -> list[tuple[int, int]]:
    """The bins of a batch, from the names of its folders."""
    rows = spark.read.parquet(store).where(F.col("batch") == batch).select("chrom_num", "bin").distinct().collect()
    return sorted((r["chrom_num"], r["bin"]) for r in rows)


def store_in_bins(spark: SparkSession, store: str, keys: list[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(store).where(in_bins(keys))


def merge_bins(spark: SparkSession, store: str, merged: str, keys: list[tuple[int, int]], n: int, version: int, size: int = BIN, keep: Column | None = None) -> None:
    """Merge the store's calls in these bins, latest batch first, and replace those folders of the merged table; bins in which nothing is left go."""
    if not keys:
        return
    rows = merge_tped(current(store_in_bins(spark, store, keys).drop("bin")), n, keep=keep)
    out = rows.withColumns({"bin": bin_of(size), "version": F.lit(version)}).sortWithinPartitions("chrom_num", "bin", "pos")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom_num", "bin").parquet(merged)
    old = spark.read.parquet(merged).where(in_bins(keys)).groupBy("chrom_num", "bin").agg(F.max("version").alias("v")).where(F.col("v") != version)
    for r in old.collect():
        remove(spark, f"{merged}/chrom_num={r['chrom_num']}/bin={r['bin']}")


def delta_merge(calls: DataFrame, store: str, merged: str, n: int, batch: int, size: int = BIN, keep: Column | None = None) -> list[tuple[int, int]]:
    """Add a batch (numbered upwards) to the store and bring the merged table up to date; the bins that were merged again."""
    spark = calls.sparkSession
    add_calls(calls, store, batch, size)
    keys = touched(spark, store, batch)
    merge_bins(spark, store, merged, keys, n, batch, size, keep)
    return keys


def read_merged(spark: SparkSession, merged: str) -> DataFrame:
    """chrom_num, rs, pos, ref, genotypes, ordered by locus."""
    return spark.read.parquet(merged).select("chrom_num", "rs", "pos", "ref", "genotypes").orderBy("chrom_num", "pos")
