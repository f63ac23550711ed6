"""The merge of per-sample calls by locus, as VCF or TPED rows, with one exchange.

`best` says which of several calls of one sample and locus stays (sort columns), `keep` filters what stayed. Both work behind the one exchange, so
raw calls with duplicates can be given. So does decoding: calls may have their genotypes as text (`texts`, see sources.vcf.parse_calls) instead of
decoded (`gts`), and then only the rows that stay are decoded. Calls are range-partitioned by (chrom_num, pos), never by sample, so a locus lies in one partition; removing duplicates, grouping
and the global order then reuse that partitioning. A locus holds at most n samples after duplicates went.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.variant import allele_pair, decode, encode, half_up

LOCUS = ["chrom_num", "pos"]


def by_locus(calls: DataFrame) -> DataFrame:
    return calls.repartitionByRange(*LOCUS)


def distinct_calls(calls: DataFrame, best: list[Column] | None = None) -> DataFrame:
    """One call for each sample and locus: the first by `best`, or else largest QUAL (null last), then genotype, then INFO."""
    order = best or [F.col(c).desc_nulls_last() for c in ("qual", "texts" if "texts" in calls.columns else "gts", "info")]
    first = Window.partitionBy(*LOCUS, "sample_id").orderBy(*order)
    return calls.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def one_call(calls: DataFrame, by: list[str], best: list[Column]) -> DataFrame:
    """distinct_calls() of raw calls, range-partitioned and sorted by `by` (sample_id, chrom_num and pos in any order), with one exchange: duplicates go behind it, by the same sort."""
    first = Window.partitionBy(*by).orderBy(*best)
    return calls.repartitionByRange(*by).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def decoded(calls: DataFrame) -> DataFrame:
    """Calls with `gts`, decoded from `texts` where they are still text."""
    if "texts" not in calls.columns:
        return calls
    return calls.withColumn("gts", F.transform("texts", lambda g: decode(g, F.col("ref"), F.col("alts")))).drop("texts")


def _loci(calls: DataFrame, n: int, columns: list[str], best: list[Column] | None, keep: Column | None, column: int | None = None) -> DataFrame:
    """chrom_num, pos and c: the calls of the locus by sample. column: the genotype that becomes g."""
    one = distinct_calls(by_locus(calls.where(F.col("sample_id").between(1, n))), best)
    if keep is not None:
        one = one.where(keep)
    one = decoded(one)
    if column is not None:
        one = one.withColumn("g", F.get("gts", F.lit(column)))
    return one.groupBy(*LOCUS).agg(F.array_sort(F.collect_list(F.struct("sample_id", *columns))).alias("c"))


def dense(cells: Column, n: int, default: Column) -> Column:
    """An array of n values from cells (sorted structs of sample_id and v), with the default for samples that are not there; linear in n."""
    gap = lambda k: F.array_repeat(default, k.cast("int"))
    after = lambda i: F.coalesce(F.get(cells, i + 1)["sample_id"], F.lit(n + 1))
    filled = F.flatten(F.transform(cells, lambda x, i: F.concat(F.array(x["v"]), gap(after(i) - x["sample_id"] - 1))))
    return F.concat(gap(F.get(cells, F.lit(0))["sample_id"] - 1), filled)


def merge_tped(calls: DataFrame, n: int, column: int = 0, best: list[Column] | None = None, keep: Column | None = None) -> DataFrame:
    """chrom_num, rs, pos, ref, genotypes (n allele pairs), ordered by locus. An absent or uncalled sample has the reference twice."""
    loci = _loci(calls, n, ["id", "ref", "g"], best, keep, column).withColumn("ref", F.col("c")[0]["ref"])
    cells = F.transform("c", lambda x: F.struct(x["sample_id"].alias("sample_id"), allele_pair(x["g"], F.col("ref")).alias("v")))
    out = loci.select(*LOCUS, F.col("c")[0]["id"].alias("rs"), "ref", cells.alias("cells"))
    return out.select("chrom_num", "rs", "pos", "ref", dense(F.col("cells"), n, F.concat_ws(" ", "ref", "ref")).alias("genotypes")).orderBy(*LOCUS)


def merge_tiles(calls: DataFrame, n: int, width: int = 1_000, column: int = 0, best: list[Column] | None = None, keep: Column | None = None) -> DataFrame:
    """The merge in tiles: chrom_num, pos, block, rs, ref, cells, one row for each locus and block of `width` samples that has a call there.

    cells are the called samples of the block (sample_id, allele pair), so a row is bounded by the width, however many samples there are, and what is absent takes no room.
    One exchange: the first sample's reference and id come from a window over the locus, which streams, and tiles are grouped in the same partitioning.
    """
    one = distinct_calls(by_locus(calls.where(F.col("sample_id").between(1, n))), best)
    one = decoded(one if keep is None else one.where(keep))
    lead = Window.partitionBy(*LOCUS).orderBy("sample_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.select(*LOCUS, "sample_id", F.first("id").over(lead).alias("rs"), F.first("ref").over(lead).alias("ref"), F.get("gts", F.lit(column)).alias("g"))
    cell = F.struct("sample_id", allele_pair(F.col("g"), F.col("ref")).alias("v")).alias("_cell")
    block = F.floor((F.col("sample_id") - 1) / width).cast("int").alias("block")
    tiles = one.select(*LOCUS, block, "rs", "ref", cell).groupBy(*LOCUS, "block")
    return tiles.agg(F.first("rs").alias("rs"), F.first("ref").alias("ref"), F.array_sort(F.collect_list("_cell")).alias("cells"))


def from_tiles(tiles: DataFrame, n: int) -> DataFrame:
    """chrom_num, rs, pos, ref, genotypes (n allele pairs), ordered by locus: tiles put together, for writing. Rows are as wide as there are samples from here on."""
    loci = by_locus(tiles).groupBy(*LOCUS).agg(F.first("rs").alias("rs"), F.first("ref").alias("ref"), F.array_sort(F.collect_list(F.struct("block", "cells"))).alias("t"))
    cells = F.flatten(F.transform("t", lambda x: x["cells"]))
    out = loci.select("chrom_num", "rs", "pos", "ref", cells.alias("cells"))
    return out.select("chrom_num", "rs", "pos", "ref", dense(F.col("cells"), n, F.concat_ws(" ", "ref", "ref")).alias("genotypes")).orderBy(*LOCUS)


def merge_vcf(calls: DataFrame, n: int, columns: int = 1, best: list[Column] | None = None, keep: Column | None = None, flag: bool = False) -> DataFrame:
    """chrom, chrom_num, pos, id, ref, alts, qual, filter, info, format, genotypes (n * columns), ordered by locus.

    flag: also ref_conflict, whether the samples of the locus have different references (their alleles that are neither the first sample's reference nor an ALT are ".").
    """
    loci = _loci(calls, n, ["chrom", "id", "ref", "alts", "qual", "filter", "info", "format", "gts"], best, keep)
    first = lambda k: F.col("c")[0][k].alias(k)
    alts = F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda x: F.coalesce(x["alts"], F.array().cast("array<string>"))))))
    # Each file weighs by its number of genotype columns; those without QUAL don't count.
    rated = F.filter("c", lambda x: x["qual"].isNotNull())
    weigh = lambda x: F.size(x["gts"])
    total = F.aggregate(rated, F.lit(0.0), lambda a, x: a + x["qual"] * weigh(x))
    weight = F.aggregate(rated, F.lit(0), lambda a, x: a + weigh(x))
    info = F.array_join(F.transform("c", lambda x: x["info"]), ";")
    out = loci.select("*", first("chrom"), first("id"), first("ref"), first("filter"), first("format"), alts.alias("alts"), F.when(weight > 0, half_up(total / weight)).alias("qual"), info.alias("info"))
    cells = F.transform("c", lambda x: F.struct(x["sample_id"].alias("sample_id"), F.transform(x["gts"], lambda g: encode(g, F.col("ref"), F.col("alts"))).alias("v")))
    out = out.withColumn("cells", cells)
    genotypes = F.flatten(dense(F.col("cells"), n, F.array_repeat(F.lit("."), columns)))
    conflict = [F.exists("c", lambda x: x["ref"] != F.col("c")[0]["ref"]).alias("ref_conflict")] if flag else []
    return out.select("chrom", *LOCUS, "id", "ref", "alts", "qual", "filter", "info", "format", genotypes.alias("genotypes"), *conflict).orderBy(*LOCUS)


def store_block(block: DataFrame, table: str, buckets: int, path: str, dealt: bool = False) -> None:
    """Keep a TPED result as a table bucketed by locus, below path. dealt: its tasks are buckets already, as those of merge_stored() are, so nothing is shuffled."""
    rows = block.select(*LOCUS, "rs", "ref", "genotypes")
    rows = rows if dealt else rows.repartition(buckets, *LOCUS)
    rows.sortWithinPartitions(*LOCUS).write.bucketBy(buckets, *LOCUS).sortBy(*LOCUS).option("path", path).saveAsTable(table)


def merge_stored(spark: SparkSession, first: tuple[str, int], second: tuple[str, int]) -> DataFrame:
    """merge_blocks() of two tables made by store_block() with one number of buckets: (name, samples) each.

    Bucket joins bucket where it is, without an exchange, so a block of new samples is added to a large result for the price of reading it. The rows are in no order over
    buckets: the result can be stored as a block again and is sorted only when it is written as text.
    """
    (a, n), (b, m) = first, second
    left = spark.table(a).select(*LOCUS, F.struct("rs", "ref", "genotypes").alias("a"))
    both = left.join(spark.table(b).select(*LOCUS, F.struct("rs", "ref", "genotypes").alias("b")), LOCUS, "full")
    ref = F.coalesce("a.ref", "b.ref")
    part = lambda side, size: F.coalesce(F.col(f"{side}.genotypes"), F.array_repeat(F.concat_ws(" ", ref, ref), size))
    rs = F.when(F.col("a").isNotNull(), F.col("a.rs")).otherwise(F.col("b.rs"))
    return both.select("chrom_num", rs.alias("rs"), "pos", ref.alias("ref"), F.concat(part("a", n), part("b", m)).alias("genotypes"))


def merge_blocks(blocks: list[tuple[DataFrame, int]]) -> DataFrame:
    """Merge TPED results of disjoint sample blocks, in block order: (rows, samples) each. One grouping, whatever the number of blocks."""
    tagged = [b.select(*LOCUS, F.lit(i).alias("block"), "rs", "ref", "genotypes") for i, (b, _) in enumerate(blocks)]
    loci = by_locus(reduce(DataFrame.unionByName, tagged)).groupBy(*LOCUS).agg(F.array_sort(F.collect_list(F.struct("block", "rs", "ref", "genotypes"))).alias("s"))
    loci = loci.select(*LOCUS, F.col("s")[0]["rs"].alias("rs"), F.col("s")[0]["ref"].alias("ref"), "s")
    part = lambda i, size: F.coalesce(F.get(F.filter("s", lambda x: x["block"] == i), F.lit(0))["genotypes"], F.array_repeat(F.concat_ws(" ", "ref", "ref"), size))
    return loci.select("chrom_num", "rs", "pos", "ref", F.concat(*[part(i, size) for i, (_, size) in enumerate(blocks)]).alias("genotypes")).orderBy(*LOCUS)


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Calls of the store and of a later batch: the later batch wins for a sample and locus."""
    both = store.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)))
    last = Window.partitionBy(*LOCUS, "sample_id").orderBy(F.col("_b").desc(), F.col("qual").desc_nulls_last(), F.col("gts").desc_nulls_last(), F.col("info").desc_nulls_last())
    return by_locus(both).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_b", "_rn")
