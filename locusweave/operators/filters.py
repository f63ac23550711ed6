"""Filters on calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import parse_region, quality_rank, rank_of

#: Most regions that become one filter expression, which reaches the scan; more are a join by chromosome and bin of positions.
REGIONS_INLINE = 200
#: Positions of a bin.
BIN = 1_000_000


def at_least(option: str = "PASS") -> Column:
    """Whether the FILTER class is at least the option's."""
    return quality_rank(F.col("filter")) >= rank_of(option)


def by_quality(calls: DataFrame, option: str = "PASS") -> DataFrame:
    """Rows whose FILTER class is at least the option's."""
    return calls.where(at_least(option))


def pass_only(calls: DataFrame) -> DataFrame:
    return calls.where(F.upper("filter") == "PASS")


def by_chromosome(calls: DataFrame, first: int = 1, last: int = 26) -> DataFrame:
    return calls.where(F.col("chrom_num").between(first, last))


def merged_regions(regions: list[str]) -> list[tuple[int, int, int | None]]:
    """(chrom_num, start, end) of the texts chr:start-end, chr:start or chr, in order and without overlaps; an open end is None. ValueError for any other text."""
    out: list[tuple[int, int, int | None]] = []
    for c, start, end in sorted(map(parse_region, regions), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)):
        if out and out[-1][0] == c and (out[-1][2] is None or start <= out[-1][2] + 1):
            last = out.pop()
            start, end = last[1], None if last[2] is None or end is None else max(last[2], end)
        out.append((c, start, end))
    return out


def by_regions(calls: DataFrame, regions: list[str]) -> DataFrame:
    """Rows in any of the regions. Many of them are a semi join by (chromosome, bin of positions), which Spark broadcasts if they are few enough."""
    if not regions:
        return calls
    spans = merged_regions(regions)
    few = spans if len(spans) <= REGIONS_INLINE else [s for s in spans if s[2] is None]  # of those without an end there is one for each chromosome at most
    keep = F.lit(False)
    for c, start, end in few:
        inside = (F.col("chrom_num") == c) & (F.col("pos") >= start)
        keep = keep | (inside if end is None else inside & (F.col("pos") <= end))
    if len(few) == len(spans):
        return calls.where(keep)
    spark = calls.sparkSession
    g = spark.createDataFrame([s for s in spans if s[2] is not None], "c int, a long, z long")
    g = g.withColumn("b", F.explode(F.sequence(F.floor(F.col("a") / BIN), F.floor(F.col("z") / BIN))))
    on = (F.col("chrom_num") == F.col("c")) & (F.floor(F.col("pos") / BIN) == F.col("b")) & (F.col("pos") >= F.col("a")) & (F.col("pos") <= F.col("z"))
    # Spans don't overlap, so a row is in one of them at most.
    return calls.where(keep).unionByName(calls.where(~F.coalesce(keep, F.lit(False))).join(g, on, "left_semi"))


def single_base(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("ref") == 1)


def not_reference(rows: DataFrame, column: str = "gt") -> DataFrame:
    """Rows whose genotype is not exactly 0|0."""
    return rows.where(F.col(column) != "0|0")


def by_samples(rows: DataFrame, names: list, column: str = "sample") -> DataFrame:
    return rows.where(F.col(column).isin(*names))


def valid_reading(rows: DataFrame) -> DataFrame:
    """Weather records with a value and an accepted quality code."""
    return rows.where((F.col("temp") != 9999) & F.col("quality").rlike("^[01459]$"))
