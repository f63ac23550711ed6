"""Splitting samples, reference correction, family rows, sample ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variant import affine, pheno_code, sex_code
from .filters import not_reference, single_base
from .merge import by_locus


def split_samples(wide: DataFrame) -> DataFrame:
    """Long rows (see sources.vcf.read_wide) of single-base sites where the sample is not 0|0; INFO is N/A."""
    return not_reference(single_base(wide)).withColumn("info", F.lit("N/A"))


def sample_lines(split: DataFrame, stacked: bool = True) -> DataFrame:
    """sample, chrom_num, pos, value: text lines, with a header line at the head of each sample, or of each sample and chromosome where they aren't stacked. The headers are the first partition."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    body = split.select("sample", "chrom_num", "pos", F.concat_ws("\t", *map(dot, ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "gt"])).alias("value"))
    title = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
    heads = split.select("sample", F.lit(0).alias("chrom_num") if stacked else "chrom_num").distinct()
    head = heads.select("sample", "chrom_num", F.lit(-1).cast("long").alias("pos"), F.concat_ws("\t", F.lit(title), "sample").alias("value"))
    return head.coalesce(1).unionByName(body)


def correct_reference(calls: DataFrame, x: float = 1.0, y: int = 0) -> DataFrame:
    """Every call of a locus gets the reference of its lowest sample; ids go and positions become pos * x + y."""
    first = Window.partitionBy("chrom_num", "pos").orderBy("sample_id", "ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = by_locus(calls).withColumn("ref", F.first("ref").over(first))
    return fixed.withColumn("pos", affine(F.col("pos"), x, y)).withColumn("id", F.lit("."))


def order_by_sample(calls: DataFrame, n: int) -> DataFrame:
    """n range partitions by sample and locus; the locus in the key splits a hot sample over partitions and keeps the order. Header rows (chrom_num 0) come first in their sample."""
    return calls.repartitionByRange(n, "sample_id", "chrom_num", "pos").sortWithinPartitions("sample_id", "chrom_num", "pos")


def family(ids: DataFrame, people: DataFrame) -> DataFrame:
    """ordinal, patient_id, line: family rows in the order of ids; a patient without information has codes 0. Spark broadcasts people if they are few."""
    one = people.groupBy("patient_id").agg(F.max(F.struct("gender", "pheno")).alias("p")).select("patient_id", "p.*")
    got = ids.join(one, "patient_id", "left")
    line = F.concat_ws(" ", F.lit("0"), "patient_id", F.lit("0"), F.lit("0"), sex_code(F.col("gender")).cast("string"), pheno_code(F.col("pheno")).cast("string"))
    return got.select("ordinal", "patient_id", line.alias("line")).orderBy("ordinal")


def dictionary(names: DataFrame, column: str) -> DataFrame:
    """sample_id, name: ordinals from 1 by name. The window has no partition: it runs over distinct names, one for each sample, which is the bound of its one task."""
    return names.select(F.col(column).alias("name")).distinct().select(F.row_number().over(Window.orderBy("name")).alias("sample_id"), "name")
