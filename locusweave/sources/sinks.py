"""Writers: ordered text, one folder per chromosome or sample, the call store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


from ..functions.variant import chrom_name, encode
from ..operators.merge import decoded, one_call


def tped_line(genotype_sep: str = " ", names: bool = False, ref: bool = False) -> Column:
    """ref: the form between merges, which has the reference as its fifth column (see vcf.read_tped)."""
    chrom = chrom_name(F.col("chrom_num")) if names else F.col("chrom_num").cast("string")
    return F.concat_ws("\t", chrom, F.coalesce("rs", F.lit(".")), F.lit("0"), F.col("pos").cast("string"), *(["ref"] if ref else []), F.array_join("genotypes", genotype_sep)).alias("value")


def vcf_line() -> Column:
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    alt = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(F.lit("."))
    return F.concat_ws("\t", dot("chrom"), dot("pos"), dot("id"), dot("ref"), alt, dot("qual"), dot("filter"), dot("info"), dot("format"), F.array_join("genotypes", "\t")).alias("value")


def vcf_header(samples: list[str]) -> list[str]:
    return ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def sample_names(n: int, columns: int = 1) -> list[str]:
    """The names of merged samples: their numbers, and the genotype column where a file has several."""
    return [str(i) if columns == 1 else f"{i}.{k}" for i in range(1, n + 1) for k in range(1, columns + 1)]


def finished(spark, path: str) -> list[int]:
    """Chromosomes whose folders are there. A folder appears when its job has ended well, so these need not be written again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(x.removeprefix("chrom_num=")) for x in names if x.startswith("chrom_num="))


def write_lines(merged: DataFrame, line: Column, path: str, by_chromosome: bool = False, one_file: bool = False, compression: str | None = None, header: list[str] | None = None, calls: DataFrame | None = None) -> None:
    """Text in the order of merged (chrom_num, pos). by_chromosome: one folder per chromosome, and a rerun replaces only the folders it writes. one_file is for small results.

    header: lines before all others (in every folder); they are the first part file, so parts joined by name are one file. Folders are written in an order
    that the sort states in full (folder, line of the header, position): the writer's own order by folder is a prefix of it, so nothing is sorted again.
    calls: what was merged, if each of its chromosomes is in merged: then the folders that need a header are found without merging twice.
    """
    folder = ["chrom_num"] if by_chromosome else []
    if header:
        lines = F.posexplode(F.array(*map(F.lit, header))).alias("_line", "value")
        heads = (merged if calls is None else calls).select("chrom_num").distinct() if by_chromosome else merged.sparkSession.range(1)
        head = heads.select(*folder, lines, F.lit(-1).cast("long").alias("pos")).coalesce(1)
        out = head.unionByName(merged.select(*folder, F.lit(len(header)).alias("_line"), line, F.col("pos").cast("long").alias("pos")))
        out = out.sortWithinPartitions(*folder, "_line", "pos") if by_chromosome else out.sortWithinPartitions("_line") if one_file else out
    else:
        out = merged
    out = out.select(line if out is merged else "value", *folder)
    if one_file:  # one task may take the parts in any order, so it sorts them by their place
        out = out.withColumn("_at", F.monotonically_increasing_id()).coalesce(1).sortWithinPartitions("_at").drop("_at")
    w = out.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if by_chromosome:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy("chrom_num")
    w.text(path)


def write_samples(split: DataFrame, path: str, stacked: bool = True, compression: str = "bzip2", placed: bool = False) -> None:
    """split: sample, chrom_num, pos and value (see operators.reshape.sample_lines); one folder per sample, or per sample and chromosome. Its parts joined by name are one file with its header first.

    placed: the lines lie in ranges of sample, chromosome and position already (merge.one_call), behind a first partition of headers, so they stay where they are.
    """
    keys = ["sample"] if stacked else ["sample", "chrom_num"]
    order = ["sample", "chrom_num", "pos"]
    out = split if placed else split.repartitionByRange(*order)
    out.sortWithinPartitions(*order).select("value", *keys).write.mode("overwrite").option("compression", compression).partitionBy(*keys).text(path)


def write_calls(calls: DataFrame, path: str, compression: str = "bzip2", best: list[Column] | None = None) -> None:
    """Calls as per-sample text, one folder (sample_id=...) for each sample, with genotypes against the call's own alleles (vcf.read_vcf(numbered="folder") reads them).

    best: calls are raw, and the first by it of a sample and locus is written (merge.one_call).
    """
    by = ["sample_id", "chrom_num", "pos"]
    own = F.transform("gts", lambda g: encode(g, F.col("ref"), F.col("alts")))
    out = decoded(one_call(calls, by, best) if best else calls.repartitionByRange(*by)).withColumn("genotypes", own).sortWithinPartitions(*by)
    out.select(vcf_line(), "sample_id").write.mode("overwrite").option("compression", compression).partitionBy("sample_id").text(path)


def name_by_sample(spark: SparkSession, folders: str, path: str) -> int:
    """Move the part files of folders sample_id=n (write_calls) into one folder, named n.part.codec as vcf.sample_of() reads them; how many there are. Files are renamed, not copied."""
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    moved = 0
    for folder in fs.listStatus(at(folders)):
        if (name := folder.getPath().getName()).startswith("sample_id="):
            parts = sorted(x.getPath().getName() for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-"))
            for i, part in enumerate(parts):
                fs.rename(at(f"{folders}/{name}/{part}"), at(f"{path}/{name.removeprefix('sample_id=')}.{i:05d}.{part.rsplit('.', 1)[-1]}"))
                moved += 1
    return moved


def write_regions(merged: DataFrame, line: Column, path: str, compression: str | None = None) -> None:
    """One folder for each region (operators.partition.in_parts), named by it; in it the lines are in order. The last sort begins with the folder, as the writer asks for."""
    w = merged.sortWithinPartitions("region", "pos").select(line, "region").write.mode("overwrite").partitionBy("region")
    (w.option("compression", compression) if compression else w).text(path)


def write_rejects(lines: DataFrame, path: str, batch: int = 0) -> None:
    """lines: file_name, value and reason (vcf.rejected); a folder for each batch and reason, which a rerun replaces."""
    out = lines.select(F.concat_ws("\t", "file_name", "value").alias("value"), F.lit(batch).alias("batch"), "reason")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "reason").text(path)


def write_store_counted(calls: DataFrame, path: str, batch: int = 0, mode: str = "append") -> dict[int, int]:
    """write_store(), and how many calls of each chromosome were written: counted by the tasks that write, so the input is read no further time."""
    seen = Observation()
    each = [F.count(F.when(F.col("chrom_num") == c, 1)).alias(str(c)) for c in range(1, 27)]
    out = calls.withColumn("batch", F.lit(batch)).repartitionByRange("chrom_num", "pos").observe(seen, *each)
    out.sortWithinPartitions("chrom_num", "pos", "sample_id").write.mode(mode).partitionBy("chrom_num").parquet(path)
    return {int(c): n for c, n in seen.get.items() if n}


def write_store(calls: DataFrame, path: str, batch: int = 0, mode: str = "append") -> None:
    """Add calls to the store: folders by chromosome, files sorted by position for row-group pruning."""
    calls.withColumn("batch", F.lit(batch)).repartitionByRange("chrom_num", "pos").sortWithinPartitions("chrom_num", "pos", "sample_id").write.mode(mode).partitionBy("chrom_num").parquet(path)


def small_folders(spark: SparkSession, path: str, target: int) -> list[tuple[int, int]]:
    """(chrom_num, bytes) of the store's folders that hold at least twice as many files as they need at `target` bytes each. Only names and lengths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    by = files.groupBy(F.regexp_extract("path", "chrom_num=([0-9]+)", 1).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"))
    rows = by.where((F.col("n") > 1) & (F.col("n") >= 2 * F.ceil(F.col("size") / target))).collect()
    return sorted((r["c"], r["size"]) for r in rows)


def compact(spark: SparkSession, path: str, target: int = 256_000_000) -> list[int]:
    """Pack the store's small files into files of about `target` bytes, each a range of positions; the chromosomes whose folders were replaced.

    Each chromosome is cut at quantiles of its positions (one sketch each), a cut is one task's rows, and the folders are replaced when the job commits: readers that begin before see the old files or fail
    for want of them, those that begin later see the new ones. Batches stay apart by their column, so incremental.current() gives what it gave.
    """
    folders = small_folders(spark, path, target)
    if not folders:
        return []
    rows = spark.read.parquet(path).where(F.col("chrom_num").isin(*[c for c, _ in folders]))
    files = {c: -(-size // target) for c, size in folders}
    most = max(files.values())
    shares = F.create_map(*[F.lit(x) for c, n in files.items() for x in (c, n)])
    cuts = rows.groupBy("chrom_num").agg(F.percentile_approx("pos", [k / most for k in range(1, most)] or [1.0], 10_000).alias("_cuts"))
    at = rows.join(F.broadcast(cuts), "chrom_num")  # a row for each chromosome
    # Of the finest cuts every chromosome takes as many as it needs files.
    part = F.floor(F.size(F.filter("_cuts", lambda x: x < F.col("pos"))) * shares[F.col("chrom_num")] / F.lit(most)).cast("int")
    out = at.withColumn("_part", part).drop("_cuts").repartitionByRange(sum(files.values()), "chrom_num", "_part").sortWithinPartitions("chrom_num", "pos", "sample_id").drop("_part")
    out.select(*[c for c in rows.columns if c != "chrom_num"], "chrom_num").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom_num").parquet(path)
    return [c for c, _ in folders]
