"""Command line: python -m locusweave.cli COMMAND ...

vcf and tped merge per-sample files, blocks merges TPED results that have the reference column, correct rewrites references, split takes
multi-sample files apart, tfam writes family rows, regions lists equal parts of the genome, sample lists every so-manieth locus or a random share of the calls,
points lists positions that cut chromosomes into parts, names lists files with their sample, load adds files to the call store, export merges from it and compact packs
its small files. update adds a batch of files to a store by bins and merges only the bins that it touches again. index writes files as block-gzipped text with a position index, and fetch
reads regions of such files by it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.variant import CHROM_NAMES, chrom_num, encode
from .operators import delta, filters, merge, partition, reshape
from .sources import bgzf, sinks, vcf
from .streaming import incremental


def chromosomes(text: str) -> tuple[int, int]:
    """"first-last" or one chromosome, by name or number."""
    number = lambda x: CHROM_NAMES.get(x.upper().removeprefix("CHR")) or int(x.upper().removeprefix("CHR"))
    ends = [number(x.strip()) for x in text.split("-")]
    if len(ends) > 2 or not 1 <= ends[0] <= ends[-1] <= 26:
        raise argparse.ArgumentTypeError(f"not a range of chromosomes: {text!r}")
    return ends[0], ends[-1]


def columns(text: str) -> tuple[int, ...]:
    """Genotype columns, 0-based and separated by commas."""
    return tuple(int(x) for x in text.split(","))


def words(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="locusweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> None:
        p = commands.add_parser(name)
        for o in options:
            short, _, long = o.partition("/")
            p.add_argument(f"-{short}", f"--{long.split(':')[0]}", **OPTIONS[long])

    chosen = ["c/chromosomes", "q/quality", "r/regions"]
    layout = ["b/by-chromosome", "f/one-file", "z/compression", "u/resume", "p/cuts"]
    for name in ("vcf", "tped"):
        command(name, "i/input", "o/output", "n/samples", *chosen, "g/genotypes", "e/numbered", "a/absent", *layout, *(["H/header"] if name == "vcf" else ["R/reference"]))
    command("blocks", "i/blocks", "o/output", *layout, "R/reference")
    command("correct", "i/input", "o/output", "n/samples", "x/factor", "y/shift", "z/compression")
    command("split", "i/input", "o/output", "c/chromosomes", "n/first", "d/names", "r/regions", "s/stacked", "z/compression", "w/public-names")
    command("tfam", "i/input", "d/ids", "o/output", "c/folders")
    command("sample", "i/input", "o/output", *chosen, "k/every", "s/rate")
    command("points", "i/input", "o/output", *chosen, "p/parts", "s/rate", "d/sketch")
    command("names", "i/input", "o/output", "e/numbered")
    command("regions", "o/output", "c/chromosomes", "p/parts", "t/prefix")
    command("load", "i/input", "o/output", "k/checkpoint", "g/genotypes", "j/rejects")
    command("compact", "i/input", "s/size")
    command("update", "i/input", "s/store", "o/output", "n/samples", "k/batch", "q/quality", "c/chromosomes")
    command("index", "i/input", "o/output", "c/chromosomes")
    command("fetch", "i/input", "o/output", "r/regions", "f/one-file", "z/compression")
    command("export", "i/input", "o/output", "n/samples", *chosen, "t/format", *layout, "H/header", "R/reference")
    return top


OPTIONS = {
    "input": {"required": True, "help": "folder or files to read"},
    "output": {"required": True, "help": "folder to write"},
    "samples": {"type": int, "required": True, "help": "number of samples"},
    "chromosomes": {"type": chromosomes, "default": (1, 26), "help": "first-last, such as 1-X"},
    "quality": {"default": "PASS", "help": "lowest FILTER class: PASS, q20 or q10"},
    "regions": {"type": words, "default": [], "help": "chr:start-end,chr:start,chr"},
    "genotypes": {"type": columns, "default": (9,), "help": "genotype columns (0-based); tped uses the first"},
    "by-chromosome": {"action": "store_true", "help": "one folder for each chromosome; a rerun replaces only those it writes"},
    "one-file": {"action": "store_true", "help": "one part file, for small results"},
    "compression": {"default": None, "help": "codec of the text, such as bzip2"},
    "factor": {"type": float, "default": 1.0, "help": "positions are multiplied by it"},
    "shift": {"type": int, "default": 0, "help": "added to positions"},
    "first": {"type": int, "default": None, "help": "the first so many samples"},
    "names": {"type": words, "default": None, "help": "names of samples"},
    "stacked": {"action": "store_true", "help": "all chromosomes of a sample in one folder"},
    "ids": {"required": True, "help": "file with the ids in order"},
    "parts": {"type": int, "required": True, "help": "number of parts"},
    "prefix": {"default": "chr", "help": "before the name of a chromosome"},
    "blocks": {"type": words, "required": True, "help": "folders of TPED results with the reference column, in the order of their samples"},
    "numbered": {"choices": sorted(vcf.NUMBERED), "default": "leading", "help": "where a file's name has the sample's number"},
    "absent": {"action": "store_true", "help": "samples of 1 to n may have no file"},
    "resume": {"action": "store_true", "help": "with -b: chromosomes whose folders are there stay as they are"},
    "cuts": {"type": int, "default": 0, "help": "one folder for each of so many parts of a chromosome, named by its region"},
    "header": {"action": "store_true", "help": "VCF header lines first (in every folder)"},
    "reference": {"action": "store_true", "help": "TPED with the reference as fifth column, to be merged further"},
    "public-names": {"action": "store_true", "help": "the input is a folder of files in the usual public naming; only those of the chosen chromosomes are read"},
    "folders": {"type": chromosomes, "default": None, "help": "one folder for each chromosome of first-last"},
    "every": {"type": int, "default": 0, "help": "every so-manieth locus of each chromosome"},
    "rate": {"type": float, "default": 1.0, "help": "share of the calls"},
    "checkpoint": {"required": True, "help": "state of the stream"},
    "rejects": {"default": None, "help": "folder for lines that are no call, by batch and reason"},
    "size": {"type": int, "default": 256_000_000, "help": "bytes of a packed file"},
    "store": {"required": True, "help": "folder of the calls by bin"},
    "batch": {"type": int, "required": True, "help": "number of the batch; a later one wins, and one that is run again replaces itself"},
    "sketch": {"action": "store_true", "help": "cut at quantiles of the calls by a sketch, in one pass"},
    "format": {"choices": ["vcf", "tped"], "default": "vcf", "help": "kind of result"},
}


def chosen_calls(calls: DataFrame, a: argparse.Namespace) -> DataFrame:
    return filters.by_regions(filters.by_chromosome(filters.by_quality(calls, a.quality), *a.chromosomes), a.regions)


def write_merged(calls: DataFrame, a: argparse.Namespace, kind: str, genotypes: int = 1) -> None:
    calls = unfinished(calls, a)
    merged = merge.merge_tped(calls, a.samples) if kind == "tped" else merge.merge_vcf(calls, a.samples, genotypes)
    line = sinks.tped_line(ref=getattr(a, "reference", False)) if kind == "tped" else sinks.vcf_line()
    header = sinks.vcf_header(sinks.sample_names(a.samples, genotypes)) if kind == "vcf" and getattr(a, "header", False) else None
    write_layout(merged, line, a, header, calls)


def unfinished(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Without the chromosomes that an earlier run has written, where it is resumed."""
    done = sinks.finished(rows.sparkSession, a.output) if a.resume and a.by_chromosome else []
    return rows.where(~F.col("chrom_num").isin(done)) if done else rows


def write_layout(merged: DataFrame, line, a: argparse.Namespace, header: list[str] | None = None, calls: DataFrame | None = None) -> None:
    if a.cuts:
        sinks.write_regions(partition.in_parts(merged, partition.split_points(merged, a.cuts)), line, a.output, a.compression)
    else:
        sinks.write_lines(merged, line, a.output, a.by_chromosome, a.one_file, a.compression, header, calls)


def run(spark: SparkSession, args: list[str] | None = None) -> None:
    """One command on a session."""
    a = parser().parse_args(args)
    if a.command in ("vcf", "tped"):
        vcf.check_samples(spark, a.input, a.samples, a.numbered, a.absent)
        write_merged(chosen_calls(vcf.read_vcf(spark, a.input, a.genotypes, numbered=a.numbered, decoded=False), a), a, a.command, len(a.genotypes))
    elif a.command == "blocks":
        blocks = [vcf.read_tped(spark, p) for p in a.blocks]
        sizes = [row["n"] if (row := b.select(F.size("genotypes").alias("n")).first()) else 0 for b in blocks]
        merged = merge.merge_blocks([(unfinished(b, a), n) for b, n in zip(blocks, sizes)])
        write_layout(merged, sinks.tped_line(ref=a.reference), a)
    elif a.command == "sample":
        calls = chosen_calls(vcf.read_vcf(spark, a.input), a)
        some = partition.systematic(calls, a.every) if a.every else partition.bernoulli(calls, a.rate)
        sinks.write_lines(some.orderBy("chrom_num", "pos"), F.concat_ws("\t", "chrom_num", "pos").alias("value"), a.output)
    elif a.command == "points":
        calls = chosen_calls(vcf.read_vcf(spark, a.input), a)
        points = partition.sketch_points(calls, a.parts) if a.sketch else partition.split_or_sampled(calls, a.parts, a.rate)
        sinks.write_lines(points.orderBy("chrom_num", "part"), F.concat_ws("\t", "chrom_num", "part", "pos").alias("value"), a.output)
    elif a.command == "names":
        files = vcf.sample_files(spark, a.input, a.numbered).orderBy("sample_id", "file_name")
        sinks.write_lines(files, F.concat_ws("\t", F.coalesce(F.col("sample_id").cast("string"), F.lit(".")), "file_name").alias("value"), a.output)
    elif a.command == "export":
        store = incremental.current(filters.by_chromosome(vcf.read_store(spark, a.input), *a.chromosomes))
        write_merged(chosen_calls(store, a), a, a.format)
    elif a.command == "load":
        incremental.follow(spark, a.input, a.output, a.checkpoint, a.genotypes, a.rejects).awaitTermination()
    elif a.command == "compact":
        sinks.compact(spark, a.input, a.size)
    elif a.command == "update":
        keep = filters.at_least(a.quality) & F.col("chrom_num").between(*a.chromosomes)
        delta.delta_merge(vcf.read_vcf(spark, a.input, decoded=False), a.store, a.output, a.samples, a.batch, keep=keep)
    elif a.command == "index":
        text = vcf.lines(spark, a.input)
        rows = vcf.body_lines(text).select("value", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("pos"), F.length(F.get("f", F.lit(3))).alias("n"))
        rows = filters.by_chromosome(rows.withColumn("chrom_num", chrom_num(F.col("chrom"))).where("pos is not null"), *a.chromosomes)
        bgzf.write_bgzf(rows, F.col("value"), a.output, length=F.greatest(F.col("n"), F.lit(1)))
    elif a.command == "fetch":
        rows = bgzf.read_bgzf(spark, a.input, a.regions).select("value", "file_name")
        order = rows.withColumn("f", F.split("value", "\t")).orderBy(chrom_num(F.get("f", F.lit(0))), F.get("f", F.lit(1)).cast("long"))
        sinks.write_lines(order, F.col("value"), a.output, one_file=a.one_file, compression=a.compression)
    elif a.command == "correct":
        # Genotypes keep their numbers: they are written against the reference that the file had.
        calls = vcf.read_vcf(spark, a.input).withColumn("genotypes", F.transform("gts", lambda g: encode(g, F.col("ref"), F.col("alts"))))
        fixed = reshape.correct_reference(calls, a.factor, a.shift)
        sinks.write_lines(reshape.order_by_sample(fixed, a.samples), sinks.vcf_line(), a.output, compression=a.compression)
    elif a.command == "split":
        paths = vcf.wide_paths(a.input, *a.chromosomes) if a.public_names else a.input
        long = filters.by_chromosome(vcf.read_wide(spark, paths, a.names, a.first), *a.chromosomes)
        split = reshape.split_samples(filters.by_regions(long, a.regions))
        sinks.write_samples(reshape.sample_lines(split, a.stacked), a.output, a.stacked, a.compression or "bzip2")
    elif a.command == "tfam":
        people, ids = vcf.read_family(spark, a.input, a.ids)
        rows = reshape.family(ids, people)
        if a.folders:  # the same rows for every chromosome
            every = F.explode(F.sequence(*[F.lit(c) for c in a.folders])).alias("chrom_num")
            rows = rows.select("*", every).orderBy("chrom_num", "ordinal")
        sinks.write_lines(rows, F.col("line"), a.output, by_chromosome=bool(a.folders))
    else:
        parts = partition.split_regions(partition.genome_splits(spark, a.parts, *a.chromosomes), a.prefix)
        line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "region"))), lambda x: x["region"]), ",")
        sinks.write_lines(parts.groupBy("split").agg(line.alias("value")).orderBy("split"), F.col("value"), a.output)


def main() -> None:
    spark = SparkSession.builder.appName("locusweave").getOrCreate()
    try:
        run(spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
