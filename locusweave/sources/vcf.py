"""Readers: per-sample and multi-sample variant text, family information, the call store, fixed-width weather records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import chrom_num, decode

CALL_COLUMNS = ["sample_id", "chrom", "chrom_num", "pos", "id", "ref", "alts", "qual", "filter", "info", "format", "gts"]


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Text lines with their file's name; plain, gz and bz2 files in one directory or many."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))


def sample_of(file_name: Column) -> Column:
    """The integer before the first dot of a file's name."""
    return F.regexp_extract(file_name, r"^([0-9]+)\.", 1).try_cast("int")


def trailing_number(file_name: Column) -> Column:
    """The number that ends a bz2 file's stem."""
    return F.regexp_extract(file_name, r"([1-9][0-9]*)\.bz2$", 1).try_cast("int")


#: Files whose headers are broadcast at most; with more the join is Spark's choice.
BROADCAST_FILES = 2_000
#: How a file's name gives its sample.
NUMBERED = {"leading": sample_of, "trailing": trailing_number}


def sample_files(spark: SparkSession, path: str | list[str], numbered: str = "leading", glob: str | None = None) -> DataFrame:
    """file_name, sample_id of the files to be read; only names are listed."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob or "*")
    names = reader.load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    return names.select("file_name", NUMBERED[numbered](F.col("file_name")).alias("sample_id"))


def check_samples(spark: SparkSession, path: str | list[str], n: int, numbered: str = "leading", absent: bool = False, glob: str | None = None) -> None:
    """ValueError where a file has no number or one outside 1 to n, or (unless absent is allowed) a sample has no file. One short row for each file goes to the driver."""
    files = sample_files(spark, path, numbered, glob).collect()
    if odd := sorted(r["file_name"] for r in files if r["sample_id"] is None or not 1 <= r["sample_id"] <= n):
        raise ValueError(f"files that are no sample of 1 to {n}: {', '.join(odd[:20])}")
    if missing := sorted(set(range(1, n + 1)) - {r["sample_id"] for r in files}):
        if not absent:
            raise ValueError(f"samples without a file: {', '.join(map(str, missing[:20]))}")


def body_lines(text: DataFrame) -> DataFrame:
    """Without headers and empty lines, and with the fields f. They come from a generator, as Spark would move later filters below a plain column and split each line once for every use of f in them."""
    return text.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).withColumn("f", F.explode(F.array(F.split(F.trim(F.col("value")), r"\s+"))))


def fault(columns: tuple[int, ...] = (9,)) -> Column:
    """Why a line with sample_id and fields f is no call: too few fields, a contig outside the table, a position that is no number, no sample; null for a call."""
    at = lambda k: F.get(F.col("f"), F.lit(k))
    short = F.size("f") <= max(columns)
    return (
        F.when(short, "fields").when(chrom_num(at(0)).isNull(), "contig").when(at(1).try_cast("long").isNull(), "position")
        .when(F.col("sample_id").isNull(), "sample")
    )


def rejected(text: DataFrame, columns: tuple[int, ...] = (9,)) -> DataFrame:
    """The lines that parse_checked() leaves out, with their reason; the other columns of text are kept."""
    return body_lines(text).withColumn("reason", fault(columns)).where("reason is not null").drop("f")


def parse_checked(text: DataFrame, columns: tuple[int, ...] = (9,), decoded: bool = True) -> DataFrame:
    """parse_calls() of the lines without a fault; rejected() has all others."""
    good = body_lines(text).where(fault(columns).isNull()).drop("f")
    return parse_calls(good, columns, decoded)


def parse_calls(text: DataFrame, columns: tuple[int, ...] = (9,), decoded: bool = True) -> DataFrame:
    """Lines with sample_id to calls. columns: the genotype columns (0-based). Headers, empty lines, unknown contigs and rows without a position are left out.

    decoded: genotypes as structs (gts); else as they are (texts), for merges, which decode what stays.
    """
    rows = body_lines(text).select("sample_id", "f")
    at = lambda k: F.get(F.col("f"), F.lit(k))
    typed = rows.select(
        "sample_id", at(0).alias("chrom"), chrom_num(at(0)).alias("chrom_num"), at(1).try_cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"),
        F.filter(F.split(at(4), ","), lambda a: a != ".").alias("alts"), at(5).try_cast("double").alias("qual"), at(6).alias("filter"), at(7).alias("info"), at(8).alias("format"),
        F.array(*[at(k) for k in columns]).alias("_g"),
    )
    typed = typed.where("chrom_num is not null and pos is not null")
    if not decoded:
        return typed.withColumnRenamed("_g", "texts")
    return typed.withColumn("gts", F.transform("_g", lambda g: decode(g, F.col("ref"), F.col("alts")))).select(*CALL_COLUMNS)


def read_vcf(spark: SparkSession, path: str | list[str], columns: tuple[int, ...] = (9,), glob: str | None = None, numbered: str = "leading", decoded: bool = True) -> DataFrame:
    """Per-sample files; the sample is the number that begins the file's name, or ends its stem (numbered="trailing"), or the folder's, as written by Spark (numbered="folder": sample_id=7/)."""
    if numbered == "folder":
        return parse_calls(spark.read.text(path).select("value", F.col("sample_id").cast("int")), columns, decoded)
    return parse_calls(lines(spark, path, glob).select("value", NUMBERED[numbered](F.col("file_name")).alias("sample_id")), columns, decoded)


def read_tped(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom_num, rs, pos, ref, genotypes (allele pairs) of merged blocks with the reference column (sinks.tped_line(ref=True)), to be merged further.

    Folders by chromosome are read as well. Rows of another shape are left out.
    """
    f, g = F.split(F.trim("value"), "\t"), F.split(F.get("f", F.lit(5)), " ")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == 6).select("f", g.alias("g")).where(F.size("g") % 2 == 0)
    at = lambda k: F.get("f", F.lit(k))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("g") / 2 - 1).cast("int")), lambda i: F.concat_ws(" ", F.get("g", 2 * i), F.get("g", 2 * i + 1)))
    out = rows.select(chrom_num(at(0)).alias("chrom_num"), at(1).alias("rs"), at(3).try_cast("long").alias("pos"), at(4).alias("ref"), pairs.alias("genotypes"))
    return out.where("chrom_num is not null and pos is not null")


def wide_paths(directory: str, first: int, last: int) -> list[str]:
    """Globs of the multi-sample files of chromosomes first to last in the usual public naming; X, Y and M have versions of their own, and M is called MT."""
    names = {23: "X", 24: "Y", 25: "XY", 26: "MT"}
    return [f"{directory.rstrip('/')}/ALL.chr{names.get(c, c)}.*.vcf.gz" for c in range(first, last + 1)]


def read_wide(spark: SparkSession, path: str | list[str], names: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Multi-sample text in long form: one row for each record and chosen sample, with its genotype text.

    names: chosen samples; first: the first so many of the header. Columns are found by name in each file's own header: one row for each
    file, broadcast for up to BROADCAST_FILES files.
    """
    text = lines(spark, path)
    head = text.where(F.col("value").startswith("#CHROM")).select("file_name", F.slice(F.split(F.trim("value"), r"\s+"), 10, 1_000_000).alias("names"))
    picked = F.transform("names", lambda n, i: F.struct(n.alias("name"), i.alias("at")))
    if names is not None:
        picked = F.filter(picked, lambda p: p["name"].isin(*names))
    if first is not None:
        picked = F.slice(picked, 1, first)
    head = head.select("file_name", picked.alias("picked"))
    if sample_files(spark, path).count() <= BROADCAST_FILES:
        head = F.broadcast(head)
    f = F.split(F.trim(F.col("value")), r"\s+")
    body = text.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select("file_name", f.alias("f")).join(head, "file_name")
    at = lambda k: F.get(F.col("f"), F.lit(k))
    fixed = [chrom_num(at(0)).alias("chrom_num"), at(1).try_cast("long").alias("pos")]
    fixed += [at(k).alias(c) for k, c in enumerate(["chrom", "_", "id", "ref", "alt", "qual", "filter", "info", "format"]) if c != "_"]
    return body.select(*fixed, "f", F.explode("picked").alias("p")).withColumn("gt", F.get("f", F.col("p.at") + 9)).withColumn("sample", F.col("p.name")).drop("f", "p")


def read_family(spark: SparkSession, info: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(patients, ids) of the two whitespace files; ids keep the order of the file."""
    f = F.split(F.trim(F.col("value")), r"\s+")
    at = lambda k: F.get(F.col("f"), F.lit(k))
    people = spark.read.text(info).where(F.length(F.trim("value")) > 0).select(f.alias("f"))
    people = people.select(at(0).alias("patient_id"), at(1).alias("sample_id"), at(3).alias("gender"), at(5).alias("pheno"))
    words = spark.read.text(names, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("ordinal", "patient_id"))
    return people, words


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width weather records: station, time, temperature, quality."""
    cut = lambda a, b: F.substring("value", a + 1, b - a)
    value = F.when(cut(87, 88) == "+", cut(88, 92)).when(cut(87, 88) == "-", cut(87, 92))  # a value without a sign is malformed
    return spark.read.text(path).select(
        F.concat_ws("-", cut(4, 10), cut(10, 15)).alias("station"), F.try_to_timestamp(cut(15, 27), F.lit("yyyyMMddHHmm")).alias("ts"), value.try_cast("int").alias("temp"), cut(92, 93).alias("quality")
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The call store; filters on chrom_num prune its folders, those on pos its row groups.

    It takes the place of an index over text: load once, then regions are read without a scan of all the rest.
    """
    return spark.read.parquet(path)
