"""Column functions of the variant engine; all are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chromosome names that are no numbers.
CHROM_NAMES = {"X": 23, "Y": 24, "XY": 25, "M": 26, "MT": 26}
#: FILTER classes by rank.
RANKS = {"PASS": 3, "Q20": 2, "Q10": 1}


def chrom_text(c: Column) -> Column:
    """The name without a leading "chr" in any case."""
    return F.when(F.lower(c.substr(1, 3)) == "chr", c.substr(F.lit(4), F.length(c))).otherwise(c)


def chrom_num(c: Column) -> Column:
    """1 to 26, or null for contigs outside the table."""
    name = F.upper(chrom_text(c))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in CHROM_NAMES.items() for x in pair]), name)
    n = F.coalesce(named, name.try_cast("int"))
    return F.when(n.between(1, 26), n)


def chrom_name(n: Column) -> Column:
    return F.when(n == 23, "X").when(n == 24, "Y").when(n == 25, "XY").when(n == 26, "M").otherwise(n.cast("string"))


def locus_key(n: Column, pos: Column, sample: Column | None = None) -> Column:
    """Zero-padded text key; parts longer than their width stay whole."""
    pad = lambda c, w: F.when(F.length(c.cast("string")) >= w, c.cast("string")).otherwise(F.lpad(c.cast("string"), w, "0"))
    parts = [pad(n, 2), pad(pos, 10)]
    return F.concat_ws("-", *parts, *([pad(sample, 3)] if sample is not None else []))


def key_parts(key: Column) -> Column:
    """struct(chrom_num, pos) of a text key."""
    p = F.split(key, "-")
    return F.struct(F.get(p, F.lit(0)).try_cast("int").alias("chrom_num"), F.get(p, F.lit(1)).try_cast("long").alias("pos"))


def quality_rank(flt: Column) -> Column:
    """PASS 3, q20 2, q10 1, anything else 0; only the FILTER column counts."""
    name = F.upper(flt)
    return F.when(name == "PASS", 3).when(name == "Q20", 2).when(name == "Q10", 1).otherwise(0)


def rank_of(option: str) -> int:
    if option.upper() not in RANKS:
        raise ValueError(f"unknown quality class: {option!r}")
    return RANKS[option.upper()]


def decode(gt: Column, ref: Column, alts: Column) -> Column:
    """struct(alleles, rest): letters of a called genotype and what follows it; null where any allele is not called."""
    call = F.regexp_extract(gt, "^([0-9]+(?:[/|][0-9]+)*)(?::.*)?$", 1)
    letters = F.transform(F.split(call, "[/|]"), lambda x: F.when(x == "0", ref).otherwise(F.coalesce(F.get(alts, x.try_cast("int") - 1), F.lit("."))))
    return F.when(call != "", F.struct(letters.alias("alleles"), F.regexp_extract(gt, "^[^:]*(:.*)?$", 1).alias("rest")))


def encode(call: Column, ref: Column, alts: Column) -> Column:
    """Text of a decoded genotype against another allele list; "." for what is in neither."""
    number = lambda a: F.when(a == ref, F.lit("0")).when(F.array_contains(alts, a), F.array_position(alts, a).cast("string")).otherwise(F.lit("."))
    return F.coalesce(F.concat(F.array_join(F.transform(call["alleles"], number), "/"), call["rest"]), F.lit("."))


def allele_pair(call: Column, ref: Column) -> Column:
    """Two alleles for a TPED row; a haploid call is repeated, an unknown allele or no call is the reference."""
    a = F.transform(call["alleles"], lambda x: F.when(x == ".", ref).otherwise(x))
    return F.when(call.isNull(), F.concat_ws(" ", ref, ref)).when(F.size(a) == 1, F.concat_ws(" ", a[0], a[0])).otherwise(F.array_join(a, " "))


def affine(pos: Column, x: float, y: int) -> Column:
    """Truncated pos * x, moved by y."""
    return (pos * F.lit(float(x))).cast("long") + F.lit(int(y))


def half_up(c: Column, digits: int = 2) -> Column:
    k = F.lit(float(10**digits))
    return F.floor(c * k + 0.5).cast("double") / k


def sex_code(c: Column) -> Column:
    return F.when(c == "M", 1).when(c == "F", 2).otherwise(0)


def pheno_code(c: Column) -> Column:
    return F.when(c == "Case", 2).when(c == "Control", 1).otherwise(0)


def parse_region(text: str) -> tuple[int, int, int | None]:
    """(chrom_num, start, end) of chr:start-end, chr:start or chr; an open end is None. ValueError for any other text."""
    m = re.fullmatch(r"([^:]+)(?::([0-9]+)(?:-([0-9]+))?)?", text.strip())
    name = re.sub("^chr", "", m[1], flags=re.I).upper() if m else ""
    number = CHROM_NAMES.get(name) or (int(name) if name.isdecimal() and name.isascii() else 0)
    if not 1 <= number <= 26 or (m[3] and int(m[3]) < int(m[2])):
        raise ValueError(f"not a region: {text!r}")
    return number, int(m[2] or 1), int(m[3]) if m[3] else None


def region(c: Column) -> Column:
    """struct(chrom_num, start, end) of chr:start-end, chr:start or chr; an open end is null."""
    part = lambda k: F.regexp_extract(F.trim(c), r"^([^:]+)(?::([0-9]+)(?:-([0-9]+))?)?$", k)
    return F.struct(chrom_num(part(1)).alias("chrom_num"), F.coalesce(part(2).try_cast("long"), F.lit(1).cast("long")).alias("start"), part(3).try_cast("long").alias("end"))
