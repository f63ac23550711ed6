"""Exact deduplication by content sort (native: DataFrame functions only).

Sampled splitters cut the order of (first bytes, digest, id) into buckets of about equal size. One shuffle brings
each bucket together, Spark's external sort puts equal texts next to each other, and the window over the full text
compares neighbours byte by byte. The id is part of the order, so a text with any number of copies is dealt over as many
buckets as its share asks for: no bucket holds more than its share of the rows. Runs of one text that lie
in several buckets are put together by their SHA-256, at most one such run at the head of each bucket.

Defined results: a null text counts as empty; empty texts are equal to each other; repeated rows (same id, same text)
count in group_size, and exactly one of them is kept; null ids sort lowest; an empty table gives an empty result;
extra columns are ignored by content_groups and carried along by keep_one (columns that start with "_cs_" are refused).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Sampled rows for each bucket, and bytes of a text that lead the sort key.
SAMPLED_PER_BUCKET, LEAD = 24, 16
BUCKETS_PER_PARTITION = 4
#: Most buckets (and so rows of about 100 bytes) for which what runs over several buckets is broadcast.
BROADCAST_BUCKETS = 100_000


def _splitters(keyed: DataFrame, ident: str, buckets: int) -> list[str]:
    """buckets - 1 sort keys from a sample of at most about SAMPLED_PER_BUCKET x buckets rows (the only rows the driver sees)."""
    total = keyed.count()
    want = SAMPLED_PER_BUCKET * buckets
    # By a random number: equal rows are equally likely. Any splitters give right results.
    rows = (keyed if total <= want else keyed.where(F.rand(7) < want / total)).select("_cs_key").collect()
    keys = sorted((r[0] for r in rows), key=lambda k: k.encode("utf-8"))
    return sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)}, key=lambda k: k.encode("utf-8")) if keys else []


def _bucket(key: Column, splitters: list[str]) -> Column:
    """How many splitters are not above the key: a coarse level and a fine level, so about 2 sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    fine = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    below = lambda a: F.size(F.filter(a, lambda s: s <= key))
    coarse = below(F.array(*[F.lit(x[0]) for x in fine]))
    inner = below(F.get(F.array(*[F.array(*map(F.lit, x)) for x in fine]), coarse - 1))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + inner)


def _runs(df: DataFrame, text: str, ident: str, normalise, keep: str, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows with their run inside a bucket, texts whose runs lie in several buckets)."""
    spark = df.sparkSession
    buckets = buckets or BUCKETS_PER_PARTITION * partitions(spark)
    norm = normalise(F.coalesce(F.col(text), F.lit("")))
    # Known not to be null, so that no join puts a null filter below the shuffle, which then couldn't be shared.
    sha = F.coalesce(F.sha2(norm.cast("binary"), 256), F.lit(""))
    lead = F.base64(F.substring(norm.cast("binary"), 1, LEAD))
    key = F.concat_ws("|", F.hex(F.unbase64(lead)), F.col("_cs_sha"), F.lpad(F.coalesce(F.col(ident).cast("string"), F.lit("")), 20, "0"))
    if clash := [c for c in df.columns if c.lower().startswith("_cs_")]:
        raise ValueError(f"columns that start with _cs_ are reserved: {clash}")
    keyed = df.withColumn("_cs_text", norm).withColumn("_cs_sha", sha).withColumn("_cs_key", key)
    splitters = _splitters(keyed, ident, buckets)
    # The normalised text is made again behind the shuffle, which then carries each text once.
    dealt = keyed.withColumn("_cs_bucket", _bucket(F.col("_cs_key"), splitters)).drop("_cs_key", "_cs_text").repartition("_cs_bucket").withColumn("_cs_text", norm)
    dealt = dealt.withColumn("_cs_lead", F.concat(F.hex(F.substring(F.col("_cs_text").cast("binary"), 1, LEAD)), F.lit("|")))
    best = [F.col(ident).desc_nulls_last() if keep == "largest" else F.col(ident).asc_nulls_last()]
    # Rows of one id and text are told apart by their other columns, so the choice is the same in every run; and both uses of
    # the rows need the same columns, so they share one shuffle.
    if others := [c for c in df.columns if c not in (ident, text)]:
        best.append(F.xxhash64(*[F.col(c) for c in others]))
    # Inside a bucket the order is that of the splitters, so that what comes from the bucket before is at the head.
    order = ["_cs_lead", "_cs_sha", "_cs_text"]
    run = Window.partitionBy("_cs_bucket", *order).orderBy(*best)
    inside = Window.partitionBy("_cs_bucket").orderBy(*order, *best)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        dealt.withColumn("_cs_rn", F.row_number().over(run))
        .withColumn("_cs_head", F.dense_rank().over(inside) == 1)
        .withColumn("_cs_keep", F.first(ident).over(run))
        .withColumn("_cs_n", F.count(F.lit(1)).over(whole))
        .drop("_cs_text", "_cs_lead")
    )
    # A text that goes on from one bucket to the next is the head of the next one: only those need a sum over buckets.
    # Both are bounded by the number of buckets (one head each), so up to BROADCAST_BUCKETS they are broadcast; a hot text then
    # isn't gathered by its digest. Beyond that Spark chooses the join.
    small = F.broadcast if buckets <= BROADCAST_BUCKETS else (lambda d: d)
    tops = rows.where(F.col("_cs_rn") == 1).select("_cs_sha", "_cs_bucket", "_cs_keep", "_cs_n", "_cs_head")
    heads = small(tops.where("_cs_head").select("_cs_sha").distinct())
    pick = F.max("_cs_keep") if keep == "largest" else F.min("_cs_keep")
    spans = (
        tops.join(heads, "_cs_sha", "left_semi").groupBy("_cs_sha")
        .agg(pick.alias("_cs_all_keep"), F.sum("_cs_n").alias("_cs_all_n"), F.count(F.lit(1)).alias("_cs_parts"))
        .where("_cs_parts > 1").drop("_cs_parts")
    )
    return rows, small(spans)


def content_groups(df: DataFrame, text: str = "text", ident: str = "doc_id", normalise=lambda c: c, keep: str = "smallest", buckets: int | None = None) -> DataFrame:
    """One row for each input row: ident, keep_id, group_size, kept, text_sha256."""
    rows, spans = _runs(df.select(ident, text), text, ident, normalise, keep, buckets)
    keep_id = F.coalesce("_cs_all_keep", "_cs_keep")
    return rows.join(spans, "_cs_sha", "left").select(
        F.col(ident), keep_id.alias("keep_id"), F.coalesce("_cs_all_n", "_cs_n").cast("long").alias("group_size"),
        ((F.col("_cs_rn") == 1) & F.col(ident).eqNullSafe(keep_id)).alias("kept"), F.col("_cs_sha").alias("text_sha256"),
    )


def keep_one(df: DataFrame, text: str = "text", ident: str = "doc_id", normalise=lambda c: c, keep: str = "smallest", buckets: int | None = None) -> DataFrame:
    """The rows of df that stay, with all their columns."""
    rows, spans = _runs(df, text, ident, normalise, keep, buckets)
    first = rows.where(F.col("_cs_rn") == 1).join(spans, "_cs_sha", "left")
    return first.where(F.col(ident).eqNullSafe(F.coalesce("_cs_all_keep", "_cs_keep"))).select(*[F.col(c) for c in df.columns])
