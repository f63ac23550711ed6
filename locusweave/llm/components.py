"""Connected components of a table of links, by alternating large-star and small-star steps on DataFrames.

Links and labels stay on the executors. Each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id that has a link, with the smallest id it can reach. links: two long columns a and b; null ids and self-links count for nothing."""
    e = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stash(e, "links")
    before = None
    while True:  # until a round changes nothing
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        done, e = e, stash(small, "links")
        drop(done)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = stash(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    drop(e)
    return out
