"""Helpers shared by the training-data operators: shared scratch tables, bounded work on Arrow batches, table reading."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch

if TYPE_CHECKING:
    import pyarrow as pa

#: Rows and bytes of an Arrow batch that an operator takes at once (one row may be longer). Spark itself bounds a batch by
#: spark.sql.execution.arrow.maxBytesPerBatch; no setting of the session is changed here.
SLICE_ROWS, SLICE_BYTES = 1024, 4_000_000


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables made by stash() that no plan reads any more."""
    for t in tables:
        if path := getattr(t, "stash_path", None):
            remove(t.sparkSession, path)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and, by their mean, about SLICE_BYTES bytes. Behind the last one the worker gives back what it has freed."""
    for b in batches:
        per = max(1, min(rows, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, per):
            yield b.slice(at, per)
    b = None
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: workers live on between tasks and stages, and their allocators would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def threshold(want: int, total: int) -> int:
    """Of 2 ** 63 equally likely values, below which a row belongs to a sample of about `want` of `total` rows; never 0 for a table with rows."""
    return max(1, min(1 << 63, (want << 63) // max(1, total)))


def sampled(df: DataFrame, want: int, *cols: Column | str, seed: int) -> DataFrame:
    """Rows with about 0.9 * want of the distinct values of these columns, or with all where there are no more, and `_sample`, a hash of the value.

    Values are picked, not rows, so neither is a table of one repeated row left without a sample nor is a sample larger than `want`, once the caller
    has dropped copies by `_sample` behind whatever makes the rows small. The number of distinct values is estimated to 2 %.
    """
    h = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 1)
    total = df.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    out = df.withColumn("_sample", h)
    return out if total <= 0.9 * want else out.where(F.col("_sample") < F.lit(threshold(9 * want // 10, total)))


#: Rows of a group that one task may get; groups that may be broadcast at most; rows of a table of a few numbers that is broadcast at most (some 20 MB).
HOT_ROWS, HOT_GROUPS, BROADCAST_ROWS = 100_000, 50_000, 200_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if it has BROADCAST_ROWS rows at most; beyond that Spark chooses the join. df: a written table of a few numbers."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], count: str = "c") -> DataFrame:
    """Left join of rows with a table of groups (one row for each key, `count`: how many rows it has at least in `rows`).

    A table of few groups is broadcast. Else rows of groups larger than a cut aren't gathered by their key: there are at most HOT_GROUPS such groups, whatever the
    input, and they are broadcast. All others are joined by key.
    """
    total, most, n = groups.agg(F.sum(count), F.max(count), F.count(F.lit(1))).first()
    cut = max(HOT_ROWS, (total or 0) // HOT_GROUPS)
    if n <= BROADCAST_ROWS or most <= cut:
        return rows.join(small(groups.drop(count), n), on, "left")
    hot = groups.where(F.col(count) > cut).drop(count).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), on, "left")
    others = marked.where("_hot is null").select(*rows.columns).join(groups.where(F.col(count) <= cut).drop(count), on, "left")
    return marked.where("_hot").drop("_hot").unionByName(others)


_HELD: dict = {}


def held(name: str, key, make):
    """What make() gives, kept in the worker for the next task with this key. A worker holds one such thing, whatever operators it has run."""
    if _HELD.get("key") != (name, key):
        forget()
        _HELD["value"], _HELD["key"] = make(), (name, key)
    return _HELD["value"]


def forget() -> None:
    """Operators that keep nothing in a worker free what others have kept."""
    if _HELD:
        _HELD.clear()
        give_back()


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as compressed bytes: first the lowest byte of each, and so on."""
    import pyarrow as pa

    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return len(a).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(a) else b"")


def expand(cell: bytes, kind=np.int32) -> np.ndarray:
    """What squeeze() was given."""
    import pyarrow as pa

    n, width = int.from_bytes(cell[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(cell[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(ident: Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % of


def fold_of(ident: int | None, of: int = 5) -> int:
    """The same as fold(), in Python."""
    return zlib.crc32(b"" if ident is None else str(ident).encode()) % of


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
