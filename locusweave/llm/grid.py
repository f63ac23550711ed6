"""Blocks of an index met with chunks of queries, each pair once, on a grid of cells.

Blocks are dealt into R groups and chunks into A groups; a cell is one group of each. Every block is carried to A cells and every chunk to R, where A and R
are chosen so that both sides move about the same number of bytes: with C cells, bytes x sqrt(C) in all, not bytes x chunks.
Pairs of a cell lie together in one task, so a task keeps the best results of its chunks over all blocks of the cell and a query has R partial results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Pairs of a cell, beyond which there are more cells.
CELL_PAIRS = 256


def shape(blocks: int, chunks: int, block_bytes: int, chunk_bytes: int, cores: int) -> tuple[int, int]:
    """(R, A) for so many blocks and chunks of these sizes: at least 4 cells for each core, at most CELL_PAIRS pairs in a cell."""
    blocks, chunks = max(1, blocks), max(1, chunks)
    cells = min(blocks * chunks, max(4 * cores, -(-blocks * chunks // CELL_PAIRS)))
    even = math.sqrt(cells * chunks * max(1, chunk_bytes) / (blocks * max(1, block_bytes)))
    a = max(1, min(chunks, round(even)))
    r = min(blocks, -(-cells // a))
    return r, min(chunks, -(-cells // r))


def pairs(blocks: DataFrame, chunks: DataFrame, block_bytes: int, chunk_bytes: int) -> DataFrame:
    """cell, then the columns of both tables, which are written tables of bounded rows with the numbers `block` and `chunk`; the rows of a cell follow each other."""
    spark = blocks.sparkSession
    r, a = shape(blocks.count(), chunks.count(), block_bytes, chunk_bytes, spark.sparkContext.defaultParallelism)
    rows, cols = F.pmod(F.xxhash64("block"), F.lit(r)), F.pmod(F.xxhash64("chunk"), F.lit(a))
    left = blocks.withColumn("cell", F.explode(F.sequence(rows * a, rows * a + (a - 1)))).repartition(r * a, "cell")
    right = chunks.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long")), lambda g: g * a + cols))).repartition(r * a, "cell")
    return left.hint("merge").join(right.hint("merge"), "cell")


def cells(batches) -> Iterator[tuple[int, Iterator[dict]]]:
    """The pairs of each cell in turn, as dicts; each must be read to its end."""
    flat = (b.slice(i, 1).to_pylist()[0] for s in sliced(batches, 64) for b in (s,) for i in range(b.num_rows))
    row = next(flat, None)

    def one(cell: int) -> Iterator[dict]:
        nonlocal row
        while row is not None and row["cell"] == cell:
            now, row = row, next(flat, None)
            yield now

    while row is not None:
        at = row["cell"]
        yield at, one(at)
