"""Best-fit packing of token sequences by exact-complement hashing.

Tokens: each document is tokenised once, and pieces of at most `size` tokens are written to a table. Plan: only the
histogram of piece lengths (at most `size` numbers, whatever the input) goes to the driver. A bin is opened by the longest
length left; its gap is looked up in an index of single, pair and triple length sums, under the counts
still available, and combinations that fill it exactly are used up in bulk. Where there is none, the largest length
that fits goes in (best fit) and the rest of the gap is looked up again. Places: the plan is a list of rank ranges per length;
each piece gets its rank among the pieces of its length and so its sequence and offset.

Defined results: a null text counts as empty, and an empty document is its end token alone; repeated rows are packed as
often as they occur; an empty table gives an empty result; extra columns are ignored. Texts longer than `size`
tokens are cut into pieces of exactly `size` tokens and a rest.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load
from .common import sliced, stash

#: The id that ends each document.
END = 1


def pieces(df: DataFrame, path: str, size: int, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, piece, start, length, ids_crc32 of each piece."""
    import pyarrow as pa

    def run(batches):
        tok = load(path)
        end = END.to_bytes(4, "little")
        for b in sliced(batches):
            rows, no, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(tok.encode_batch(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for k in range(0, n, size):
                    part = ids[4 * k : 4 * (k + size)]
                    rows.append(row)
                    no.append(k // size)
                    start.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            take = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([take, pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [ident, "piece", "start", "length", "ids_crc32"])

    src = df.select(ident, text)
    return src.mapInArrow(run, f"`{ident}` {src.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Bins of capacity `size` for a histogram of lengths, in bulk: a pattern is a tuple of lengths, used some number of times.

    The index: `left` has how many pieces of each length are available (singles), `pairs` for each sum how many pairs
    of available lengths make it. A triple is a length whose rest has a pair. Both are kept up as lengths run out.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.left = size, np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.zeros(size + 1, np.int64)
        there = np.flatnonzero(self.left)
        for x in there.tolist():
            self._count_pairs(x, there[there > x], 1)
            if self.left[x] > 1 and 2 * x <= size:
                self.pairs[2 * x] += 1
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._solve()

    def _count_pairs(self, x: int, others: np.ndarray, by: int) -> None:
        """Pairs of length x with other lengths come or go."""
        self.pairs[x + others[others <= self.size - x]] += by

    def _use(self, x: int, n: int) -> None:
        """n pieces of length x are no longer available."""
        before = int(self.left[x])
        self.left[x] = after = before - n
        if before > 1 >= after and 2 * x <= self.size:
            self.pairs[2 * x] -= 1
        if before > 0 == after:
            self._count_pairs(x, np.flatnonzero(self.left), -1)

    def _take(self, lengths: tuple[int, ...], bins: int) -> int:
        """Use up the lengths for as many of the bins as the counts allow; how many that are."""
        need = {x: lengths.count(x) for x in lengths}
        n = min(bins, *(int(self.left[x]) // k for x, k in need.items()))
        for x, k in need.items():
            self._use(x, n * k)
        return n

    def _pairs_of(self, total: int) -> list[tuple[int, int]]:
        """The available pairs with this sum; those with the longest length first."""
        if total < 2 or not self.pairs[total]:
            return []
        here = self.left[: total] > 0
        b = np.flatnonzero(here[1:] & here[:0:-1]) + 1  # b and total - b
        b = b[(2 * b > total) | ((2 * b == total) & (self.left[b] > 1))]
        return [(x, total - x) for x in b[::-1].tolist()]

    def _exact(self, gap: int) -> tuple[int, ...] | None:
        """A single, pair or triple of available lengths that sums to the gap; long lengths come first."""
        if self.left[gap]:
            return (gap,)
        if two := self._pairs_of(gap):
            return two[0]
        a = np.arange(gap - 2, 0, -1)
        # Of the pairs that make the rest only the one with this length itself may ask for more pieces of it than there are.
        for x in a[(self.left[a] > 0) & (self.pairs[gap - a] > 0)].tolist():
            for two in self._pairs_of(gap - x)[:3]:
                if self.left[x] >= 1 + two.count(x):
                    return (x, *two)
        return None

    def _solve(self) -> None:
        size, left = self.size, self.left
        while True:
            there = np.flatnonzero(left)
            if not there.size:
                return
            longest = int(there[-1])
            bins = int(left[longest])
            # Bins that share their content so far; a bin needs its own opener, so identical openers are taken one by one in bulk.
            per = max(1, size // longest)
            bins = max(1, bins // per) if per > 1 else bins
            self._use(longest, bins)
            self._fill((longest,), size - longest, bins)

    def _fill(self, content: tuple[int, ...], gap: int, bins: int) -> None:
        todo = [(content, gap, bins)]
        while todo:
            content, gap, bins = todo.pop()
            while bins:
                if gap == 0:
                    self.patterns.append((content, bins))
                    break
                if found := self._exact(gap):
                    n = self._take(found, bins)
                    self.patterns.append((content + found, n))
                    bins -= n
                    continue
                fits = np.flatnonzero(self.left[: gap + 1])
                if not fits.size:
                    self.patterns.append((content, bins))
                    break
                best = int(fits[-1])
                n = min(bins, int(self.left[best]))
                self._use(best, n)
                if n < bins:
                    todo.append((content, gap, bins - n))
                content, gap, bins = (*content, best), gap - best, n


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset), sorted: the pieces of a length with these ranks go to consecutive sequences at this offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            at = used.get(x, 0)
            rows.append((x, at, n, sequence, offset))
            used[x] = at + n
            offset += x
        sequence += n
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(df: DataFrame, path: str, size: int = 4096, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, piece, start, length, ids_crc32, sequence_id, offset; one row for each piece."""
    import pyarrow as pa

    cut = stash(pieces(df, path, size, text, ident).withColumn("_part", F.spark_partition_id()), "pieces")
    sums = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `size` rows
    plan = places(Plan({r["length"]: r["n"] for r in sums}, size).patterns)
    # The rank among pieces of a length: those of earlier parts, then the order inside the part; no part meets another.
    per = cut.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select("_part", "length", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part", "length").orderBy(ident, "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("_in", inside).join(base, ["_part", "length"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    keys = plan[:, 0] << 44 | plan[:, 1]  # a length is at most `size`, a rank below 2 ** 44

    def locate(batches):
        for b in sliced(batches):
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(plan[at, 3] + rank - plan[at, 1]), pa.array(plan[at, 4])], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema[ident].dataType.simpleString()
    return ranked.select(ident, "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(locate, f"`{ident}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
