"""Hard-negative mining by bit-sliced integer products.

Index: rows are cut into blocks, and each block holds its quantised components as bit-planes (offset so that all are
unsigned). A block meets a chunk of anchors, plane by plane, the most significant first: each plane's product with the anchors is added to a partial score,
and what the planes below can still add or take away (the anchor's positive and negative components times their highest value)
bounds each score from both sides. A row is dropped for an anchor once its interval cannot qualify: for positives, once its upper end is below the k-th highest
lower end; for negatives, once it lies outside every positive's window, or below the k-th highest lower end of those that surely lie inside it. While many
rows are open a plane is one matrix product, later only the open rows are taken. After the last plane scores are exact.

Two passes on a grid of cells (see grid): the first finds each anchor's positives among the rows of its label, the second the negatives for each positive.
Sums are in float64 where no sum can reach 2 ** 53, else in Python's integers.

Defined results: rows without id, label or vector, with an empty vector, or with a null or non-finite component take no part; a quantised component or a resulting
score that doesn't fit a long is an error; shorter vectors count as filled with zeros; rows with the anchor's own id are
never its positives or negatives; repeated rows are rows of their own, as anchors, positives and negatives, each with its own ranks; an anchor
without another row of its label has no result, nor has a positive without a row in its window (for a negative positive score the window is empty); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .bitslice import quantised
from .common import drop, sliced, stash

#: Rows of a block and anchors of a chunk at most.
BLOCK_ROWS, CHUNK = 4_096, 256
#: Of the pairs of a block and a chunk, the share that is open, below which only those are taken.
SPARSE = 0.15
#: Sums below it are exact in float64.
EXACT = 1 << 53


class Planes:
    """Bit-planes of a block: for each bit the rows' components as packed bits."""

    def __init__(self, packed: np.ndarray, dims: int, low: int):
        self.packed, self.dims, self.low, self.bits = packed, dims, low, len(packed)

    @classmethod
    def of(cls, values: np.ndarray) -> Planes:
        low = int(values.min(initial=0))
        u = values.view(np.uint64) - np.array(low, np.int64).view(np.uint64)
        bits = max(1, int(u.max(initial=0)).bit_length())
        return cls(np.stack([np.packbits((u >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(bits)]), values.shape[1], low)

    def plane(self, bit: int, kind) -> np.ndarray:
        return np.unpackbits(self.packed[bit], axis=1, count=self.dims).astype(kind)

    def only(self, rows: np.ndarray) -> Planes:
        return Planes(self.packed[:, rows], self.dims, self.low)


def narrowed(planes: Planes, anchors: np.ndarray, open_rows: list[np.ndarray], still) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor the rows that are left, in order, and their exact scores.

    open_rows: rows that may answer each anchor. still(i, partial, low, high): which of the anchor's open rows stay, where their scores lie between partial + low and partial + high.
    """
    a = np.zeros((len(anchors), planes.dims), np.int64)
    width = min(planes.dims, anchors.shape[1])
    a[:, :width] = anchors[:, :width]
    most = max((sum(map(abs, x)) for x in a.tolist()), default=0) * ((1 << planes.bits) + abs(planes.low))
    exact = object if most >= EXACT else np.float64
    narrow = object if exact is object else np.float32 if most < 1 << 24 or np.abs(a).sum(axis=1).max(initial=0) < 1 << 24 else np.float64  # a plane's own product is smaller
    wide = a.astype(object) if exact is object else a
    up, down, total = (x.sum(axis=1) for x in (np.where(wide > 0, wide, 0), np.where(wide < 0, wide, 0), wide))
    factors = a.astype(narrow)
    partial: list = [np.full(len(rows), int(t) * planes.low, exact) for rows, t in zip(open_rows, total)]
    left = list(open_rows)
    size = planes.packed.shape[1] * max(1, len(a))
    for bit in range(planes.bits - 1, -1, -1):
        bits = planes.plane(bit, narrow)
        dense = (factors @ bits.T).astype(exact) if sum(map(len, left)) > SPARSE * size else None
        rest = (1 << bit) - 1
        for i, rows in enumerate(left):
            if not len(rows):
                continue
            gain = dense[i][rows] if dense is not None else (bits[rows] @ factors[i]).astype(exact)
            p = partial[i] + gain * (1 << bit)
            stays = still(i, p, int(down[i]) * rest, int(up[i]) * rest)
            if stays is None or stays.all():
                partial[i] = p
            else:
                left[i], partial[i] = rows[stays], p[stays]
    return list(zip(left, partial))


def kth_highest(x: np.ndarray, k: int):
    """The k-th highest value; None where there are fewer."""
    if len(x) < k:
        return None
    return np.sort(x)[-k] if x.dtype == object else np.partition(x, len(x) - k)[len(x) - k]


def best_rows(rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(row, score) of the k highest; rows are in the order in which ties are broken."""
    if len(rows) > 4 * k and (t := kth_highest(scores, k)) is not None:
        rows, scores = rows[scores >= t], scores[scores >= t]
    order = np.argsort(-scores, kind="stable")[:k]
    return [(int(rows[j]), int(scores[j])) for j in order]


def nearest_of_label(planes: Planes, anchors: np.ndarray, open_rows: list[np.ndarray], floors: list, k: int) -> list[list[tuple[int, int]]]:
    """Each anchor's k best rows; floors: scores below which a row doesn't count (None: none yet)."""

    def still(i, p, low, high):
        t = kth_highest(p, k)
        bound = None if t is None else t + low
        if floors[i] is not None:
            bound = floors[i] if bound is None else max(bound, floors[i])
        return None if bound is None else p + high >= bound

    return [best_rows(rows, scores, k) for rows, scores in narrowed(planes, anchors, open_rows, still)]


def window(score: int) -> tuple[int, int]:
    """The lowest and highest negative score for a positive's: 50 * positive <= 100 * negative <= 95 * positive."""
    return -(-score // 2), 19 * score // 20


def within_windows(planes: Planes, anchors: np.ndarray, open_rows: list[np.ndarray], windows: list[list[tuple[int, int]]], floors: list[list], k: int) -> list[list[list[tuple[int, int]]]]:
    """For each anchor and window its k best rows; floors as above, for each window."""

    def still(i, p, low, high):
        stays = np.zeros(len(p), bool)
        for (least, most), floor in zip(windows[i], floors[i]):
            t = kth_highest(p[(p >= least - low) & (p <= most - high)], k)
            bound = least if t is None else max(least, t + low)
            if floor is not None:
                bound = max(bound, floor)
            stays |= (p >= bound - high) & (p <= most - low)
        return stays

    out = []
    for i, (rows, scores) in enumerate(narrowed(planes, anchors, open_rows, still)):
        out.append([])
        for least, most in windows[i]:
            inside = (scores >= least) & (scores <= most)
            out[-1].append(best_rows(rows[inside], scores[inside], k))
    return out


class Best:
    """The k best (score, id) of each key over many blocks."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, key, found: list[tuple[int, int]]) -> None:
        """found: (id, score)."""
        if found:
            self.rows[key] = sorted(self.rows.get(key, []) + found, key=lambda x: (-x[1], x[0]))[: self.k]

    def floor(self, key):
        have = self.rows.get(key, ())
        return have[-1][1] if len(have) == self.k else None


def _packed(batches, size: int, planes: bool):
    """Rows (_id, _row, _label, q and maybe positives) in parts of at most `size`, each one row of bytes; in a part they are in the order of ids."""
    import pyarrow as pa

    kinds = {"ids": pa.binary(), "places": pa.binary(), "labels": pa.list_(pa.string()), "dims": pa.int32(), "low": pa.int64(), "vectors": pa.list_(pa.binary()), "positives": pa.list_(pa.list_(pa.list_(pa.int64())))}
    schema, held = pa.schema(kinds), []

    def part():
        held.sort(key=lambda r: r["_id"])
        v = np.zeros((len(held), max(len(r["q"]) for r in held)), np.int64)
        for i, r in enumerate(held):
            v[i, : len(r["q"])] = r["q"]
        p = Planes.of(v) if planes else None
        vectors = [x.tobytes() for x in p.packed] if planes else [v.tobytes()]
        chosen = [[[x["pos_rank"], x["pos_id"], x["pos_score"]] for x in r.get("positives") or []] for r in held]
        cells = {"ids": np.array([r["_id"] for r in held], np.int64).tobytes(), "places": np.array([r["_row"] for r in held], np.int64).tobytes(), "labels": [r["_label"] for r in held]}
        cells |= {"dims": v.shape[1], "low": p.low if planes else 0, "vectors": vectors, "positives": chosen}
        held.clear()
        return pa.RecordBatch.from_pydict({k: [x] for k, x in cells.items()}, schema=schema)

    for b in sliced(batches):
        for r in b.to_pylist():
            held.append(r)
            if len(held) == size:
                yield part()
    if held:
        yield part()


PART = "ids binary, places binary, labels array<string>, dims int, low long, vectors array<binary>, positives array<array<array<bigint>>>"


def packed(rows: DataFrame, size: int, number: str, name: str, planes: bool) -> DataFrame:
    """A written table of parts with their number."""
    return stash(rows.mapInArrow(lambda batches: _packed(batches, size, planes), PART).withColumn(number, F.monotonically_increasing_id()), name)


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, list[str]]:
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["places"], np.int64), r["labels"]


def _search(index: DataFrame, chunks: DataFrame, dims: int, k: int, negatives: bool) -> DataFrame:
    """place (the anchor's), pos_rank, id, score: the k best of each cell."""
    import pyarrow as pa

    left = index.select("block", F.struct("ids", "places", "labels", "dims", "low", "vectors").alias("b"))
    right = chunks.select("chunk", F.struct("ids", "places", "labels", "dims", "low", "vectors", "positives").alias("c"))
    both = grid.pairs(left, right, BLOCK_ROWS * dims, 8 * CHUNK * dims)

    def run(batches):
        for _, met in grid.cells(batches):
            best = Best(k)
            for r in met:
                ids, _, labels = _unpacked(r["b"])
                b, c = r["b"], r["c"]
                planes = Planes(np.stack([np.frombuffer(x, np.uint8).reshape(len(ids), -1) for x in b["vectors"]]), b["dims"], b["low"])
                own, places, theirs = _unpacked(c)
                vectors = np.frombuffer(c["vectors"][0], np.int64).reshape(len(own), -1)
                number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
                code = np.array([number[x] for x in labels])
                lab = np.array([number.get(x, -1) for x in theirs])
                if negatives:
                    rows = [np.flatnonzero((code != lab[i]) & (ids != own[i])) for i in range(len(own))]
                    windows = [[window(s) for _, _, s in x] for x in c["positives"]]
                    floors = [[best.floor((places[i], j)) for j, _, _ in x] for i, x in enumerate(c["positives"])]
                    for i, lists in enumerate(within_windows(planes, vectors, rows, windows, floors, k)):
                        for (j, _, _), found in zip(c["positives"][i], lists):
                            best.add((places[i], j), [(int(ids[x]), s) for x, s in found])
                    continue
                for label in np.unique(lab[lab >= 0]).tolist():
                    members, asked = np.flatnonzero(code == label), np.flatnonzero(lab == label)
                    rows = [np.flatnonzero(ids[members] != own[i]) for i in asked]
                    for i, found in zip(asked, nearest_of_label(planes.only(members), vectors[asked], rows, [best.floor((places[i], 0)) for i in asked], k)):
                        best.add((places[i], 0), [(int(ids[members[x]]), s) for x, s in found])
            flat = [(int(place), int(j), i, s) for (place, j), found in best.rows.items() for i, s in found]
            if any(not -(1 << 63) <= x[3] < 1 << 63 for x in flat):
                raise OverflowError("hard_negatives: a score doesn't fit a long")
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], pa.int64()) for n in range(4)], ["place", "pos_rank", "id", "score"])

    return both.select("cell", "b", "c").mapInArrow(run, "place long, pos_rank long, id long, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 3, ident: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. is_anchor, label: columns of rows."""
    spark = rows.sparkSession
    tagged = rows.select(F.col(ident).alias("_id"), F.col(vector).alias("_v"), (F.col(label) if isinstance(label, str) else label).cast("string").alias("_label"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    q = stash(quantised(tagged, "_id", "_v", scale, ("_label", "_anchor")).where("_label is not null").withColumn("_row", F.monotonically_increasing_id()), "quantised")
    anchors = q.where("_anchor")
    n, n_anchors, dims = q.agg(F.count(F.lit(1)), F.count(F.when(F.col("_anchor"), 1)), F.max(F.size("q"))).first()
    tasks = spark.sparkContext.defaultParallelism
    columns = ["_id", "_row", "_label", "q"]
    index = packed(q.select(*columns).coalesce(max(tasks, n // BLOCK_ROWS)), BLOCK_ROWS, "block", "planes", True)
    chunks = packed(anchors.select(*columns).coalesce(max(4, n_anchors // CHUNK)), CHUNK, "chunk", "anchors", False)
    near = _ranked(_search(index, chunks, dims or 1, positives, False), ["place"], positives)
    chosen = stash(near.select("place", F.col("rank").cast("long").alias("pos_rank"), F.col("id").alias("pos_id"), F.col("score").alias("pos_score")), "positives")
    drop(chunks)
    each = chosen.groupBy("place").agg(F.collect_list(F.struct("pos_rank", "pos_id", "pos_score")).alias("positives")).withColumnRenamed("place", "_row")
    asked = anchors.select(*columns).join(each, "_row").select(*columns, "positives")
    chunks = packed(asked.coalesce(max(4, n_anchors // CHUNK)), CHUNK, "chunk", "anchors", False)
    found = stash(_ranked(_search(index, chunks, dims or 1, negatives, True), ["place", "pos_rank"], negatives), "negatives")
    drop(index, chunks)
    who = anchors.select(F.col("_row").alias("place"), F.col("_id").alias("anchor_id"))
    out = found.join(chosen, ["place", "pos_rank"]).join(who, "place")
    return out.select("anchor_id", F.col("pos_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("pos_score").alias("positive_score"), F.col("score").alias("negative_score"))
