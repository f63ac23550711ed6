"""Exact top-k inner products on a bit-sliced index.

Index: rows are cut into blocks. A block holds, for each attribute of the quantised vectors, one bitmap over its rows for each
bit of the value (offset so that all are unsigned). Search, for each query and block: the attribute's slices, complemented
where the query's component is negative, are added with their weights (the bits of the component's size) by carry-save
bitmap arithmetic, which gives the slices of all scores at once. The k best rows are found from the most
significant slice downward; where the boundary value is shared by too many rows, the smallest ids among them are taken,
so ties are exact. The best k of all blocks meet per query.

Queries are a stated set against all rows, in blocks: each chunk of queries meets each block once, on a grid of cells (see grid), whose bytes grow with the
square root of the cells; a task keeps the best k of each query over all blocks of its cell.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; every other vector does, and sums
are as wide as they need be. A quantised component or a resulting score that doesn't fit a long is an error, never a row left out; shorter vectors count as filled with zeros up to the longest; a row never answers a query
with its own id; repeated rows are rows of their own, as candidates and as queries, each with its own ranks; fewer than k candidates give fewer results; null ids take no part; an empty table, of rows or of queries,
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .common import sliced, stash

#: Rows of a block (a bitmap is then 2 KB) and queries of a chunk.
BLOCK_ROWS, CHUNK = 16_384, 1_024
#: Sums that a long need not hold are compared in three parts of so many bits.
PART = 60


def quantised(df: DataFrame, ident: str, vector: str, scale: int = 256, more: tuple[str, ...] = ()) -> DataFrame:
    """_id, q (array of long) and more columns; rows that take no part are left out."""
    wide = F.raise_error(F.lit("top_k: a quantised component doesn't fit a long"))
    x = F.transform(F.col(vector), lambda v: F.when(F.abs(v.cast("double") * scale) < 2.0**63, F.floor(v.cast("double") * scale)).otherwise(wide.cast("long")))
    good = F.forall(F.col(vector), lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))  # NaN is above all
    return df.select(F.col(ident).cast("long").alias("_id"), F.when(good & (F.size(vector) > 0), x).alias("q"), *more).where("_id is not null and q is not null")


def slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """(dims, bits, words) of bitmaps for unsigned values (rows, dims), and how many bits."""
    rows, dims = values.shape
    bits = max(1, int(values.max(initial=0)).bit_length())
    out = np.zeros((dims, bits, (rows + 63) // 64), np.uint64)
    for b in range(bits):
        packed = np.packbits((values >> np.uint64(b) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        wide = np.zeros((dims, out.shape[2] * 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        out[:, b] = wide.view(np.uint64)
    return out, bits


def add_all(columns: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Slices of the sum, least significant first, of bitmaps given by their weight: three of a weight become one of it and one of the next."""
    out, p = [], 0
    while columns:
        m = columns.pop(p, None)
        carries = []
        while m is not None and len(m) > 1:
            n = len(m) // 3 * 3
            if n:
                a, b, c = m[0:n:3], m[1:n:3], m[2:n:3]
                x = a ^ b
                carries.append((a & b) | (c & x))
                m = np.concatenate([x ^ c, m[n:]])
            else:
                carries.append((m[0] & m[1])[None])
                m = (m[0] ^ m[1])[None]
        out.append(m[0] if m is not None and len(m) else None)
        if carries:
            columns[p + 1] = np.concatenate([*([columns[p + 1]] if p + 1 in columns else []), *carries])
        p += 1
    return out


def unpack(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(score: list[np.ndarray | None], k: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the k highest scores among the alive rows (rows are in the order in which ties are broken), and their scores."""
    sure, open_ = np.zeros_like(alive), alive.copy()
    have = 0
    for s in reversed(score):
        if s is None:
            continue
        ones = open_ & s
        n = int(np.bitwise_count(ones).sum())
        if have + n > k:
            open_ = ones
        else:
            sure |= ones
            have += n
            open_ &= ~s
            if have == k:
                break
    picked = np.concatenate([unpack(sure), unpack(open_)[: k - have]])  # the boundary's rows are equal
    word, bit = picked // 64, (picked % 64).astype(np.uint64)
    kind = np.int64 if len(score) < 63 else object  # Python's integers where a long need not hold the sum
    value = np.zeros(len(picked), kind)
    for p, s in enumerate(score):
        if s is not None:
            value += (s[word] >> bit & np.uint64(1)).astype(np.int64).astype(kind) << p
    return picked, value


def search_block(ids: np.ndarray, index: np.ndarray, bits: int, offset: int, queries: list[tuple[int, np.ndarray]], k: int):
    """(query, ids, scores) of a block's best k rows for each query; ids are sorted."""
    dims, _, words = index.shape
    full = np.zeros(words * 8, np.uint8)
    packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
    full[: len(packed)] = packed
    full = full.view(np.uint64)
    flipped = ~index
    most = (1 << bits) - 1
    for qid, q in queries:
        q = q[:dims]
        size = np.abs(q)
        # sum q*x = sum |q|*(u or most-u) - [most*|q| where q < 0] - offset*sum q, with u = x + offset
        shift = -sum(size[q < 0].tolist()) * most - offset * sum(q.tolist())
        parts: dict[int, list[np.ndarray]] = {}
        for sign, source in ((1, index), (-1, flipped)):
            w = np.where(np.sign(q) == sign, size, 0)
            for j in range(int(w.max(initial=0)).bit_length()):
                dim = np.flatnonzero(w >> j & 1)
                if dim.size:
                    for b in range(bits):
                        parts.setdefault(j + b, []).append(source[dim, b])
        score = add_all({p: np.concatenate(m) for p, m in parts.items()})
        own = np.flatnonzero(ids == qid)
        alive = full
        if own.size:
            alive = full.copy()
            for r in own.tolist():
                alive[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        rows, value = top_rows(score, k, alive)
        yield qid, ids[rows], [x + shift for x in value.tolist()]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, ident: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), the candidate's id as `ident`, score."""
    import pyarrow as pa

    spark = rows.sparkSession
    q = quantised(rows, ident, vector, scale)

    def build(batches):
        left_ids, left_q = [], []

        def block():
            ids = np.array(left_ids, np.int64)
            order = np.argsort(ids, kind="stable")
            dims = max(map(len, left_q))
            v = np.zeros((len(ids), dims), np.int64)
            for i, x in enumerate(left_q):
                v[i, : len(x)] = x
            v = v[order]
            low = min(0, int(v.min()))
            index, bits = slices(v.view(np.uint64) - np.array(low, np.int64).view(np.uint64))
            left_ids.clear()
            left_q.clear()
            return pa.RecordBatch.from_pydict({"ids": [ids[order].tobytes()], "dims": [dims], "bits": [bits], "low": [low], "slices": [index.tobytes()]}, schema=shape)

        shape = pa.schema([("ids", pa.binary()), ("dims", pa.int32()), ("bits", pa.int32()), ("low", pa.int64()), ("slices", pa.binary())])
        for b in sliced(batches):
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                left_ids.append(i)
                left_q.append(x)
                if len(left_ids) == BLOCK_ROWS:
                    yield block()
        if left_ids:
            yield block()

    tasks = spark.sparkContext.defaultParallelism
    index = stash(q.coalesce(max(tasks, rows.count() // BLOCK_ROWS)).mapInArrow(build, "ids binary, dims int, bits int, low long, slices binary").withColumn("block", F.monotonically_increasing_id()), "bitslices")
    # Rows are numbered, so repeated queries are told apart. A chunk has CHUNK queries, or fewer where few blocks would leave cores idle.
    asked = stash(quantised(queries, ident, vector, scale).withColumn("_row", F.monotonically_increasing_id()), "asked")
    n, (blocks, dims) = asked.count(), index.agg(F.count(F.lit(1)), F.coalesce(F.max("dims"), F.lit(1))).first()
    each = max(1, min(CHUNK, n * blocks // (4 * tasks)))

    def group(batches):
        ids, places, vectors = [], [], []

        def chunk():
            v = np.zeros((len(ids), max(map(len, vectors))), np.int64)
            for i, x in enumerate(vectors):
                v[i, : len(x)] = x
            return pa.RecordBatch.from_pydict({"asked": [np.array(ids, np.int64).tobytes()], "places": [np.array(places, np.int64).tobytes()], "vectors": [v.tobytes()]})

        for b in sliced(batches):
            for i, place, x in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i)
                places.append(place)
                vectors.append(x)
                if len(ids) == each:
                    yield chunk()
                    ids, places, vectors = [], [], []
        if ids:
            yield chunk()

    chunks = asked.select("_id", "_row", "q").coalesce(max(1, n // each)).mapInArrow(group, "asked binary, places binary, vectors binary").withColumn("chunk", F.monotonically_increasing_id())
    pairs = grid.pairs(index, stash(chunks, "queries"), BLOCK_ROWS * dims, 8 * each * dims)

    def search(batches):
        names = ["query_id", "row", "id", "score", "high", "mid", "least"]
        for _, met in grid.cells(batches):
            best: dict[int, tuple[int, list[tuple[int, int]]]] = {}
            for r in met:
                ids = np.frombuffer(r["ids"], np.int64)
                slc = np.frombuffer(r["slices"], np.uint64).reshape(r["dims"], r["bits"], -1)
                wanted, places = np.frombuffer(r["asked"], np.int64), np.frombuffer(r["places"], np.int64)
                vectors = np.frombuffer(r["vectors"], np.int64).reshape(len(wanted), -1)
                for place, (qid, found, score) in zip(places.tolist(), search_block(ids, slc, r["bits"], -r["low"], list(zip(wanted.tolist(), vectors)), k)):
                    have = best[place][1] if place in best else []
                    best[place] = qid, sorted(have + list(zip(found.tolist(), score)), key=lambda x: (-x[1], x[0]))[:k]
            out = {x: [] for x in names}
            for place, (qid, found) in best.items():
                for i, x in found:
                    cells = (qid, place, i, x if -(1 << 63) <= x < 1 << 63 else None, x >> 2 * PART, x >> PART & (1 << PART) - 1, x & (1 << PART) - 1)
                    for name, value in zip(names, cells):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(x, pa.int64()) for x in names]))

    near = pairs.select("cell", "ids", "dims", "bits", "low", "slices", "asked", "places", "vectors").mapInArrow(search, "query_id long, row long, id long, score long, high long, mid long, least long")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.col("high").desc(), F.col("mid").desc(), F.col("least").desc(), F.col("id")))
    score = F.coalesce("score", F.raise_error(F.lit("top_k: a score doesn't fit a long")).cast("long"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(ident), score.alias("score"))
