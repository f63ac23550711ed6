"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

1. Signatures: the set of word shingles of each whole text (64-bit hashes), its size, its digest, a few min-hashes. Texts with
   equal sets are one representative from here on.
2. Star links: of the documents with a common min-hash the pivot is the one whose min-hashes are the most common, which is near the middle
   of a group of near copies; equals are told apart at random for each of the HASHES functions, so a group has a few pivots. Each document is compared by bitmaps (see step 4)
   with its pivots that share SHARED min-hashes with it, and then on the texts with the one whose bitmap is nearest; pairs that
   reach the threshold are links. Where many documents of a large group are left without a link, further rounds take further pivots as long as
   they link a good share of what they ask. This puts groups of near copies together in a number of comparisons linear in
   their size. It finds links early and decides nothing: step 3 misses none.
3. Adaptive multi-match prefixes: a document's shingles are ordered from rare to frequent. Frequency is the number of components
   of step 2, not of documents, counted over all texts in a table whose size goes with the number of shingles. Two sets that
   share at least `a` shingles share at least l of them within the first n - a + l of either. Each document picks the l
   (and so the length of its prefix, with the `a` of the smallest partner it can have) for which its prefix and the estimated candidates cost least.
   Shingles go, packed, to buckets; there two documents count as sharing a shingle only where its places fit the `a` that their two sizes ask for, and the components
   of step 2 are counted, once for each pair of components, so copies never make pairs among themselves. A shingle held by
   very many components is dealt over several buckets. Pairs of components that share enough shingles are candidates.
4. Pairs of documents are compared by bitmaps first: bit i of a document's bitmap is the parity of its shingles that fall on i. Each shingle that only one of two
   sets has changes one bit, so sets whose bitmaps differ in more bits than the threshold leaves room for are no link. What
   remains is verified exactly on the texts: blocks of members of one component against the members of the others.
5. Components of all links.

Order only affects cost. Nothing is capped.

Defined results: null and empty texts and texts without words have no shingle, size 0, and are a component of their own; texts of
fewer words than the shingle's length are one shingle; repeated rows (same id and text) are one node; a null id takes no part and
has a null component; an empty table gives an empty result; extra columns, whatever their names, are ignored by components_of() and
carried along by keep_first().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, expand, forget, join_groups, partitions, sliced, small, squeeze, stash
from .components import components
from .shingle import shingle_sets

#: The threshold as a percentage (shingles are of shingle.WORDS words).
PERCENT = 80
#: Min-hashes of a document, and how many a pair must share to be compared in step 2 (missed links are found in step 3).
HASHES, SHARED = 8, 3
#: Further rounds of step 2: open documents that a min-hash must have, and the share of what a round asks that it must link for another one.
HOT_GROUP, WORTH = 50, 0.125
#: The largest l; cost of a row in a bucket and of a candidate against a shingle that is sent; weight of a shingle at a place where only smaller partners count.
LONGEST, ROW_COST, PAIR_COST, BEHIND = 8, 1.0, 4.0, 0.25
#: Least and most counters of the frequency table (a power of 2; one byte each), shingles for each, and counters of one row of partial counts.
LEAST_LOG, MOST_LOG, PER_SLOT, CHUNK = 16, 24, 16, 1 << 16
#: Shingles that a task holds before it hands its counts or its packed prefixes on; shingles of a bucket; components with one shingle in one bucket.
FLUSH, BUCKET, HOT_SHINGLE = 1_000_000, 800_000, 50_000
#: Shingles of a block of the base in verification; least documents of a block of queries.
BASE_SHINGLES, QUERY_BLOCK = 500_000, 200
#: Bits of a bitmap for each shingle at least.
BITS = 4
#: The filter of ids: bits for each id; at most so many words of 64 bits (a broadcast of some 60 MB).
FILTER_BITS, FILTER_WORDS = 16, 1 << 20

_MORE = np.uint64(0x94D049BB133111EB)
_SEEDS = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1) | 1) % (1 << 64) for i in range(HASHES)], np.uint64)
#: Codes of the frequency table stand for about these counts: eight steps for each doubling.
_COUNTS = np.append(0, np.exp2(np.arange(255) / 8))


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares at least with any set that it links to."""
    return -(-percent * n // 100)


def slot(s: np.ndarray, log: int) -> np.ndarray:
    """The counter of each shingle in a table of 2 ** log."""
    return (s >> np.uint64(64 - log)).astype(np.int64)


def prefix(s: np.ndarray, codes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles of the adaptive prefix, their codes, and its l. codes: the frequency table."""
    n = len(s)
    code = codes[slot(s, len(codes).bit_length() - 1)]
    need = least_shared(n, percent)
    first = n - need + 1
    if not code.any():
        return s[:first], code[:first], 1
    order = np.argsort(code, kind="stable")
    s, code = s[order], code[order]
    ells = np.arange(1, min(LONGEST, need) + 1)
    partners = np.append(0.0, np.cumsum(_COUNTS[code[: first + len(ells) - 1]]))
    equal = n - -(-2 * percent * n // (100 + percent))  # beyond this place (plus l) only smaller partners count
    near, all_ = partners[equal + ells], partners[first - 1 + ells]
    rows = near + BEHIND * (all_ - near)
    ell = int(np.argmin(first + ells + ROW_COST * rows + PAIR_COST * rows / ells)) + 1
    return s[: first + ell - 1], code[: first + ell - 1], ell


def signatures(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """doc, n, digest, hashes, bits for each row."""
    import pyarrow as pa

    shape = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("hashes", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches):
        from xxhash import xxh3_128_digest

        forget()
        for b in sliced(batches):
            out = {"doc": b.column(0), "n": [], "digest": [], "hashes": [], "bits": []}
            for s in shingle_sets(b.column(1).to_pylist()):
                out["n"].append(len(s))
                out["digest"].append(xxh3_128_digest(s.tobytes()))
                out["hashes"].append((s * _SEEDS[:, None]).min(axis=1).view(np.int64) if len(s) else None)
                out["bits"].append(bitmap(s))
            yield pa.RecordBatch.from_pydict(out, schema=shape)

    src = docs.select(F.col(ident).cast("long"), F.col(text).cast("binary"))
    return stash(src.mapInArrow(run, "doc long, n long, digest binary, hashes array<long>, bits binary"), "signatures")


def bitmap(s: np.ndarray) -> bytes:
    """The parities of a set, on a power of 2 of at least BITS bits for each shingle."""
    bits = 1 << max(6, (BITS * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def room(a: bytes, b: bytes, n: int, m: int) -> int | None:
    """In how many bits these bitmaps of sets of n and m shingles differ; None where the sets can't reach the threshold."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):  # the larger one is folded
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    return differ if differ <= n + m - 2 * -(-PERCENT * (n + m) // (100 + PERCENT)) else None


def near(sig: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents whose bitmaps leave room for a link, and in how many bits they differ. pairs: a written table."""
    import pyarrow as pa

    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    asked = maybe(sig.where("doc is not null").select("doc", "n", "bits"), id_filter(ends)).where("_maybe").drop("_maybe")
    side = lambda x: asked.select(F.col("doc").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits" + x))
    both = small(pairs).join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches):
        forget()
        for b in sliced(batches):
            differ = pa.array([room(x, y, n, m) for n, m, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)))], pa.int64())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), differ], ["a", "b", "differ"])
            yield out.filter(differ.is_valid())

    return both.mapInArrow(run, "a long, b long, differ long")


def table_log(shingles: int) -> int:
    """The frequency table's size for so many shingles, as a power of 2."""
    return min(MOST_LOG, max(LEAST_LOG, (shingles // PER_SLOT).bit_length()))


def frequencies(docs: DataFrame, ident: str, text: str, known: DataFrame, shingles: int) -> np.ndarray:
    """A code for each counter of the frequency table: in how many components its shingles occur, less the median of all counters.

    Of a component, its document with the smallest id counts (the filters of ids let some others through; the order only
    affects cost). Tasks give counts of CHUNK counters, as pairs where few aren't 0; they are summed on the executors, and
    the driver gets one byte for each counter.
    """
    import pyarrow as pa

    log = table_log(shingles)
    slots = 1 << log
    src = docs.select(F.col(ident).cast("long").alias("doc"), F.col(text).cast("binary").alias("t")).where("doc is not null and t is not null")
    src = maybe(maybe(src, id_filter(known)).withColumnRenamed("_maybe", "_known"), id_filter(known.where("doc = component")))
    shape = pa.schema([("chunk", pa.int32()), ("at", pa.binary()), ("times", pa.binary())])

    def count(batches):
        total, held, size = np.zeros(slots, np.uint32), [], 0

        def add_held():
            at, times = np.unique(np.concatenate(held), return_counts=True)
            total[at] += times.astype(np.uint32)

        for b in sliced(batches):
            for s in shingle_sets(b.column(0).to_pylist()):
                held.append(slot(s, log))
                size += len(s)
                if size > FLUSH:
                    add_held()
                    held, size = [], 0
        if held:
            add_held()
        for k in range(0, slots, CHUNK):
            part = total[k : k + CHUNK]
            at = np.flatnonzero(part)
            if not len(at):
                continue
            if few := len(at) < CHUNK // 4:
                part = part[at]
            yield pa.RecordBatch.from_pydict({"chunk": [k // CHUNK], "at": [squeeze(at.astype(np.uint16)) if few else None], "times": [squeeze(part)]}, schema=shape)

    def add(batches):
        total = {}
        for b in sliced(batches):
            for k, at, times in zip(*(x.to_pylist() for x in b.columns)):
                x = total.setdefault(k, np.zeros(CHUNK, np.int64))
                x[slice(None) if at is None else expand(at, np.uint16)] += expand(times, np.uint32)
        for k, x in total.items():
            code = np.where(x > 0, np.minimum(np.round(1 + 8 * np.log2(np.maximum(x, 1))), 255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": [k], "code": [code.tobytes()]}, schema=pa.schema([("chunk", pa.int32()), ("code", pa.binary())]))

    parts = src.where("not _known or _maybe").select("t").mapInArrow(count, "chunk int, at binary, times binary").repartition("chunk")
    codes = np.zeros(slots, np.uint8)
    for k, code in zip(*(x.to_pylist() for x in parts.mapInArrow(add, "chunk int, code binary").toArrow().columns)):
        codes[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(code, np.uint8)
    # Codes less the median count: by a table of 256 entries.
    usual = _COUNTS[int(np.median(codes))]
    rest = np.maximum(_COUNTS - usual, 0)
    return np.where(rest >= 1, np.minimum(1 + 8 * np.log2(np.maximum(rest, 1)), 255), 0).astype(np.uint8)[codes]


def id_filter(ids: DataFrame) -> tuple[DataFrame, int]:
    """A Bloom filter of the ids in `doc` as a table of words, and how many words it has. It has FILTER_BITS bits for each id, but at most FILTER_WORDS words; beyond that it lets more through."""
    words = min(FILTER_WORDS, 1 << max(4, (ids.count() * FILTER_BITS // 64).bit_length()))
    word, bit = _place("doc", words)
    return ids.select(F.expr(word).alias("_w"), F.expr(f"shiftleft(1L, {bit})").alias("_x")).groupBy("_w").agg(F.bit_or("_x").alias("_bits")), words


def _place(ident: str, words: int) -> tuple[str, str]:
    return f"cast(pmod(xxhash64({ident}), {words}) as int)", f"cast(pmod(shiftrightunsigned(xxhash64({ident}), 32), 64) as int)"


def maybe(docs: DataFrame, bits: tuple[DataFrame, int]) -> DataFrame:
    """docs with a column _maybe: false where the id in `doc` is surely not in the filter. The filter's size is bounded, so it is broadcast."""
    word, bit = _place("doc", bits[1])
    joined = docs.withColumn("_w", F.expr(word)).join(F.broadcast(bits[0]), "_w", "left")
    return joined.withColumn("_maybe", F.coalesce(F.expr(f"getbit(_bits, {bit}) = 1"), F.lit(False))).drop("_w", "_bits")


def verify(docs: DataFrame, ident: str, text: str, asked: DataFrame) -> DataFrame:
    """Links (a, b). asked: key, role (0: base, 1: query), doc. Every query of a key is compared with all its bases; a link to one of them is given (all bases of a key are one component)."""
    import pyarrow as pa

    asked = stash(asked, "asked")
    src = docs.select(F.col(ident).cast("long").alias("doc"), F.col(text).cast("binary").alias("t"))
    src = maybe(src, id_filter(asked)).where("_maybe").drop("_maybe")
    rows = src.join(small(asked), "doc").select("key", "role", "doc", "t").repartition("key").sortWithinPartitions("key", "role")

    def run(batches):
        key, base, index = None, [], None
        for b in sliced(batches):
            a, q = [], []
            *cols, texts = (x.to_pylist() for x in b.columns)
            for k, role, doc, s in zip(*cols, shingle_sets(texts)):
                if k != key:
                    key, base, index = k, [], None
                if role == 0:
                    base.append((doc, s.copy()))
                    continue
                if not base or not len(s):
                    continue
                if index is None:
                    flat = np.concatenate([x for _, x in base])
                    owner = np.repeat(np.arange(len(base)), [len(x) for _, x in base])
                    if len(base) > 1:
                        order = np.argsort(flat, kind="stable")
                        flat, owner = flat[order], owner[order]
                    index = flat, owner, np.array([len(x) for _, x in base])
                flat, owner, sizes = index
                lo = np.searchsorted(flat, s)
                if len(base) == 1:
                    lo[lo == len(flat)] = 0
                    common = np.array([np.count_nonzero(flat[lo] == s)])
                else:
                    n = np.searchsorted(flat, s, side="right") - lo
                    lo, n = lo[n > 0], n[n > 0]
                    at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                    common = np.bincount(owner[at], minlength=len(base))
                hit = np.flatnonzero(100 * common >= PERCENT * (sizes + len(s) - common))
                hit = [base[h][0] for h in hit.tolist() if base[h][0] != doc]
                if hit:
                    a.append(hit[0])
                    q.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(q, pa.int64())], ["a", "b"])

    links = stash(rows.mapInArrow(run, "a long, b long"), "verified")
    drop(asked)
    return links


def star_links(docs: DataFrame, ident: str, text: str, sig: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified links of representatives with pivots among those that share min-hashes with them."""
    each = reps.select("doc", "n", F.posexplode("hashes").alias("j", "h"))
    sizes = stash(each.groupBy("j", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("size", F.col("c")), "sizes")
    crowd = join_groups(each, sizes, ["j", "h"]).where("size is not null")
    crowd = stash(crowd.groupBy("doc").agg(F.first("n").alias("n"), F.sum("size").alias("popular"), F.collect_list(F.struct("j", "h", "size")).alias("at")), "crowd")
    shares = F.transform("at", lambda x: F.xxhash64(x["j"], x["h"]))
    links, used, asking = [], None, crowd
    while True:
        free = crowd if used is None else crowd.join(used, "doc", "left_anti")
        place = lambda t, *cols: t.select("doc", "n", *cols, F.explode("at").alias("_")).select("doc", "n", *cols, "_.*")
        best = F.max(F.struct("popular", F.xxhash64("doc", "j").alias("draw"), "doc", "n", "keys")).alias("p")
        pivots = place(free.withColumn("keys", shares), "popular", "keys").groupBy("j", "h").agg(best, F.max("size").alias("c"))
        pivots = pivots.select("j", "h", F.col("p.doc").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.keys").alias("other"), "c")
        if used is not None:
            pivots = pivots.join(place(asking).groupBy("j", "h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= HOT_GROUP).select("j", "h"), ["j", "h"], "left_semi")
        pivots = stash(pivots, "pivots")
        pairs = join_groups(place(asking.withColumn("keys", shares), "keys"), pivots, ["j", "h"]).where("pivot <> doc").where(f"100 * least(n, pn) >= {PERCENT} * greatest(n, pn)")
        pairs = pairs.where(F.size(F.array_intersect("keys", "other")) >= SHARED)
        told = stash(pairs.select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct(), "star")
        asked = told.select("a").distinct().count()
        if not asked:
            break
        nearest = F.min(F.struct("differ", "b")).alias("p")
        pairs = stash(near(sig, told).groupBy("a").agg(nearest).select(F.col("a").alias("doc"), F.col("p.b").alias("pivot")), "near")
        blocks = stash(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")).select("pivot", "c", F.ceil(F.col("c") / QUERY_BLOCK).cast("int").alias("blocks")), "blocks")
        key = lambda block: F.struct(F.col("pivot").alias("base"), F.lit(0).alias("part"), block.alias("block"))
        large = blocks.where("blocks > 1")
        queries = join_groups(pairs, large, ["pivot"]).select(key(F.pmod(F.xxhash64("doc", F.lit(2)), F.coalesce("blocks", F.lit(1))).cast("int")).alias("key"), F.lit(1).alias("role"), "doc")
        bases = blocks.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(key(F.col("block")).alias("key"), F.lit(0).alias("role"), F.col("pivot").alias("doc"))
        links.append(verify(docs, ident, text, bases.unionByName(queries)))
        drop(pivots, blocks, pairs)
        if links[-1].count() < WORTH * asked:
            break
        # Another round asks the documents without a link, where many of them share a min-hash.
        linked = links[-1].select(F.explode(F.array("a", "b")).alias("doc"))
        asking = stash(asking.join(linked, "doc", "left_anti"), "open")
        new = told.select(F.col("b").alias("doc"))
        used = stash((new if used is None else used.unionByName(new)).distinct(), "used")
        if place(asking).groupBy("j", "h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= HOT_GROUP).isEmpty():
            break
    out = crowd.where("false").select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    for x in links:
        out = out.unionByName(x)
    return out


def candidate_pairs(docs: DataFrame, ident: str, text: str, known: DataFrame, codes: np.ndarray, total: int) -> DataFrame:
    """(a, b): pairs of components whose members share enough prefix shingles. known: doc, component, rep of all documents that are not alone."""
    import pyarrow as pa

    spark = docs.sparkSession
    src = docs.select(F.col(ident).cast("long").alias("doc"), F.col(text).cast("binary").alias("t")).where("doc is not null and t is not null")

    def shorten(batches):
        for b in sliced(batches):
            out = {"doc": [], "n": [], "ell": [], "s": [], "code": [], "maybe": []}
            for doc, m, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(1).to_pylist())):
                if len(s):
                    p, code, ell = prefix(s, codes)
                    for k, x in zip(out, (doc, len(s), ell, p.tobytes(), code.tobytes(), m)):
                        out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("ell", pa.int32()), ("s", pa.binary()), ("code", pa.binary()), ("maybe", pa.bool_())]))

    # Only prefixes are shuffled to find their components, and only of documents that aren't surely alone.
    short = stash(maybe(src, id_filter(known)).select("doc", "t", "_maybe").mapInArrow(shorten, "doc long, n int, ell int, s binary, code binary, maybe boolean"), "prefixes")
    cols = ["component", "n", "ell", "s", "code"]
    alone = short.where("not maybe").select(F.col("doc").alias("component"), *cols[1:])
    others = short.where("maybe").join(small(known), "doc", "left").where("rep is null or rep").select(F.coalesce("component", "doc").alias("component"), *cols[1:])
    buckets = max(partitions(spark), total // 4 // BUCKET + 1)
    kinds = {"s": np.uint32, "component": np.int64, "n": np.int32, "rest": np.int32, "ell": np.uint8}
    shape = pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in kinds)])

    def pack(batches):
        held, size = [], 0

        def out():
            comp, n, ell = (np.array([x[i] for x in held], np.int64) for i in range(3))
            s, code = (np.frombuffer(b"".join([x[i] for x in held]), k) for i, k in ((3, np.uint64), (4, np.uint8)))
            lengths = np.fromiter((len(x[4]) for x in held), np.int64, len(held))
            owner = np.repeat(np.arange(len(held)), lengths)
            place = np.arange(len(s)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            s, owner, rest, home = spread(s, code, comp[owner], n[owner], ell[owner], n[owner] - 1 - place, owner)
            b = (s % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, b))
            b = b[order]
            cells = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            own = owner[order]
            cols = {"s": s[order] >> np.uint64(32), "component": comp[own], "n": n[own], "rest": 2 * rest[order] + home[order], "ell": ell[own]}
            cols = {k: x.astype(kinds[k]) for k, x in cols.items()}
            ends = np.append(cells[1:], len(b))
            for i in range(0, len(cells), 256):
                part = list(zip(cells[i : i + 256].tolist(), ends[i : i + 256].tolist()))
                yield pa.RecordBatch.from_pydict({"bucket": b[cells[i : i + 256]]} | {k: [squeeze(x[lo:hi]) for lo, hi in part] for k, x in cols.items()}, schema=shape)

        for batch in sliced(batches):
            for x in zip(*(x.to_pylist() for x in batch.columns)):
                held.append(x)
                size += len(x[4])
                if size > FLUSH:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    packed = alone.unionByName(others).mapInArrow(pack, "bucket long, " + ", ".join(f"{k} binary" for k in kinds))

    def count(batch):
        s, comp, n, rest, ell = (np.concatenate([expand(x, kind) for x in batch.column(k).to_pylist()]) for k, kind in kinds.items())
        a, b, need, c = pairs_of(s, comp, n.astype(np.int64), rest.astype(np.int64) // 2, ell.astype(np.int64), rest % 2 == 1)
        return pa.table({"a": a, "b": b, "need": need.astype(np.int32), "c": c}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32()), ("c", pa.int64())]))

    found = packed.groupBy("bucket").applyInArrow(count, "a long, b long, need int, c long")
    pairs = stash(found.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need")).where("c >= need").select("a", "b"), "candidates")
    drop(short)
    return pairs


def spread(s: np.ndarray, code: np.ndarray, comp: np.ndarray, n: np.ndarray, ell: np.ndarray, rest: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """s, owner, rest and home of the rows that go to the buckets.

    A shingle held by more than HOT_SHINGLE components is cut into several, by the component. A row is at home in one of
    them; where it can be the smaller side of a pair it also visits the others. A pair counts where its larger side is at home.
    """
    many = np.ceil(_COUNTS[code] / HOT_SHINGLE).astype(np.int64)
    home = np.ones(len(s), bool)
    hot = np.flatnonzero(many > 1)
    if not len(hot):
        return s, owner, rest, home
    share = ((comp[hot].astype(np.uint64) * _MORE >> np.uint64(33)) % many[hot].astype(np.uint64)).astype(np.int64)
    visits = np.where(strong(n[hot], rest[hot], ell[hot]), many[hot], 1)
    at = np.repeat(np.arange(len(hot)), visits)
    part = np.arange(len(at)) - np.repeat(np.cumsum(visits) - visits, visits)
    part = np.where(visits[at] > 1, part, share[at])
    cold = many <= 1
    cut = (s[hot[at]] + part.astype(np.uint64)) * _MORE  # another shingle for each part
    join = lambda x: np.concatenate([x[cold], x[hot[at]]])
    return np.concatenate([s[cold], cut]), join(owner), join(rest), np.concatenate([home[cold], part == share[at]])


def strong(n: np.ndarray, rest: np.ndarray, ell: np.ndarray) -> np.ndarray:
    """Whether the shingle counts with partners of at least the same size. rest: how many of the n shingles come after it."""
    return (100 + PERCENT) * (rest + ell) >= 2 * PERCENT * n


def pairs_of(s: np.ndarray, comp: np.ndarray, n: np.ndarray, rest: np.ndarray, ell: np.ndarray, home: np.ndarray, most: int = 1_000_000):
    """Pairs of components (a < b) that share shingles: a, b, the least l of the two, how many shingles.

    Rows of one shingle, component and size are one point. Points of a shingle are ordered by size, and each that is strong meets
    the larger ones up to the largest possible partner; the two count where the shingle's places fit their sizes.
    """
    none = np.zeros(0, np.int64)
    if not len(s):
        return none, none, none, none
    order = np.lexsort((comp, n, s))
    s, comp, n, rest, ell, home = (x[order] for x in (s, comp, n, rest, ell, home))
    first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (comp[1:] != comp[:-1]) | (n[1:] != n[:-1])))
    rest, low, high, home = np.maximum.reduceat(rest, first), np.minimum.reduceat(ell, first), np.maximum.reduceat(ell, first), np.maximum.reduceat(home, first)
    s, comp, n = s[first], comp[first], n[first]
    run = np.cumsum(np.append(True, s[1:] != s[:-1])) - 1
    key = run << 32 | n
    left = np.flatnonzero(strong(n, rest, high))
    ahead = np.searchsorted(key, run[left] << 32 | n[left] * 100 // PERCENT, side="right") - left - 1
    left, ahead = left[ahead > 0], ahead[ahead > 0]
    held: list[tuple] = []

    def reduced(parts):
        a, b, need, c = (np.concatenate(x) for x in zip(*parts))
        o = np.lexsort((b, a))
        a, b, need, c = a[o], b[o], need[o], c[o]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[at], b[at], np.minimum.reduceat(need, at), np.add.reduceat(c, at)

    ends = np.cumsum(ahead)
    i = 0
    while i < len(left):  # so many points on the left that they have about `most` pairs
        k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        x = np.repeat(left[i:k], ahead[i:k])
        y = x + 1 + np.arange(len(x)) - np.repeat(ends[i:k] - ahead[i:k] - (ends[i - 1] if i else 0), ahead[i:k])
        ok = home[y] & (comp[x] != comp[y])
        ok &= (100 + PERCENT) * (np.minimum(rest[x], rest[y]) + np.minimum(high[x], high[y])) >= PERCENT * (n[x] + n[y])
        x, y = x[ok], y[ok]
        i = k
        if not len(x):
            continue
        a, b, r, need = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y]), run[x], np.minimum(low[x], low[y])
        o = np.lexsort((r, b, a))
        a, b, r, need = a[o], b[o], r[o], need[o]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (r[1:] != r[:-1]))  # points of one pair of components count once for a shingle
        held.append(reduced([(a, b, need, new.astype(np.int64))]))
        if sum(len(h[0]) for h in held[1:]) > most:
            held = [reduced(held)]
    return reduced(held) if held else (none, none, none, none)


def cross_links(docs: DataFrame, ident: str, text: str, sig: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Verified links between the components of each pair. members: doc, n, component of all representatives in components of several."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    side = lambda x: sizes.select(F.col("component").alias(x), F.col("size").alias("s" + x), F.col("shingles").alias("n" + x))
    sized = stash(pairs.join(side("a"), "a", "left").join(side("b"), "b", "left"), "sized")
    # Components of one document each are compared by bitmaps first.
    single = F.coalesce("sa", "sb").isNull()
    alone = near(sig, stash(sized.where(single).select("a", "b"), "single")).select("a", "b").distinct()
    sized = sized.where(~single).unionByName(alone, allowMissingColumns=True)
    sa, sb = F.coalesce("sa", F.lit(1)), F.coalesce("sb", F.lit(1))
    pick = lambda x, y: F.when(sb > sa, y).otherwise(x)
    sized = stash(sized.select(pick(F.col("a"), F.col("b")).alias("base"), pick(F.col("b"), F.col("a")).alias("other"), F.greatest(sa, sb).alias("bs"), F.least(sa, sb).alias("os"), F.coalesce(pick(F.col("na"), F.col("nb")), F.lit(1)).alias("bn")), "pairs")
    plan = sized.groupBy("base").agg(F.max("bs").alias("bs"), F.max("bn").alias("bn"), F.sum("os").alias("qs"))
    parts = F.ceil(F.col("bn") / BASE_SHINGLES).cast("int")
    plan = plan.select("base", "bs", "qs", parts.alias("parts")).select("base", "parts", F.ceil(F.col("qs") / F.greatest(F.lit(QUERY_BLOCK), F.col("bs") / F.col("parts"))).cast("int").alias("blocks"))
    grouped = members.select(F.col("component").alias("base"), "doc")
    own = plan.join(grouped, "base", "left").withColumn("doc", F.coalesce("doc", "base"))
    key = lambda part, block: F.struct("base", part.alias("part"), block.alias("block"))
    part = F.pmod(F.xxhash64("doc", F.lit(3)), F.col("parts")).cast("int")
    bases = own.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(key(part, F.col("block")).alias("key"), F.lit(0).alias("role"), "doc")
    asking = sized.select("base", "other").join(members.select(F.col("component").alias("other"), "doc"), "other", "left").select("base", F.coalesce("doc", "other").alias("doc"))
    block = F.pmod(F.xxhash64("doc", F.lit(2)), F.col("blocks")).cast("int")
    queries = asking.join(plan, "base").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(key(F.col("part"), block).alias("key"), F.lit(1).alias("role"), "doc")
    links = verify(docs, ident, text, bases.unionByName(queries))
    drop(sized)
    return links


def components_of(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n, component for each row of docs."""
    sig = signatures(docs, ident, text)
    some = sig.where("doc is not null and n > 0")
    copies = stash(some.groupBy("digest", "n").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "copies")
    ids = stash(join_groups(sig.drop("bits"), copies, ["digest", "n"]).select("doc", "n", "hashes", F.coalesce("first", "doc").alias("first"), F.col("first").isNotNull().alias("copied")), "ids")
    drop(copies)
    reps = stash(ids.where("doc = first and n > 0").select("doc", "n", "hashes"), "reps")
    stars = star_links(docs, ident, text, sig, reps)
    early = components(stars)
    # Documents that are copies or in a component of several; all others are components of their own.
    members = stash(reps.select("doc", "n").join(small(early.select(F.col("id").alias("doc"), "component")), "doc").distinct(), "members")
    twins = ids.where("copied and n > 0").select("doc", (F.col("doc") == F.col("first")).alias("rep")).dropDuplicates(["doc"])
    known = stash(members.drop("n").join(twins, "doc", "full").select("doc", F.coalesce("component", "doc").alias("component"), F.coalesce("rep", F.lit(True)).alias("rep")), "known")
    total = int(reps.agg(F.sum("n")).first()[0] or 0)
    pairs = candidate_pairs(docs, ident, text, known, frequencies(docs, ident, text, known, total), total)
    more = cross_links(docs, ident, text, sig, pairs, members)
    final = components(stars.unionByName(more)).select(F.col("id").alias("first"), "component")
    drop(sig, reps, members, known, pairs)
    return ids.join(small(final), "first", "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("component", "first")).otherwise(F.col("doc")).alias("component"))


def keep_first(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its component (rows without an id stay)."""
    gone = stash(components_of(docs, ident, text).where("doc <> component").select("doc").distinct(), "gone")
    # The rows are carried in one column, so no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(ident).cast("long").alias("doc"))
    split = maybe(rows, id_filter(gone))
    stay = split.where("not _maybe").select("_row")
    asked = split.where("_maybe").join(gone, "doc", "left_anti").select("_row")
    return stay.unionByName(asked).select("_row.*")
