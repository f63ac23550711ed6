"""Phrase collocation mining in Apriori level-wise passes.

Texts are tokenised once into packed parts: the distinct (language, word) pairs of some 4 MB of text, with hashes, and the words of each piece as numbers of
those pairs. Level k reads the parts with the frequent (k-1)-grams broadcast, and counts a k-gram only where both
(k-1)-grams in it are frequent. Counting goes by 48-bit hashes of k-grams, which Spark sums; grams that share a hash are counted together, so hashes that reach the
least count are a superset. A last pass emits the phrases themselves for those hashes, per part grouped by their words, not by hashes, and Spark sums
them by language and phrase: the level tables are exact. Cuts are scored by joins with the level tables, in decimals of 38 digits.

A broadcast holds MOST_KNOWN hashes at most. Beyond that a level runs in several passes, each for the k-grams whose first (k-1)-gram is in its
share; the second one is then not looked up before counting. The result is the same.

Defined results: a null text counts as empty, a null language as `und`; words keep everything but blanks, tabs and the marks that end a piece; repeated rows count each;
languages without a phrase that reaches the least count give no rows, nor does an empty table; other columns are ignored, whatever their names; a text longer than a part is cut
between two pieces, so very long texts are whole; 1000 * a * n and l * r of more than 38 digits would be an error. Ties in the ranking go by phrase in the order of
UTF-8 bytes, which is unique within a language.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, expand, held as kept, partitions, sliced, small, squeeze, stash
from .shingle import hashes

#: Text bytes of a part; parts that a task reads; hashes and phrases that a task sums before it gives them on.
PART_BYTES, TASK_PARTS, SUMMED_HASHES, SUMMED = 1_000_000, 64, 1_000_000, 400_000
#: Hashes of a broadcast (32 MB); bytes of a level table that is broadcast.
MOST_KNOWN, SMALL_BYTES = 4_000_000, 16_000_000
#: Lowest bits of a hash that counting leaves out, which makes rows of a shuffle smaller: 48 bits are counted.
SHORT = np.uint64(16)
#: Words of the longest phrase.
LONGEST = 5
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Each byte in lower case, and its kind: 0 part of a word, 1 blank, 2 end of a piece."""
    low, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    low[65:91] += 32
    kind[[9, 32]] = 1
    kind[[*b".,;:!?", *range(10, 14)]] = 2
    return low, kind


_LOW, _KIND = _kinds()


def cut(text: bytes, size: int):
    """The text in parts of about `size` bytes, cut between pieces."""
    while len(text) > size and (m := _BREAK.search(text, size)):
        yield text[: m.end()]
        text = text[m.end() :]
    yield text


def pack(texts: list[bytes], langs: list[int]) -> dict[str, np.ndarray | list]:
    """words (bytes), lang (number), hash and count of the distinct (language, word) pairs; codes: the numbers of the words' pairs, -1 between pieces."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" * 9, np.uint8)
    low, kind = _LOW[data], _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    piece = np.cumsum(kind == 2)[starts] if len(starts) else starts
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)  # where each text's separator is
    lang = np.array(langs, np.int64)[np.searchsorted(ends, starts)] if len(starts) else starts
    h = hashes(low, starts, lengths) if len(starts) else np.zeros(0, np.uint64)
    # A language's number is known in this part only; its pairs are told apart by it, and hashed with the language's name by the caller.
    mixed = (h ^ (lang.astype(np.uint64) * _ODD)) * _MIX
    _, first, code = np.unique(mixed, return_index=True, return_inverse=True)
    rep = first[code]
    same = (lengths == lengths[rep]).all() and (lang == lang[rep]).all()
    if same and len(starts):
        begin = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        same = bool((low[np.repeat(starts, lengths) + at] == low[np.repeat(starts[rep], lengths) + at]).all())
    if not same:  # two pairs of one hash: told apart one by one
        number: dict = {}
        all_words = [low[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]
        code = np.array([number.setdefault(x, len(number)) for x in zip(lang.tolist(), all_words)])
        first = np.unique(code, return_index=True)[1]
    words = [low[a : a + n].tobytes() for a, n in zip(starts[first].tolist(), lengths[first].tolist())]
    gap = np.flatnonzero(np.diff(piece)) + 1
    return {"words": words, "lang": lang[first], "hash": h[first], "count": np.bincount(code, minlength=len(first)), "codes": np.insert(code, gap, -1).astype(np.int32)}


PART = "langs array<string>, words binary, lang binary, hash binary, count binary, codes binary, at_langs array<string>, at_words array<bigint>"


def packed(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """A written table of parts; at_langs, at_words: how many words of each language."""
    import pyarrow as pa

    schema = pa.schema({"langs": pa.list_(pa.string()), **{k: pa.binary() for k in ("words", "lang", "hash", "count", "codes")}, "at_langs": pa.list_(pa.string()), "at_words": pa.list_(pa.int64())})

    def run(batches):
        from xxhash import xxh3_64_intdigest

        texts, langs, number, size = [], [], {}, 0

        def part():
            p = pack(texts, langs)
            names = list(number)
            salt = np.array([xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
            h = (p["hash"] ^ salt[p["lang"]]) * _MIX
            h ^= h >> np.uint64(31)
            total = np.bincount(p["lang"], p["count"], minlength=len(names)).astype(np.int64).tolist()
            row = [names, pa.compress(b"\n".join(p["words"]), codec="zstd", asbytes=True), squeeze(p["lang"].astype(np.int32)), squeeze(h.view(np.int64)), squeeze(p["count"].astype(np.int64)), squeeze(p["codes"]), names, total]
            row[1] = sum(map(len, p["words"]), max(0, len(p["words"]) - 1)).to_bytes(8, "little") + row[1]
            for x in (texts, langs, number):
                x.clear()
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(schema.names, row)}, schema=schema)

        for b in sliced(batches):
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in cut(t.encode(), PART_BYTES):
                    texts.append(x)
                    langs.append(number.setdefault(name, len(number)))
                    size += len(x)
                    if size >= PART_BYTES:
                        yield part()
                        size = 0
        if texts:
            yield part()

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return stash(rows.mapInArrow(run, PART), "packed-words")


def in_tasks(parts: DataFrame) -> DataFrame:
    """The parts, about TASK_PARTS in a task, so that each task sums its counts over much text before they are shuffled."""
    return parts.coalesce(max(3 * parts.sparkSession.sparkContext.defaultParallelism, parts.count() // TASK_PARTS))


class Known:
    """A set of shortened hashes: a small table rules most others out, binary search decides."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values.view(np.uint64))
        self.shift = np.uint64(64 - int(SHORT) - int(np.clip(16 * len(values), 1 << 16, 1 << 24) - 1).bit_length())
        self.table = np.zeros(1 << (64 - int(SHORT) - int(self.shift)), bool)
        self.table[self.values >> self.shift] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        h = h >> SHORT
        out = self.table[h >> self.shift]
        some = np.flatnonzero(out)
        if len(self.values):
            at = np.searchsorted(self.values, h[some])
            at[at == len(self.values)] = 0
            out[some] = self.values[at] == h[some]
        return out


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of grams that are one word longer."""
    x = (h * _ODD + word) * _MIX
    return x ^ x >> np.uint64(29)


def gram_hashes(word: np.ndarray, codes: np.ndarray, most: int):
    """For k = 1 to most: the hash of the k-gram that begins at each place, and the places where there is one."""
    h = np.where(codes >= 0, word[codes], np.uint64(0)) if len(word) else np.zeros(len(codes), np.uint64)
    places = np.flatnonzero(codes >= 0)
    full, g = h, h[places]
    yield g, places
    for k in range(2, most + 1):
        fits = places + (k - 1) < len(codes)
        fits[fits] = codes[places[fits] + (k - 1)] >= 0
        places, g = places[fits], g[fits]
        g = longer(g, full[places + (k - 1)])
        yield g, places


def sums(found):
    """(hashes, counts) of pairs of arrays: each hash once, as far as SUMMED_HASHES of them are held at a time."""
    h, n, size = [], [], 0

    def merged():
        flat = np.concatenate(h)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else order
        return flat[starts], np.add.reduceat(np.concatenate(n)[order], starts) if len(starts) else np.zeros(0, np.int64)

    for a, b in found:
        h.append(a)
        n.append(b.astype(np.int64))
        size += len(a)
        if size > 2 * SUMMED_HASHES:
            one = merged()
            h, n, size = [one[0]], [one[1]], len(one[0])
            if size > SUMMED_HASHES:
                yield one
                h, n, size = [], [], 0
    if h:
        yield merged()


def count_level(parts: DataFrame, k: int, frequent: DataFrame | None, least: int) -> DataFrame:
    """h: hashes of k-grams that are seen `least` times or more, as a written table. frequent: those of the level below."""
    import pyarrow as pa

    spark = parts.sparkSession
    out = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def given_on(found):
        for h, n in sums(found):
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], schema=out)

    if k == 1:

        def words(batches):
            yield from given_on((expand(b.column(0)[0].as_py(), np.uint64) >> SHORT, expand(b.column(1)[0].as_py(), np.int64)) for b in sliced(batches, 1))

        counted = parts.select("hash", "count").mapInArrow(words, "h long, n long")
    else:
        counted = None
        of = shares(frequent)
        for share in range(of):
            known = broadcast_share(frequent, share, of)

            def grams(batches, known=known, of=of):
                yield from given_on(counted_grams(batches, known, of))

            def counted_grams(batches, known, of):
                have = kept("known grams", known.id, lambda: Known(known.value))
                for b in sliced(batches, 1):
                    word, codes = expand(b.column(0)[0].as_py(), np.uint64), expand(b.column(1)[0].as_py())
                    *_, (g, at) = gram_hashes(word, codes, k - 1)
                    good = np.zeros(len(codes) + 1, bool)
                    good[at[have.holds(g)]] = True
                    # Where there is but one share both (k-1)-grams are looked up; else the first.
                    last = at[good[at] & good[at + 1]] if of == 1 else at[good[at]]
                    h = np.zeros(len(codes), np.uint64)
                    h[at] = g
                    last = last[last + (k - 1) < len(codes)]
                    last = last[codes[last + (k - 1)] >= 0]
                    yield np.unique(longer(h[last], word[codes[last + (k - 1)]]) >> SHORT if len(last) else np.zeros(0, np.uint64), return_counts=True)

            one = parts.select("hash", "codes").mapInArrow(grams, "h long, n long")
            counted = one if counted is None else counted.unionByName(one)
    # The tasks have summed their hashes, so these are dealt out as they are and summed once more.
    return stash(counted.repartition(partitions(spark), "h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), f"grams-{k}")


def shares(frequent: DataFrame) -> int:
    return max(1, -(-frequent.count() // MOST_KNOWN))


class _Sent:
    """A broadcast set of hashes with a name of its own, by which workers keep what they made of it."""

    def __init__(self, name: str, sent):
        self.id, self.sent = name, sent

    @property
    def value(self) -> np.ndarray:
        return self.sent.value


def broadcast_share(frequent: DataFrame, share: int, of: int) -> _Sent:
    """The hashes of a share, MOST_KNOWN or little more of them."""
    import uuid

    rows = frequent if of == 1 else frequent.where(F.pmod(F.shiftrightunsigned(F.xxhash64("h"), 1), F.lit(of)) == share)
    values = rows.toArrow().column("h").to_numpy()
    return _Sent(uuid.uuid4().hex, frequent.sparkSession.sparkContext.broadcast(np.array(values, np.int64)))


def level_tables(parts: DataFrame, levels: list[DataFrame], least: int) -> DataFrame:
    """lang, k, phrase, f: all phrases that are seen `least` times or more, as a written table."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
    union = levels[0]
    for x in levels[1:]:
        union = union.unionByName(x)
    of, found, longest = shares(union), None, len(levels)
    for share in range(of):
        known = broadcast_share(union, share, of)

        def run(batches, known=known):
            some: list = []
            for rows in phrases(batches, known):
                some.append(rows)
                if sum(x.num_rows for x in some) > SUMMED:
                    some = [summed(some)]
                    if some[0].num_rows > SUMMED // 2:
                        yield from some.pop().to_batches(max_chunksize=100_000)
            if some:
                yield from summed(some).to_batches(max_chunksize=100_000)

        def phrases(batches, known):
            have = kept("known grams", known.id, lambda: Known(known.value))
            for b in sliced(batches, 1):
                names, blob, lang, word, codes = (b.column(i)[0].as_py() for i in range(5))
                raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True) if len(blob) > 8 else b""
                lang, word, codes = expand(lang), expand(word, np.uint64), expand(codes)
                words = pa.array(raw.decode().split("\n") if len(word) else [], pa.string())
                for k, (g, at) in enumerate(gram_hashes(word, codes, longest), 1):
                    hit = have.holds(g)
                    rows, n = distinct_grams(g[hit], codes[at[hit][:, None] + np.arange(k)])
                    if not len(rows):
                        continue
                    columns = [words.take(pa.array(rows[:, j])) for j in range(k)]
                    phrase = columns[0]
                    if k > 1:
                        import pyarrow.compute as pc

                        phrase = pc.binary_join_element_wise(*columns, " ")
                    of_lang = pa.array(names, pa.string()).take(pa.array(lang[rows[:, 0]]))
                    yield pa.Table.from_arrays([of_lang, pa.array(np.full(len(rows), k, np.int32)), phrase, pa.array(n)], schema=schema)

        one = parts.select("langs", "words", "lang", "hash", "codes").mapInArrow(run, "lang string, k int, phrase string, f long")
        found = one if found is None else found.unionByName(one)
    return stash(found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "level-tables")


def summed(some: list):
    """Tables of phrases with their counts as one, each phrase once."""
    import pyarrow as pa

    schema = some[0].schema
    return pa.concat_tables(some).group_by(schema.names[:-1], use_threads=False).aggregate([(schema.names[-1], "sum")]).select([*schema.names[:-1], "f_sum"]).rename_columns(schema.names)


def distinct_grams(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows (word numbers) and how often each is there. g: their hashes, which only speed it up."""
    _, first, inverse, n = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
    if (rows == rows[first[inverse]]).all():
        return rows[first], n.astype(np.int64)
    rows, n = np.unique(rows, axis=0, return_counts=True)  # two grams of one hash
    return rows, n.astype(np.int64)


def score_cuts(table: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of level tables (lang, k, phrase, f) and the number of words of each language (lang, n)."""
    candidates = table.where(F.col("k") >= 2)
    # A longer candidate is never more frequent than what it holds, so only equally frequent ones drop, and of those one that is a word longer.
    more = table.where(F.col("k") >= 3)
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)")))
    rest = candidates.join(more.select("lang", inner.alias("phrase"), "f"), ["lang", "phrase", "f"], "left_anti")
    rows, size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("phrase") + F.octet_length("lang"))).first()
    parts = table.select("lang", "phrase", "f")
    parts = small(parts, rows) if (size or 0) <= SMALL_BYTES else parts
    cuts = rest.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("_first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("_rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"]).join(small(words), "lang")
    score = F.expr("(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language may hold most phrases: the best of each of many parts first.
    spread = lowest.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(4 * partitions(table.sparkSession))))
    best = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """The `top` best phrases of 2 to `longest` words of each language that are seen `least` times or more: lang, rank, phrase, a, l, r, n, score."""
    made = packed(docs, text, lang)
    parts = in_tasks(made)
    levels = [count_level(parts, 1, None, least)]
    for k in range(2, longest + 1):
        levels.append(count_level(parts, k, levels[-1], least))
    table = level_tables(parts, levels, least)
    both = F.explode(F.arrays_zip("at_langs", "at_words")).alias("x")
    words = stash(made.select(both).groupBy(F.col("x.at_langs").alias("lang")).agg(F.sum("x.at_words").alias("n")), "words-of-languages")
    drop(made, *levels)
    return score_cuts(table, words, top)
