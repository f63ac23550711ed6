"""Language-model scoring by a Brown class-based bigram model.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)). The most frequent training words (the head, which grows with the
training tokens, as do the classes) are dealt over the classes by exchange clustering: in turn each word is moved to the class that
raises the class-bigram likelihood most, until no word moves. Then every other training word seen MIN_COUNT times or more
is taken out of its spelling class and put into the class that raises the likelihood most against the head's classes, which stay as they are.
Rarer words stay in a class by their spelling (length and last letter), which also holds the words not
seen in training; the end of a document is a class of its own. Class transitions are interpolated with class frequencies
(Witten-Bell); in the spelling classes absolute discounting leaves probability for unseen words.

What is counted: the words of all training documents (c, N, V) and what stands before and after each word, in partial counts per chunk of
documents that meet in buckets of words; transitions between head words, spelling classes and ends, and later between all classes, over all
training tokens. Only the tables of those transitions go to the driver. Word counts are never collected or
broadcast: a bucket sends each chunk the counts and classes of its words.

Words are known by 64-bit hashes (XXH3, with the spelling class in the lowest bits).

Defined results: a null text counts as empty; an empty text is its end alone; repeated rows are counted and scored each; without
training rows N = V = 0, and every token then scores log10(1) in the base and as a single unknown word in the model; an empty table gives an
empty result; extra columns are ignored. A null id has fold crc32("").
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, expand, fold_of, forget, held as kept, partitions, sliced, squeeze, stash

#: Least and most head words (the driver holds a table of head x head numbers: 128 MB at most); how often other words must be seen to be put into a class of the head.
HEAD, MOST_HEAD, MIN_COUNT = 800, 4_000, 2
#: Numbers in the arrays that are weighed at once; bins of word counts for each doubling.
WEIGHED, BINS = 1_500_000, 64
#: Spelling classes: 4 lengths times 8 kinds of last character; a chunk's text bytes.
SHAPES, CHUNK_BYTES = 32, 12_000_000
ENDINGS = {c: i for i, cs in enumerate(("aàáâä", "eéèê", "ioíóöu", "nmñ", "rsß", "dt", ".,;:!?")) for c in cs.encode()}


def sizes(tokens: int) -> tuple[int, int]:
    """Head words and classes for so many training tokens: by their cube root, up to MOST_HEAD words. Words outside the head are classed too, on the executors."""
    head = min(MOST_HEAD, max(HEAD, int(3 * tokens ** (1 / 3))))
    return head, isqrt(3 * head)


def shape(word: bytes) -> int:
    """The spelling class of a word."""
    n = len(word)
    return (0 if n <= 4 else 1 if n <= 8 else 2 if n <= 12 else 3) * 8 + ENDINGS.get(word[-1], 7)


class _Words(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


CHUNK_FIELDS = [("ids", "binary"), ("lengths", "binary"), ("held", "binary"), ("tokens", "binary"), ("words", "binary"), ("counts", "binary")]


def chunks(docs: DataFrame, ident: str, text: str, of: int, test: int) -> DataFrame:
    """One row for each chunk of documents: token numbers of all documents, and the chunk's distinct words (as hashes) with their training counts."""
    import pyarrow as pa

    def run(batches):
        from xxhash import xxh3_64_intdigest

        def out():
            words = np.fromiter(((xxh3_64_intdigest(w) & ~31) | shape(w) for w in number), np.uint64, len(number))
            tok = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            n = np.array([len(t) for t in tokens], np.int64)
            train = np.repeat(~np.array(held, bool), n)
            counts = np.bincount(tok[train], minlength=len(words)).astype(np.int32)
            cells = [np.array(ids, np.int64).tobytes(), n.tobytes(), np.array(held, bool).tobytes(), squeeze(tok), words.view(np.int64).tobytes(), squeeze(counts)]
            sums = {"null_id": pa.array([null], pa.int32()), "train_docs": [len(held) - sum(held)], "train_words": [int(n[~np.array(held, bool)].sum())]}
            return pa.RecordBatch.from_pydict({k: [c] for (k, _), c in zip(CHUNK_FIELDS, cells)} | sums)

        forget()
        ids, held, tokens, number, size, null = [], [], [], _Words(), 0, -1
        for b in sliced(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = (t or b"").lower().split()
                held.append(fold_of(i, of) == test)
                ids.append(0 if i is None else i)
                null = len(ids) - 1 if i is None else null
                tokens.append(np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)))
                size += len(t or b"")
                if size >= CHUNK_BYTES or i is None:
                    yield out()
                    ids, held, tokens, number, size, null = [], [], [], _Words(), 0, -1
        if ids:
            yield out()

    src = docs.select(F.col(ident).cast("long"), F.col(text).cast("binary"))
    made = src.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in CHUNK_FIELDS) + ", null_id int, train_docs long, train_words long")
    return stash(made.withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(5)) % np.uint64(buckets)


def word_counts(table: DataFrame, buckets: int, head: int) -> DataFrame:
    """For each bucket of words: its `head` most frequent training words and their counts, tokens, distinct words, and of its words below
    MIN_COUNT, for each spelling class: tokens, distinct words, words seen once, words seen twice."""
    import pyarrow as pa

    def send(batches):
        for b in sliced(batches, 1):
            for words, counts in zip(*(x.to_pylist() for x in b.columns)):
                w, n = np.frombuffer(words, np.int64), expand(counts)
                w, n = w[n > 0], n[n > 0]
                to = bucket_of(w, buckets)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(buckets + 1))
                out = [(k, order[i:j]) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([w[i].tobytes() for _, i in out], pa.binary()), pa.array([squeeze(n[i]) for _, i in out], pa.binary())], ["bucket", "words", "n"])

    def add(key, batch):
        w = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("words").to_pylist()])
        n = np.concatenate([expand(x) for x in batch.column("n").to_pylist()])
        w, at = np.unique(w, return_inverse=True)
        c = np.bincount(at, n, len(w)).astype(np.int64)
        low = c < MIN_COUNT
        kinds = np.array([np.bincount(w[some] & 31, weights, SHAPES) for some, weights in ((low, c[low]), (low, None), (c == 1, None), (c == 2, None))]).astype(np.int64)
        top = np.lexsort((w, -c))[:head]
        return pa.table({"words": [w[top].tobytes()], "c": [c[top].tobytes()], "tokens": [int(c.sum())], "distinct": [len(w)], "kinds": [kinds.ravel().tolist()]}, schema=schema)

    schema = pa.schema([("words", pa.binary()), ("c", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("kinds", pa.list_(pa.int64()))])
    sent = table.select("words", "counts").mapInArrow(send, "bucket long, words binary, n binary")
    return stash(sent.groupBy("bucket").applyInArrow(add, "words binary, c binary, tokens long, distinct long, kinds array<long>"), "lm-counts")


def most_frequent(counted: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for words, c in zip(*(x.to_pylist() for x in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["word", "c"])

    rows = counted.select("words", "c").mapInArrow(run, "word long, c long").withColumn("bin", F.floor(F.log2("c") * BINS))
    # Bins of counts come first, so that only about `head` rows are sorted, however many buckets there are.
    least, have = 0, 0
    for r in sorted(rows.groupBy("bin").count().collect(), reverse=True):
        least, have = r["bin"], have + r["count"]
        if have >= head:
            break
    top = rows.where(F.col("bin") >= least).orderBy(F.desc("c"), "word").limit(head).select("word", "c").toArrow()
    return top.column("word").to_numpy(), top.column("c").to_numpy().astype(np.float64)


def f(x: np.ndarray) -> np.ndarray:
    """n log n of counts."""
    return x * np.log(np.maximum(x, 1.0))


def weigh(n: np.ndarray, rows: np.ndarray, cols: np.ndarray, classes: int, r: np.ndarray, c: np.ndarray, own: float, total: tuple[float, float]) -> np.ndarray:
    """What the likelihood gains by a word in each of the classes. n: class bigrams without the word, rows and cols: how often other members are first and second of a pair; r, c: the word's
    counts before and after each class, own: before itself, total: all as first and as second of a pair.

    The likelihood is the sum of f(N(c, d)) over classes less f of the row and column sums, with f(n) = n log n.
    """
    i, j = np.flatnonzero(r), np.flatnonzero(c)
    m, k = n[:classes, i], n[j, :classes]
    gain = (f(m + r[i]) - f(m)).sum(axis=1) + (f(k + c[j][:, None]) - f(k)).sum(axis=0)
    d = np.arange(classes)
    both = n[d, d]
    gain += f(both + r[d] + c[d] + own) - f(both + r[d]) - f(both + c[d]) + f(both)
    rows, cols = rows[:classes], cols[:classes]
    return gain - (f(rows + total[0]) - f(rows) + f(cols + total[1]) - f(cols))


def exchange(t: np.ndarray, head: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each of the first `head` symbols, and the class bigrams; the others (columns and rows after them) stay alone. t: bigram counts.

    Ends when no word moves: each move raises the likelihood by more than rounding.
    """
    size = len(t)
    others = size - head
    of = np.concatenate([np.arange(head) % classes, classes + np.arange(others)])
    k = classes + others
    right = np.zeros((size, k))  # counts of each symbol before each class
    left = np.zeros((size, k))
    for j in range(k):
        right[:, j] = t[:, of == j].sum(axis=1)
        left[:, j] = t[of == j].sum(axis=0)
    n = np.zeros((k, k))
    np.add.at(n, of, right)
    rows, cols = n.sum(axis=1), n.sum(axis=0)
    first, second = t.sum(axis=1)[:head], t.sum(axis=0)[:head]
    least = 1e-12 * float(f(np.array([t.sum()]))[0]) + 1e-9
    moved = head
    while moved:
        moved = 0
        for w in range(head):
            a = of[w]
            r, c, self_ = right[w].copy(), left[w].copy(), t[w, w]
            r[a] -= self_
            c[a] -= self_
            # Take the word out of its class, then weigh every class that it could go to.
            n[a] -= r
            n[:, a] -= c
            n[a, a] -= self_
            rows[a] -= first[w]
            cols[a] -= second[w]
            gain = weigh(n, rows, cols, classes, r, c, self_, (first[w], second[w]))
            b = int(gain.argmax())
            if gain[b] <= gain[a] + least:
                b = a
            n[b] += r
            n[:, b] += c
            n[b, b] += self_
            rows[b] += first[w]
            cols[b] += second[w]
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= t[:, w]
                right[:, b] += t[:, w]
                left[:, a] -= t[w]
                left[:, b] += t[w]
    return of, n


def weigh_many(n: np.ndarray, rows: np.ndarray, cols: np.ndarray, classes: int, home: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray, total: np.ndarray) -> np.ndarray:
    """weigh() for many words outside the head: (words, classes). Each is first taken out of its spelling class, `home`.

    before, after: (words, symbols) how often each class, spelling class or end stands before and after the word; own: the word before itself; total: all its tokens.
    """
    t = total[:, None].astype(np.float64)
    gain = f(rows[:classes]) - f(rows[:classes] + t) + f(cols[:classes]) - f(cols[:classes] + t)
    for table, counts, others in ((n[:classes].T, after, before), (n[:, :classes], before, after)):
        word, symbol = np.nonzero(counts)
        if not len(word):
            continue
        cell = table[symbol].astype(np.float64)
        at = np.flatnonzero(symbol == home[word])
        cell[at] -= others[word[at], :classes]  # what the word itself adds to its spelling class
        more = f(cell + counts[word, symbol][:, None]) - f(cell)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        gain[word[starts]] += np.add.reduceat(more, starts, axis=0)
    # Inside a class the pairs of the word with the class meet in one cell.
    r, c, both = after[:, :classes], before[:, :classes], np.diagonal(n)[:classes]
    word, d = np.nonzero(((r > 0) & (c > 0)) | (own > 0)[:, None])
    r, c, both = r[word, d], c[word, d], both[d]
    gain[word, d] += f(both + r + c + own[word]) - f(both + r) - f(both + c) + f(both)
    return gain


def find(head: np.ndarray, values: np.ndarray, words: np.ndarray, default) -> np.ndarray:
    """The value of each word that is in the head (sorted), and else the default."""
    if not len(head):
        return default + np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(head, words), len(head) - 1)
    return np.where(head[at] == words, values[at], default)


def assigned(table: DataFrame, buckets: int, head: np.ndarray, head_class: np.ndarray, n: np.ndarray, classes: int) -> DataFrame:
    """chunk, at, c, class: counts and classes of each chunk's words, from the buckets of words. head is sorted; n: its class bigrams."""
    import pyarrow as pa

    end = classes + SHAPES
    kinds = end + 2  # classes, spelling classes, the end, the word itself
    fields = [("bucket", "long"), ("chunk", "long"), ("at", "binary"), ("words", "binary"), ("n", "binary"), ("cells", "binary"), ("code", "binary"), ("times", "binary")]
    rows, cols = n.sum(axis=1), n.sum(axis=0)

    def send(batches):
        for b in sliced(batches, 1):
            for chunk, held, lengths, tokens, words, counts in zip(*(x.to_pylist() for x in b.columns)):
                words, counts = np.frombuffer(words, np.int64), expand(counts)
                to = bucket_of(words, buckets)
                order = np.argsort(to, kind="stable")
                place = np.empty(len(words), np.int64)  # of each word in that order
                place[order] = np.arange(len(words))
                cls = find(head, head_class, words, -1)
                lengths = np.frombuffer(lengths, np.int64)
                idx = with_ends(expand(tokens), lengths, len(words))
                code = np.append(np.where(cls < 0, classes + (words & 31), cls), end)[idx]
                take = np.flatnonzero(np.repeat(~np.frombuffer(held, bool), lengths + 1) & (np.append(cls, 0)[idx] < 0))
                w, base = idx[take], place[idx[take]] * (2 * kinds)
                # An end follows each word's document, and the chunk's last end stands before the first word as its place -1.
                before, after = idx[take - 1], idx[take + 1]
                keys = np.concatenate([base + np.where(before == w, kinds - 1, code[take - 1]), (base + kinds + code[take + 1])[after != w]])
                keys, times = np.unique(keys, return_counts=True)
                whose, keys, times = keys // (2 * kinds), (keys % (2 * kinds)).astype(np.int16), times.astype(np.int32)
                per_word = np.bincount(whose, minlength=len(words)).astype(np.int32)
                ends = np.searchsorted(to[order], np.arange(buckets + 1))
                cell_ends = np.searchsorted(whose, ends)
                for k in range(0, buckets, 64):
                    out = [(j, order[ends[j] : ends[j + 1]], slice(ends[j], ends[j + 1]), slice(cell_ends[j], cell_ends[j + 1])) for j in range(k, min(k + 64, buckets)) if ends[j + 1] > ends[j]]
                    cols_ = [[j for j, *_ in out], [chunk] * len(out), [squeeze(i.astype(np.int32)) for _, i, _, _ in out], [words[i].tobytes() for _, i, _, _ in out], [squeeze(counts[i]) for _, i, _, _ in out], [squeeze(per_word[s]) for _, _, s, _ in out], [squeeze(keys[s]) for *_, s in out], [squeeze(times[s]) for *_, s in out]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(cols_)], [k for k, _ in fields])

    def choose(key, batch):
        got = {k: batch.column(k).to_pylist() for k in ("chunk", "at", "words", "n", "cells", "code", "times")}
        parts = [np.frombuffer(x, np.int64) for x in got["words"]]
        w, at = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(at, np.concatenate([expand(x) for x in got["n"]]), len(w)).astype(np.int64)
        cls = find(head, head_class, w, -1)
        todo = np.flatnonzero((cls < 0) & (c >= MIN_COUNT))
        cls = np.where(cls < 0, classes + (w & 31), cls)
        keys = np.repeat(at, np.concatenate([expand(x) for x in got["cells"]])) * (2 * kinds) + np.concatenate([expand(x, np.int16) for x in got["code"]])
        times = np.concatenate([expand(x) for x in got["times"]])
        keys, where = np.unique(keys, return_inverse=True)
        times = np.bincount(where, times, len(keys))
        first = np.searchsorted(keys, todo * (2 * kinds))
        last = np.searchsorted(keys, (todo + 1) * (2 * kinds))
        cost = (np.cumsum(last - first) * max(1, classes) + np.arange(len(todo)) * 2 * kinds) // WEIGHED
        for part in np.split(np.arange(len(todo)), np.flatnonzero(np.diff(cost)) + 1) if len(todo) and classes else []:
            words = todo[part]
            some = slice(first[part[0]], last[part[-1]])
            whose = keys[some] // (2 * kinds)
            row = np.minimum(np.searchsorted(words, whose), len(words) - 1)
            mine = words[row] == whose  # rarer words lie between them
            cells = np.zeros((len(words), 2 * kinds))
            cells[row[mine], keys[some][mine] % (2 * kinds)] = times[some][mine]
            gain = weigh_many(n, rows, cols, classes, cls[words], cells[:, : end + 1], cells[:, kinds : kinds + end + 1], cells[:, kinds - 1], c[words])
            cls[words] = gain.argmax(axis=1)
        cut = np.cumsum([len(x) for x in parts])[:-1]
        back = np.split(at, cut)
        return pa.table({"chunk": got["chunk"], "at": got["at"], "c": [squeeze(c[i]) for i in back], "class": [squeeze(cls[i].astype(np.int16)) for i in back]}, schema=schema)

    schema = pa.schema([("chunk", pa.int64()), ("at", pa.binary()), ("c", pa.binary()), ("class", pa.binary())])
    sent = table.select("chunk", "held", "lengths", "tokens", "words", "counts").mapInArrow(send, ", ".join(f"{k} {t}" for k, t in fields))
    return sent.groupBy("bucket").applyInArrow(choose, "chunk long, at binary, c binary, class binary")


def by_chunk(rows: DataFrame) -> DataFrame:
    """chunk, c, class: counts and classes of all of a chunk's words in its own order, from the rows of assigned()."""
    import pyarrow as pa

    def gather(key, batch):
        at = np.concatenate([expand(x) for x in batch.column("at").to_pylist()])
        c, cls = np.zeros(len(at), np.int64), np.zeros(len(at), np.int16)
        c[at] = np.concatenate([expand(x, np.int64) for x in batch.column("c").to_pylist()])
        cls[at] = np.concatenate([expand(x, np.int16) for x in batch.column("class").to_pylist()])
        return pa.table({"chunk": [key[0].as_py()], "c": [squeeze(c)], "class": [squeeze(cls)]}, schema=pa.schema([("chunk", pa.int64()), ("c", pa.binary()), ("class", pa.binary())]))

    return rows.groupBy("chunk").applyInArrow(gather, "chunk long, c binary, class binary")


class Model:
    """Log10 probabilities of class transitions and what emissions need."""

    def __init__(self, n2: np.ndarray, shapes: dict[int, tuple[int, int, int, int]], n: int, v: int):
        """n2: bigrams of classes, spelling classes and the end; shapes: spelling class -> tokens, distinct words, words seen once, words seen twice."""
        self.n, self.v = n, v
        self.k = k = len(n2)
        self.end = k - 1
        first = k - 1 - SHAPES
        n2 = n2.astype(np.float64)
        size = np.where(np.arange(k) < first, n2.sum(axis=0), 0.0)
        self.fresh, self.discount = np.zeros(k), np.zeros(k)
        for s in range(SHAPES):
            tokens, distinct, once, twice = shapes.get(s, (0, 0, 0, 0))
            size[first + s] = tokens
            self.discount[first + s] = once / (once + 2 * twice) if once and twice else 0.5
            self.fresh[first + s] = max(self.discount[first + s] * distinct, 0.5)
        self.size = size + np.where(self.discount > 0, np.maximum(0.5 - self.discount * np.array([0.0] * first + [shapes.get(s, (0, 0))[1] for s in range(SHAPES)] + [0.0]), 0), 0)
        seen = n2.sum(axis=0) + 0.5  # class frequencies as successors
        uni = seen / seen.sum()
        types = (n2 > 0).sum(axis=1, keepdims=True) + 1.0
        self.step = np.log10((n2 + types * uni) / (n2.sum(axis=1, keepdims=True) + types))

    def emission(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class); a word not seen takes all that its spelling class leaves for such words."""
        seen = (counts - self.discount[classes]) / np.maximum(self.size[classes], 1e-9)
        fresh = self.fresh[classes] / np.maximum(self.size[classes], 0.5)
        return np.log10(np.where(counts > 0, np.maximum(seen, 1e-30), np.minimum(fresh, 1.0)))


def _loaded(packed: bytes) -> Model:
    import pickle

    return kept("lm", packed, lambda: pickle.loads(packed))


def bigrams(symbol: np.ndarray, tokens: bytes, lengths: bytes, held: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in a chunk's training documents, as first * (end + 1) + second, and their counts. symbol: of each of the chunk's words; the end also stands before each first word."""
    n, keep = np.frombuffer(lengths, np.int64), ~np.frombuffer(held, bool)
    seq = with_ends(symbol[expand(tokens)], n, end)
    before = np.append(end, seq[:-1])
    use = np.repeat(keep, n + 1)
    return np.unique(before[use] * (end + 1) + seq[use], return_counts=True)


def transitions(table: DataFrame, size: int, symbols) -> np.ndarray:
    """Bigram counts over the training documents. table: held, lengths, tokens and what symbols() makes the words' symbols of; the last symbol is the end."""
    import pyarrow as pa

    block = max(1, (1 << 18) // size)  # rows of the table that are added up together

    def run(batches):
        for b in sliced(batches, 1):
            for held, lengths, tokens, *rest in zip(*(x.to_pylist() for x in b.columns)):
                codes, n = bigrams(symbols(*rest), tokens, lengths, held, size - 1)
                ends = np.searchsorted(codes, np.arange(0, size + block, block) * size)
                out = [(k, slice(i, j)) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([squeeze(codes[s] - k * block * size) for k, s in out], pa.binary()), pa.array([squeeze(n[s]) for _, s in out], pa.binary())], ["block", "code", "n"])

    def add(key, batch):
        codes = np.concatenate([expand(x, np.int64) for x in batch.column("code").to_pylist()])
        total = np.bincount(codes, np.concatenate([expand(x, np.int64) for x in batch.column("n").to_pylist()]), block * size).astype(np.int64)
        return pa.table({"block": [key[0].as_py()], "n": [squeeze(total)]}, schema=pa.schema([("block", pa.int64()), ("n", pa.binary())]))

    t = np.zeros((-(-size // block) * block, size), np.float64)
    for r in table.mapInArrow(run, "block long, code binary, n binary").groupBy("block").applyInArrow(add, "block long, n binary").toLocalIterator():
        t[r["block"] * block : (r["block"] + 1) * block] = expand(bytes(r["n"]), np.int64).reshape(block, size)
    return t[:size]


def with_ends(symbols: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The symbols of documents laid end to end, with the end after each."""
    out = np.full(len(symbols) + len(lengths), end, np.int64)
    place = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
    out[place] = symbols
    return out


def clustered(parts: DataFrame):
    """Chunks with counts and classes of their words, number of classes, the spelling classes' counts, word tokens and distinct words in training."""
    spark = parts.sparkSession
    many, tokens = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("train_words"), F.lit(0))).first()
    buckets = max(min(partitions(spark), 4 * many), many // 2, 1)
    n_head, n_classes = sizes(tokens)
    counted = word_counts(parts, buckets, n_head)
    distinct = counted.agg(F.sum("distinct")).first()[0] or 0
    sums = counted.agg(*[F.coalesce(F.sum(F.get("kinds", F.lit(i))), F.lit(0)) for i in range(4 * SHAPES)]).first()
    shapes = np.array(sums, np.int64).reshape(4, SHAPES)
    head, head_counts = most_frequent(counted, n_head)
    for w, c in zip(head.tolist(), head_counts.tolist()):
        if c < MIN_COUNT:
            shapes[:, w & 31] -= [int(c), 1, c == 1, c == 2]
    n_classes = n_classes if len(head) else 0
    order = np.argsort(head)
    ordered, size = head[order], len(head) + SHAPES + 1
    t = transitions(parts.select("held", "lengths", "tokens", "words"), size, lambda words: find(ordered, order, w := np.frombuffer(words, np.int64), len(head) + (w & 31)))
    of, n = exchange(t, len(head), n_classes)
    rows = assigned(parts, buckets, ordered, of[: len(head)][order], n, n_classes)
    m = max(2 * spark.sparkContext.defaultParallelism, partitions(spark))
    classed = stash(parts.drop("words", "counts").repartition(m, "chunk").join(by_chunk(rows), "chunk", "left"), "lm-classed")
    drop(counted)
    return classed, n_classes, {s: tuple(map(int, shapes[:, s])) for s in range(SHAPES)}, tokens, distinct


def score_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text", of: int = 5, test: int = 1) -> DataFrame:
    """ident, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; one row for each input row."""
    import pickle

    import pyarrow as pa

    parts = chunks(docs, ident, text, of, test)
    trained = parts.agg(F.coalesce(F.sum("train_docs"), F.lit(0))).first()[0]
    classed, n_classes, shapes, tokens, distinct = clustered(parts)
    drop(parts)
    none = squeeze(np.zeros(0, np.int16))
    t = transitions(classed.select("held", "lengths", "tokens", "class"), n_classes + SHAPES + 1, lambda c: expand(c or none, np.int16).astype(np.int64))
    model = pickle.dumps(Model(t, shapes, tokens + trained, distinct + (trained > 0)))  # ends are tokens too
    fields = f"`{ident}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches):
        m = _loaded(model)
        for b in sliced(batches, 1):
            for ids, lengths, held, tokens, count, cls, null in zip(*(x.to_pylist() for x in b.columns)):
                lengths = np.frombuffer(lengths, np.int64)
                count, cls = expand(count or none, np.int64), expand(cls or none, np.int16).astype(np.int64)
                tok = expand(tokens)
                emit = m.emission(cls, count)
                total = m.n + 0.5 * (m.v + 1)
                base = np.log10((count + 0.5) / total)
                seq = with_ends(cls[tok], lengths, m.end)
                before = np.append(m.end, seq[:-1])
                lp = m.step[before, seq] + with_ends_values(emit[tok], lengths, 0.0)
                lb = with_ends_values(base[tok], lengths, np.log10((trained + 0.5) / total))
                kn = with_ends_values((count > 0)[tok].astype(np.float64), lengths, float(trained > 0))
                starts = np.cumsum(lengths + 1) - (lengths + 1)
                add = lambda x: np.add.reduceat(x, starts)
                who = np.frombuffer(ids, np.int64)
                s = add(lp)
                cols = [pa.array(who, mask=np.arange(len(who)) == null), pa.array(np.frombuffer(held, bool)), pa.array(lengths + 1), pa.array(add(kn).astype(np.int64)), pa.array(np.full(len(who), m.n)), pa.array(add(lb)), pa.array(s), pa.array(10 ** np.minimum(-s / (lengths + 1), 300))]
                yield pa.RecordBatch.from_arrays(cols, [ident, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return classed.select("ids", "lengths", "held", "tokens", "c", "class", "null_id").mapInArrow(run, fields)


def with_ends_values(values: np.ndarray, lengths: np.ndarray, end: float) -> np.ndarray:
    out = np.full(len(values) + len(lengths), end)
    out[np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths)] = values
    return out
