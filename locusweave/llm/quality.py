"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (bytes by kind, word and line shapes, repetition, entropy) are computed on the executors. The
trees are fitted in numpy on the driver from the statistics of a bounded sample of labelled rows (SAMPLE), and scoring walks
all trees at once: they are complete binary trees flattened into arrays, so one step of the walk is one gather.

Defined results: null and empty texts have statistics (all zero) and a score; documents without a label are scored; different
labels of a document are rows of their own, equal ones count once, and of rows with one id that with the smallest statistics is learned from; null labels are left out; without any labelled row every score is 0.5;
repeated rows are scored alike; an empty table gives an empty result; extra columns are ignored by score() and carried
along by accept().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sampled, sliced

#: Labelled rows that the trees are fitted on at most (in expectation; rows are picked by a hash of the id).
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 48, 0.15, 1.0, 8.0
ACCEPT = 0.3


def _kinds() -> np.ndarray:
    """Which of the counted kinds each byte is: (256, kinds)."""
    b = np.arange(256)
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    high, lead = b >= 128, b >= 192
    sentence = np.isin(b, list(b".,;:?!'\"-()"))
    symbol = (b > 32) & (b < 127) & ~(upper | lower | digit | sentence)
    vowel = np.isin(b, list(b"aeiouAEIOU"))
    return np.stack([upper, lower, digit, space, b == 10, high, lead, sentence, symbol, vowel, b == 33, b == 46, b < 9], axis=1).astype(np.float64)


KINDS = _kinds()
SYMBOLS = frozenset(b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")
N_STATS = KINDS.shape[1] + 13


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """(documents, N_STATS) of float32."""
    out = np.zeros((len(texts), N_STATS), np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        n = len(t)
        hist = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        p = hist[hist > 0] / n
        words = t.split()
        w = max(1, len(words))
        distinct = set(words)
        lines = t.split(b"\n")
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        # Shares over distinct words stand for shares over words where a loop over all words would cost too much.
        ends = sum(1 for x in distinct if x[-1] in SYMBOLS and x[-1] not in b"!?:;)\"") / max(1, len(distinct))
        loud = sum(1 for x in distinct if x.isupper()) / max(1, len(distinct))
        out[i] = [
            *(hist @ KINDS / n), np.log1p(n), np.log1p(w), len(distinct) / w, lengths.mean(), lengths.std(), lengths.max(),
            (lengths <= 3).sum() / w, -(p * np.log2(p)).sum(), len(set(lines)) / len(lines), np.log1p(n / len(lines)), ends, loud, len(distinct) / np.sqrt(w),
        ]
    return out


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of inner nodes, value of leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        total = self.base + self.value[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss; second-order gains on histograms of quantile bins."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if not len(y):
        return empty
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        empty.base = base
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin b: above b edges
    total = np.full(len(y), base)
    feature, threshold, value = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        tf, tt = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * BINS + binned[:, f]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
                gain[(hl < LEAST / 20) | (ha - hl < LEAST / 20)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best).tolist():
                    best[w], tf[first + w], tt[first + w] = top[w], f, e[k[w]]
            node = 2 * node + 1 + (x[np.arange(len(y)), tf[node]] > tt[node])
        leaf = node - inner
        v = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        total += v[leaf]
        feature.append(tf)
        threshold.append(tt)
        value.append(v)
    return Trees(base, np.array(feature), np.array(threshold), np.array(value))


def learn(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Fit on a bounded sample of the labelled rows whose fold is not 0."""
    import pyarrow as pa

    rows = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & (fold(F.col(ident)) != 0)).select(F.col(ident).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    some = sampled(rows, SAMPLE, "_id", "_y", seed=5).drop("_sample")
    picked = docs.select(F.col(ident).alias("_id"), F.col(text).cast("binary").alias("_t")).join(F.broadcast(some), "_id")  # SAMPLE rows at most

    def run(batches):
        for b in sliced(batches):
            s = statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in s], pa.binary())], ["_id", "_y", "s"])

    kind = picked.schema["_id"].dataType.simpleString()
    # Of repeated ids one row for each label.
    got = picked.select("_id", "_t", "_y").mapInArrow(run, f"_id {kind}, _y int, s binary").groupBy("_id", "_y").agg(F.min("s").alias("s"))
    got = sorted(got.collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    x = np.array([np.frombuffer(bytes(r[2]), np.float32) for r in got]).reshape(len(got), N_STATS)
    return fit(x, np.array([float(r[1] > 0) for r in got]))


def score(docs: DataFrame, trees: Trees, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, score; one row for each input row."""
    import pyarrow as pa

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(statistics(b.column(1).to_pylist())), pa.float64())], [ident, "score"])

    src = docs.select(ident, F.col(text).cast("binary"))
    return src.mapInArrow(run, f"`{ident}` {src.schema[0].dataType.simpleString()}, score double")


def accept(docs: DataFrame, trees: Trees, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of docs, with all their columns, that score at least `least`."""
    import pyarrow as pa

    at = docs.columns.index(text)

    def run(batches):
        for b in sliced(batches):
            yield b.filter(pa.array(trees.score(statistics(b.column(at).cast(pa.binary()).to_pylist())) >= least))

    return docs.mapInArrow(run, docs.schema)
