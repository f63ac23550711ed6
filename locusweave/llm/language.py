"""Language identification with a blended-spectrum string kernel.

A text becomes the set of its byte n-grams (n = 1, 2, 3) after lower-casing and putting one space for every run of bytes that are no
letters. k(x, y) is the mean over n of |Gn(x) & Gn(y)| / sqrt(|Gn(x)| |Gn(y)|), over the n-grams that at least two rows of the
training sample hold. LANDMARKS rows of the sample span the Nystroem map K(x, L) K(L, L)^(-1/2), on which one-versus-rest kernel ridge
regression is fitted. Scoring a batch is one presence matrix times the landmarks' matrix, then two small matrix products.

Learns from text and non-null language of rows whose fold is not 0, on a bounded sample (at most SAMPLE distinct pairs of language and text;
rows are picked by a hash of id and text).

Defined results: texts that are null or have no letter are `und` with score 0; without any training row all are `und`; a score is
(f + 1) / 2 of the best regression value f, cut to 0..1; ties go to the first language in order; repeated rows are scored alike; an
empty table gives an empty result; extra columns are ignored by identify() and carried along by accept().
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held, sampled, sliced

SAMPLE, LANDMARKS, RIDGE, ORDERS = 3_000, 96, 1e-2, (1, 2, 3)
#: Documents that score less than this are rejected in a filtering stage, as is `und`.
ACCEPT = 0.35
UNDEFINED = "und"
LETTER = regex.compile(r"\p{L}")


def _lower() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    for b in range(256):
        if 97 <= b <= 122 or b >= 128:
            t[b] = b
        elif 65 <= b <= 90:
            t[b] = b + 32
    t[0] = 0
    return t


LOWER = _lower()


def grams(texts: list[bytes]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Codes of the n-grams that begin at each byte of the normalised texts laid end to end (0 between texts), and each byte's text."""
    flat = np.frombuffer(b"\0\0".join([t.replace(b"\0", b" ") for t in texts]) + b"\0\0\0", np.uint8)
    f = LOWER[flat]
    # Capitals of the Latin-1 block: the second byte of two.
    f[1:][(f[:-1] == 0xC3) & (f[1:] >= 0x80) & (f[1:] <= 0x9E)] += 0x20
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    keep = np.append(True, (f[1:] != 32) | (f[:-1] != 32))[: len(owner)]
    f, owner = f[: len(owner)][keep], owner[keep]
    f = np.append(f, np.zeros(2, np.uint8)).astype(np.int32)
    codes = {1: f[:-2], 2: f[:-2] << 8 | f[1:-1], 3: f[:-2] << 16 | f[1:-1] << 8 | f[2:]}
    return codes, owner


def _inside(codes: np.ndarray, n: int) -> np.ndarray:
    """Whether no byte of the n-gram is the separator."""
    ok = codes & 255 != 0
    for k in range(1, n):
        ok &= codes >> 8 * k & 255 != 0
    return ok


class Kernel:
    """The fitted model: per order a table from n-gram codes to columns, the landmarks' matrix, and one weight matrix."""

    def __init__(self, sets: list[dict[int, np.ndarray]], langs: list[str]):
        self.langs = sorted(set(langs))
        self.vocab = {}
        for n in ORDERS:
            codes, times = np.unique(np.concatenate([s[n] for s in sets]) if sets else np.zeros(0, np.int32), return_counts=True)
            self.vocab[n] = codes[times >= min(2, len(sets))]
        if not self.langs:
            return
        rows = np.arange(len(sets))
        # Landmarks are taken in turn from every language.
        by = {g: [i for i in rows if langs[i] == g] for g in self.langs}
        marks = [by[g][k] for k in range(max(map(len, by.values()))) for g in self.langs if k < len(by[g])][:LANDMARKS]
        presence = {n: np.stack([np.isin(self.vocab[n], s[n]) for s in sets]).astype(np.float32) for n in ORDERS}
        self.marks = {}
        for n in ORDERS:
            m = presence[n][marks].T
            self.marks[n] = m / np.sqrt(np.maximum(m.sum(axis=0), 1)) / len(ORDERS)
        k = self.kernel(presence)
        kmm = k[marks].astype(np.float64)
        val, vec = np.linalg.eigh((kmm + kmm.T) / 2)
        ok = val > 1e-6 * val.max()
        root = vec[:, ok] / np.sqrt(val[ok])
        phi = k @ root
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        a = np.hstack([phi, np.ones((len(phi), 1))])
        # Rows weigh by the inverse of their language's share, so a rare language is not drowned.
        w = np.array([len(langs) / len(self.langs) / len(by[g]) for g in langs])[:, None]
        solved = np.linalg.solve(a.T @ (w * a) + RIDGE * np.eye(a.shape[1]), a.T @ (w * y))
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def kernel(self, presence: dict[int, np.ndarray]) -> np.ndarray:
        return sum((p @ self.marks[n]) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1)) for n, p in presence.items())

    def tables(self) -> dict[int, np.ndarray]:
        """Column of each code, and the last column for those outside the vocabulary."""
        if not hasattr(self, "_tables"):
            self._tables = {}
            for n in ORDERS:
                t = np.full(1 << 8 * n, len(self.vocab[n]), np.uint16 if len(self.vocab[n]) < 1 << 16 else np.int32)
                t[self.vocab[n]] = np.arange(len(self.vocab[n]))
                self._tables[n] = t
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, score = [UNDEFINED] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        at, size = 0, 0
        block: list[int] = []
        for at, i in enumerate(some):
            block.append(i)
            size += len(texts[i])
            if size > 500_000 or len(block) == 256 or at == len(some) - 1:
                codes, owner = grams([texts[j].encode("utf-8", "replace") for j in block])
                presence = {}
                for n in ORDERS:
                    width = len(self.vocab[n]) + 1
                    p = np.zeros(len(block) * width, np.float32)
                    p[owner * np.int64(width) + self.tables()[n][codes[n]]] = 1
                    presence[n] = p.reshape(len(block), width)[:, :-1]
                f = self.kernel(presence) @ self.weights + self.bias
                best = f.argmax(axis=1)
                score[block] = np.clip((f[np.arange(len(block)), best] + 1) / 2, 0, 1)
                for j, b in zip(block, best.tolist()):
                    langs[j] = self.langs[b]
                block, size = [], 0
        return langs, score


def _unpacked(model: bytes) -> Kernel:
    """The model, kept in the worker."""
    import pickle

    return held("language", model, lambda: pickle.loads(model))


def learn(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> Kernel:
    import pyarrow as pa

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col(ident)) != 0)).select(F.col(lang).cast("string").alias("l"), F.col(text).cast("binary").alias("t"))
    some = sampled(rows, SAMPLE, "l", "t", seed=3).select("l", "t", F.col("_sample").alias("o"))

    def run(batches):
        for b in sliced(batches):
            out = {n: [] for n in ORDERS}
            for t in b.column(1).to_pylist():
                codes, _ = grams([t])
                for n in ORDERS:
                    c = codes[n]
                    out[n].append(np.unique(c[_inside(c, n)]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(out[n], pa.binary()) for n in ORDERS)], ["lang", "o", *(f"g{n}" for n in ORDERS)])

    sets = [f"g{n}" for n in ORDERS]
    got = some.mapInArrow(run, "lang string, o long, " + ", ".join(f"{g} binary" for g in sets)).groupBy("o", "lang").agg(*[F.min(g).alias(g) for g in sets]).collect()
    got = [r for r in sorted(got, key=lambda r: (r["o"], r["lang"], bytes(r["g3"]))) if len(r["g1"])]
    return Kernel([{n: np.frombuffer(bytes(r[f"g{n}"]), np.int32) for n in ORDERS} for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Kernel, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, lang_pred, score; one row for each input row."""
    import pickle

    import pyarrow as pa

    packed = pickle.dumps(model)

    def run(batches):
        k = _unpacked(packed)
        for b in sliced(batches):
            langs, score = k.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score)], [ident, "lang_pred", "score"])

    src = docs.select(ident, text)
    return src.mapInArrow(run, f"`{ident}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double")


def accept(docs: DataFrame, model: Kernel, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of docs, with all their columns, that are in a learned language with at least this score."""
    import pickle

    import pyarrow as pa

    packed, at = pickle.dumps(model), docs.columns.index(text)

    def run(batches):
        k = _unpacked(packed)
        for b in sliced(batches):
            langs, score = k.predict(b.column(at).to_pylist())
            yield b.filter(pa.array((score >= least) & (np.array(langs, object) != UNDEFINED), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
