"""Word shingles of many texts at once, as 64-bit hashes in numpy.

A text's words are runs of bytes that are no white space (0x20, 0x09-0x0D), with A-Z in lower case. The bytes of a block of texts lie in one
array; words are hashed eight bytes at a time, all words of the block together, and shingles are sums of word hashes under
powers of an odd number, mixed. No cache and no state between blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Text bytes of a block: its arrays stay in a processor's cache. Longer words are hashed one by one.
BLOCK_BYTES, LONG_WORD = 1 << 19, 256

_ODD, _MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(64)]
_LENGTHS = [np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(64)]
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[9:14] = 32
    return t


_LOWER = _lower()


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of x in place."""
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= _MORE
    x ^= x >> np.uint64(32)
    return x


def hashes(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of each word in bytes that end with at least eight others."""
    eight = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))
    h = lengths.astype(np.uint64) * _ODD
    h ^= eight[starts] & _MASKS[np.minimum(lengths, 8)]
    _mix(h)
    at, longer = 8, np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    while len(longer):
        part = h[longer] * _ODD
        part ^= eight[starts[longer] + at] & _MASKS[np.minimum(lengths[longer] - at, 8)]
        h[longer] = _mix(part)
        at += 8
        longer = longer[lengths[longer] > at]
    if len(huge := np.flatnonzero(lengths > LONG_WORD)):
        from xxhash import xxh3_64_intdigest

        h[huge] = [xxh3_64_intdigest(low[a : a + n].tobytes()) for a, n in zip(starts[huge].tolist(), lengths[huge].tolist())]
    return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts laid end to end, and how many words each text has."""
    return words_of(texts)[:2]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes(), the texts' bytes in lower case, and where each word begins there and its length."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, np.uint8)
    low = _LOWER[data]
    space = low == 32
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)  # where each text's separator is
    per = np.diff(np.append(0, np.searchsorted(starts, ends)))
    h = hashes(low, starts, lengths)
    return h, per, low, starts, lengths


def _block(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    h, per = word_hashes(texts)
    first = np.cumsum(per) - per
    size = np.where(per > 0, np.maximum(per - words, 0) + 1, 0)  # shingles of each text
    ends = np.cumsum(size)
    x = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    if len(h) >= words:
        w = h[: len(h) - words + 1] * _POWERS[words]
        for i in range(1, words):
            w += h[i : len(h) - words + 1 + i] * _POWERS[words - i]
        w += _LENGTHS[words]
        whole = np.flatnonzero(per >= words)
        n = size[whole]
        # A text's shingles lie together at its first word and go together to its place.
        move = np.repeat(first[whole] - (ends[whole] - n), n)
        at = np.flatnonzero(np.repeat(per >= words, size))
        x[at] = w[at + move]
    for m in range(1, words):  # texts of m words: all of them are one shingle
        for_m = np.flatnonzero(per == m)
        if len(for_m):
            x[ends[for_m] - 1] = sum((h[first[for_m] + i] * _POWERS[m - i] for i in range(1, m)), h[first[for_m]] * _POWERS[m]) + _LENGTHS[m]
    _mix(x)
    a = 0
    for b in ends.tolist():
        x[a:b].sort()
        a = b
    new = np.ones(len(x), bool)
    if len(x) > 1:
        np.not_equal(x[1:], x[:-1], out=new[1:])
        new[(ends - size)[size > 0]] = True
    count = np.add.reduceat(np.append(new, False), np.append(ends - size, len(x))[:-1]) if len(texts) else size
    return x[new], np.where(size > 0, count, 0).astype(np.int64)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words is one shingle, one without words none."""
    block: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        block.append(t or b"")
        size += len(block[-1])
        if size >= BLOCK_BYTES or i == len(texts) - 1:
            flat, counts = _block(block, words)
            ends = np.cumsum(counts)
            a = 0
            for b in ends.tolist():
                yield flat[a:b]
                a = b
            block, size = [], 0


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of one text."""
    return next(shingle_sets([text], words))
