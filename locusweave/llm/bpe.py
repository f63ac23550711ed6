"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the pairs of neighbours become 64-bit keys, a binary
search over the sorted keys of the merge table finds their ranks, every word's lowest rank is taken, and all
non-overlapping occurrences of that pair in every word are merged at once. Words without a pair left are done.

Words are found by the split pattern of the tokenizer file. A text is first cut where a cut is always a word border, and
the ids of each piece are kept in a bounded cache, so a piece that occurs often is merged once.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; the strings of
special tokens inside a text become their ids, as the tokenizers library does; ids outside the vocabulary are skipped in
decoding; bytes that are no UTF-8 decode to U+FFFD; repeated rows are encoded each and keep their ids, null ones too; an empty
table gives an empty result; other columns are ignored, whatever their names; very long texts are whole: a row has to fit a task's memory.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from functools import cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import held, sliced
from .shingle import words_of

#: Bytes that the cache of one worker holds in each of its two generations; what an entry takes beside its letters and ids; letters of the longest piece that is kept.
CACHE_BYTES, ENTRY_BYTES, LONGEST_PIECE = 48_000_000, 150, 200
#: Words that are known by their hash before all are forgotten (some 60 MB); text bytes of a block that is encoded by hashes.
KNOWN_WORDS, BLOCK_BYTES = 400_000, 1_000_000
#: The split patterns of the two tokenizer kinds, written with the Unicode White_Space property.
SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
BARE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE tokenizer read from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.spaced = not spec.get("normalizer")
        letters = byte_letters()
        self.base = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(letters[b] + self.suffix, -1) for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        back = {c: b for b, c in letters.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            end = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: len(token) - len(self.suffix)] if end else token
            self.bytes[i] = bytes(back[c] for c in body) + (b" " if end else b"")
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.words = regex.compile(SPACED_WORDS if self.spaced else BARE_WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = 0
        self.marks: dict[str, bytes] = {}
        self._forget_words()
        self.path = path

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is none) and merged id of each pair, by binary search over the sorted pair keys."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], NONE), self.made[at]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit bytes."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        sym = self.base[flat]
        if self.suffix:
            sym[ends[lengths > 0] - 1] = self.last[flat[ends[lengths > 0] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        # rank[i], made[i]: of the pair that begins at symbol i; NONE at the last symbol of a word.
        rank, made = self._ranks(sym, np.append(sym[1:], 0)) if len(sym) else (sym, sym)
        rank[(ends - 1)[lengths > 0]] = NONE
        while len(sym):
            first = np.append(True, word[1:] != word[:-1])
            starts = np.flatnonzero(first)
            best = np.minimum.reduceat(rank, starts)
            best = best[np.cumsum(first) - 1]
            live = best < NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, made, best = sym[live], word[live], rank[live], made[live], best[live]
                if not len(sym):
                    break
            # Of overlapping hits (aaa) every second one from the left counts.
            idx = np.flatnonzero(rank == best)
            if len(idx) > 1 and (near := np.diff(idx) == 1).any():
                begins = np.flatnonzero(np.append(True, ~near))
                place = np.arange(len(idx)) - np.repeat(begins, np.diff(np.append(begins, len(idx))))
                idx = idx[place % 2 == 0]
            sym[idx] = made[idx]
            stays = np.ones(len(sym), bool)
            stays[idx + 1] = False
            sym, word, rank, made = sym[stays], word[stays], rank[stays], made[stays]
            # Only pairs next to a merge are new.
            idx = idx - np.arange(len(idx))
            touched = np.zeros(len(sym), bool)
            touched[idx] = True
            touched[idx[idx > 0] - 1] = True
            new = np.flatnonzero(touched)
            rank[new] = NONE
            new = new[new + 1 < len(sym)]
            new = new[word[new] == word[new + 1]]
            rank[new], made[new] = self._ranks(sym[new], sym[new + 1])
        if done_sym:
            sym, word = np.concatenate(done_sym), np.concatenate(done_word)
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        out = sym.astype("<u4").tobytes()
        cuts = (np.searchsorted(word, np.arange(len(words) + 1)) * 4).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def _words(self, piece: str) -> list[str]:
        """Split a piece into the words of the tokenizer's pattern."""
        mark = piece[:1]
        if mark == WORD:
            return [piece[1:]]
        text = piece[1:] if mark == HEAD else " " + piece if self.spaced else piece
        if piece.isalpha():
            return [text]
        if piece[-1:] in CLOSING and piece[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.words.findall(text)

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are not in the cache, which then holds them; a full cache becomes the older generation."""
        if self.cached > CACHE_BYTES:
            self.older, self.cache, self.cached = self.cache, {}, 0
        found = list(map(self.older.get, pieces))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(fresh, self._ids([pieces[i] for i in fresh])):
            found[i] = ids
        if pieces and len(max(pieces, key=len)) > LONGEST_PIECE:
            kept = [(p, x) for p, x in zip(pieces, found) if len(p) <= LONGEST_PIECE]
        else:
            kept = list(zip(pieces, found))
        self.cache.update(kept)
        self.cached += sum(ENTRY_BYTES + len(p) + len(x) for p, x in kept)
        return found

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, without the cache."""
        out, space = [], " " if self.spaced else ""
        for at in range(0, len(pieces), 8_000):
            split = [(space + p,) if p.isalpha() else self._ended(p) or self._words(p) for p in pieces[at : at + 8_000]]
            words = dict.fromkeys(w for w in itertools.chain.from_iterable(split) if type(w) is str)
            ids = dict(zip(words, self.merge([w.encode("utf-8", "replace") for w in words])))
            out += [ids[ws[0]] if len(ws) == 1 and type(ws[0]) is str else b"".join([ids[w] if type(w) is str else w for w in ws]) for ws in split]
        return out

    def _ended(self, piece: str) -> tuple | None:
        """Of a piece that is a known word and a closing mark: the ids of both."""
        if piece[-1:] not in CLOSING or (word := self.cache.get(piece[:-1])) is None or not piece[:-1].isalpha():
            return None
        if (mark := self.marks.get(piece[-1])) is None:
            mark = self.marks[piece[-1]] = self.merge([piece[-1].encode()])[0]
        return word, mark

    def _pieces(self, text: str) -> list[str]:
        """Cut a text without special tokens where a cut is always a word border."""
        plain = text.replace("\n", "").isprintable() and latin(text)
        if not plain and RARE.search(text):
            # Unicode versions differ on letters of newer scripts: there the library itself splits.
            plain = text if self.spaced else self.library.normalizer.normalize_str(text)
            return [WORD + plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        if self.spaced:
            # A single space between two characters that are no spaces begins a word; pieces but the first lack that space.
            if plain and text and "  " not in text and " \n" not in text and "\n " not in text and text[0] != " " != text[-1]:
                parts = text.split(" ")
            else:
                parts = SINGLE_SPACE.split(text)
            parts[0] = HEAD + parts[0]
            return parts
        if plain:
            return text.lower().split()
        return WHITE.split(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str | int]:
        """Pieces of the text, and ids of the special tokens in it."""
        if self.specials is None or not any(s in text for s in self.special):
            return self._pieces(text)
        out: list[str | int] = []
        for part in self.specials.split(text):
            out += [self.special[part]] if part in self.special else self._pieces(part) if part else []
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        if self.spaced:
            return self._encode(texts)
        # Plain texts, whose words are what white space separates, go by the hashes of their words.
        plain = [t is not None and t.replace("\n", "").isprintable() and latin(t) and not any(s in t for s in self.special) for t in texts]
        others = iter(self._encode([t for t, p in zip(texts, plain) if not p]))
        some, size, out = [], 0, []
        for t, p in zip(texts, plain):
            if p:
                some.append(t.lower().encode())
                size += len(t)
                if size > BLOCK_BYTES:
                    out += self._encode_plain(some)
                    some, size = [], 0
        known = iter(out + (self._encode_plain(some) if some else []))
        return [next(known) if p else next(others) for p in plain]

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts by the 64-bit hashes of their words: each distinct word is looked up once, and the ids are put together by array operations.

        A hash stands for a word only where the bytes are the same, inside the block and in what is known by it; else the block goes the other way.
        """
        h, per, low, starts, lengths = words_of(texts)
        distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
        if len(self.place) > KNOWN_WORDS:
            self._forget_words()
        at = np.fromiter((self.place.get(x, -1) for x in distinct.tolist()), np.int64, len(distinct))
        known, rep = np.flatnonzero(at >= 0), first[word]
        spelled = self.word_ends
        if not (same_bytes(low, starts, lengths, low, starts[rep], lengths[rep]) and same_bytes(low, starts[first[known]], lengths[first[known]], self.words_known, spelled[at[known]], spelled[at[known] + 1] - spelled[at[known]])):
            return self._encode([t.decode() for t in texts])
        if len(fresh := np.flatnonzero(at < 0)):
            begin, n = starts[first[fresh]], lengths[first[fresh]]
            new = self._ids([low[i : i + k].tobytes().decode() for i, k in zip(begin.tolist(), n.tolist())])
            have = len(self.ends) - 1
            at[fresh] = np.arange(have, have + len(fresh))
            self.place.update(zip(distinct[fresh].tolist(), range(have, have + len(fresh))))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(x) // 4 for x in new]))
            self.ids = np.append(self.ids, np.frombuffer(b"".join(new), "<u4"))
            self.words_known = np.append(self.words_known, low[spread(begin, n)])
            self.word_ends = np.append(spelled, spelled[-1] + np.cumsum(n))
        begin, n = self.ends[at][word], (self.ends[at + 1] - self.ends[at])[word]
        flat = self.ids[spread(begin, n)].astype("<u4").tobytes()
        total = np.append(0, np.cumsum(n))
        cut = (total[np.append(0, np.cumsum(per))] * 4).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def _forget_words(self) -> None:
        # Words known by their hash: their number; the ids of all of them end to end, and their bytes, with the ends of each.
        self.place: dict[int, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.words_known, self.word_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        """encode_batch() of texts of any kind."""
        out = []
        for at in range(0, len(texts), 256):
            cut = [self.pieces(t or "") for t in texts[at : at + 256]]
            distinct = set().union(*cut)
            have = dict(zip(distinct, map(self.cache.get, distinct)))
            missing = [p for p, ids in have.items() if ids is None]
            if self.special and (known := [p for p in missing if type(p) is int]):
                have.update((p, p.to_bytes(4, "little")) for p in known)
                missing = [p for p in missing if type(p) is str]
            have.update(zip(missing, self.learn(missing)))
            get = have.__getitem__
            out += [b"".join(map(get, ps)) for ps in cut]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids (as little-endian unsigned 32-bit bytes)."""
        n = len(self.bytes)
        return b"".join([self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]).decode("utf-8", "replace")


#: A pair that is never merged; marks of a piece that is one word and of a piece without the leading space; ends of words.
NONE, WORD, HEAD, CLOSING = np.int64(1 << 60), "\0", "\1", (".", ",", ";", ":", "!", "?")
#: Letters outside long-settled blocks, and the mark itself.
RARE = re.compile("[^\x02-\u052f\u2000-\u2064\u2070-\u208e\u20a0-\u20ac\u2190-\u23f3\u3040-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f600-\U0001f640]")
SINGLE_SPACE = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
WHITE = regex.compile(r"\p{White_Space}+")


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs of n items laid end to end."""
    total = np.cumsum(n)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - n), n)


def same_bytes(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, bt: np.ndarray, m: np.ndarray) -> bool:
    """Whether the runs of n bytes in a are those of m bytes in b."""
    return bool((n == m).all() and (a[spread(at, n)] == b[spread(bt, m)]).all())


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def load(path: str) -> Bpe:
    """The tokenizer, kept in the worker."""
    return held("bpe", path, lambda: Bpe(path))


def round_trip(df: DataFrame, path: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, ids (little-endian unsigned 32-bit), decoded text; one row for each input row."""
    import pyarrow as pa

    def run(batches):
        tok = load(path)
        for b in sliced(batches):
            ids = tok.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([tok.decode(x) for x in ids], pa.string())], [ident, "ids", "decoded"])

    src = df.select(ident, text)
    return src.mapInArrow(run, f"`{ident}` {src.schema[0].dataType.simpleString()}, ids binary, decoded string")


def digests(df: DataFrame, path: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, n_tokens, ids_sha256, decoded_sha256: the digests of what round_trip gives, without carrying it."""
    import pyarrow as pa

    def run(batches):
        tok = load(path)
        for b in sliced(batches):
            n, a, d = [], [], []
            for ids in tok.encode_batch(b.column(1).to_pylist()):
                listed = np.frombuffer(ids, "<u4").tolist()
                n.append(len(listed))
                a.append(hashlib.sha256(",".join([tok.decimal[i] for i in listed]).encode()).hexdigest())
                d.append(hashlib.sha256(tok.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [ident, "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(ident, text)
    return src.mapInArrow(run, f"`{ident}` {src.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
