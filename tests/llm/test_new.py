"""Collocations, hard negatives and token counts against brute force, and the edge cases that their docstrings define."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.llm import collocations as col
from locusweave.llm import grid, queries, token_counts
from locusweave.llm import hard_negatives as hn

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_phrases(docs, least, top):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    out = {}
    for (lang, g), a in cand.items():
        inside = any(l2 == lang and len(h) > len(g) and 100 * b >= 100 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (l2, h), b in cand.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


def random_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "new", "York", "city\x00", "日本", "x" * 300, "'", "-"]
    mark = [" ", "  ", "\t", ". ", ", ", "\n", " \x0b", ";", "\x85", "\xa0"]
    texts = ["".join(rng.choice(words) + rng.choices(mark, [30, 3, 3, 2, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(60))) for _ in range(n)]
    return [(t, rng.choice(["de", "en", "en", None, "und", ""])) for t in texts] + [(None, "de"), ("", None), (" . ,", "fr")]


@pytest.mark.parametrize("setting", [{}, {"PART_BYTES": 50}, {"MOST_KNOWN": 12}, {"collide": 3}])
def test_phrases(spark, monkeypatch, setting):
    """Also with small parts, with frequent grams in many shares, and with hashes that collide."""
    docs = random_texts(5)
    monkeypatch.setattr(col, "PART_BYTES", setting.get("PART_BYTES", col.PART_BYTES))
    monkeypatch.setattr(col, "MOST_KNOWN", setting.get("MOST_KNOWN", col.MOST_KNOWN))
    df = spark.createDataFrame([(i, t, x, 7) for i, (t, x) in enumerate(docs)], "doc_id long, text string, lang string, phrase int").repartition(3)
    got = {tuple(r) for r in col.collocations(df, least=8, top=9).collect()}
    assert got == brute_phrases(docs, 8, 9) and len(got) > 20


def test_parts_are_exact_where_hashes_collide(monkeypatch):
    texts = [t.encode() for t, _ in random_texts(8) if t]
    langs = [i % 3 for i in range(len(texts))]
    plain = col.pack(texts, langs)
    monkeypatch.setattr(col, "hashes", lambda low, starts, lengths: (lengths % 3).astype(np.uint64))
    bad = col.pack(texts, langs)
    words = lambda p: [None if c < 0 else (p["lang"][c], p["words"][c]) for c in p["codes"].tolist()]
    assert words(plain) == words(bad)
    rows = np.array([[1, 2], [1, 3], [1, 2], [4, 4]])
    got, n = col.distinct_grams(np.zeros(4, np.uint64), rows)
    assert dict(zip(map(tuple, got.tolist()), n.tolist())) == {(1, 2): 2, (1, 3): 1, (4, 4): 1}


def test_phrases_of_odd_tables(spark):
    assert col.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert col.collocations(spark.createDataFrame([(1, None, None), (2, "a b", None)], "doc_id long, text string, lang string")).count() == 0
    one = spark.createDataFrame([(1, "a b " * 300_000 + ". " + "A b " * 300_000, None)], "doc_id long, text string, lang string")
    got = col.collocations(one).collect()
    assert [(r["phrase"], r["a"]) for r in got if r["phrase"] == "a b a b a"] == [("a b a b a", 599_996)] and all(r["n"] == 1_200_000 for r in got)


def brute_negatives(rows, positives, negatives):
    """rows: (id, label, anchor, vector or None)."""
    ok = [(i, lab, a, [math.floor(256 * x) for x in v]) for i, lab, a, v in rows if i is not None and lab is not None and v and all(x is not None and abs(x) < math.inf for x in v)]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    out = []
    for i, lab, anchor, v in ok:
        if anchor:
            others = sorted([(-dot(v, w), j, lb) for j, lb, _, w in ok if j != i])
            for s, j, _ in [x for x in others if x[2] == lab][:positives]:
                fits = [x for x in others if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
                out += [(i, j, k, m, -s, -t) for k, (t, m, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "ties", "huge", "labels"])
def test_hard_negatives(spark, monkeypatch, kind):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hn, "CHUNK", 7)
    rng = random.Random(kind)
    rows = []
    for i in range(300):
        v = [float(np.float32(rng.gauss(0.1, 0.3))) for _ in range(6)]
        if kind == "ties":
            v = [rng.choice([0.0, 0.25]) for _ in range(4)]
        if kind == "huge":
            v = [x * 1e7 for x in v]
        rows.append((i // 2 * 2 if kind == "ties" else i, None if i % 41 == 0 else rng.randrange(200 if kind == "labels" else 3), i % 10 == 3, v))
    rows += [(900, 1, True, None), (901, 1, True, []), (902, 1, True, [0.5, None]), (903, 1, True, [0.5, float("nan")]), (904, 2, True, [1.0]), (None, 1, True, [1.0] * 6), (905, 2, True, [0.0] * 9), (906, 1, True, [-0.5] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, a boolean, embedding array<double>, _row int").repartition(3)
    got = sorted(tuple(r) for r in hn.hard_negatives(df, F.col("a")).collect())
    assert got == brute_negatives(rows, 5, 3)
    assert len(got) > (5 if kind == "labels" else 50)


def test_hard_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.hard_negatives(empty, F.col("vec_id") % 2 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hn.hard_negatives(alone, F.col("vec_id") % 2 == 0).count() == 0


def test_intervals_drop_rows_early():
    """Fewer and fewer rows are open, and none that qualifies is lost."""
    rng = np.random.default_rng(2)
    v = rng.integers(-200, 200, (500, 32))
    planes, seen = hn.Planes.of(v), []

    def still(i, p, low, high):
        t = hn.kth_highest(p, 5)
        seen.append(len(p))
        return p + high >= t + low

    [(rows, scores)] = hn.narrowed(planes, v[:1], [np.arange(1, 500)], still)
    assert seen[0] == 499 and seen[-1] < 100 and (scores == v[rows] @ v[0]).all()
    assert [r for r, _ in hn.best_rows(rows, scores, 5)] == (1 + np.argsort(-(v[1:] @ v[0]), kind="stable")[:5]).tolist()


@pytest.mark.parametrize("blocks,chunks", [(1, 1), (13, 5), (61_000, 19_500), (2_000_000, 700_000), (5, 900)])
def test_grid_moves_few_bytes(blocks, chunks):
    """Both sides move about sqrt(cells) times their bytes, where one of them isn't too small for that; a cell has a bounded number of pairs."""
    r, a = grid.shape(blocks, chunks, 262_144, 131_072, 6)
    assert 1 <= r <= blocks and 1 <= a <= chunks and blocks / r * chunks / a <= 3 * grid.CELL_PAIRS
    if min(blocks, chunks) > 10_000:
        moved, cells = blocks * a * 262_144 + chunks * r * 131_072, blocks * chunks / grid.CELL_PAIRS
        assert moved < 4 * math.sqrt(cells * blocks * 262_144 * chunks * 131_072)


def library_counts(texts, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return path, [len(SentencePieceProcessor(model_file=path).encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    return path, [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    texts = [None, "", " ", "Hello  world\n\n", "<|endoftext|> and <s> x</s>", "naïve 日本語 \U0001f600", "x" * 5000, "word " * 400_000, "Hello  world\n\n", "same", "same", "same"]
    path, want = library_counts(texts, name)
    df = spark.createDataFrame([(i if i != 3 else None, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, digest binary").repartition(3)
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, path).collect()}
    assert got == {(i if i != 3 else None, len((t or "").encode()), n, n > 1024) for i, (t, n) in enumerate(zip(texts, want))}


def test_only_misses_are_encoded(spark, tmp_path, monkeypatch):
    import public_tokenizers

    path, other, cache = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    one = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "c"), (5, "d d d"), (6, "d d d"), (7, None)], "doc_id long, text string")
    stored = lambda: sorted((r["tokenizer"], r["n_tokens"]) for r in spark.read.parquet(cache).collect())
    first = sorted(token_counts.count_tokens(one, path, cache).collect())
    assert len(stored()) == 2
    asked, real = [], token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda docs, new, *a: asked.append(new and new.count()) or real(docs, new, *a))
    assert sorted(token_counts.count_tokens(one, path, cache).collect()) == first and asked == [] and len(stored()) == 2
    got = sorted(tuple(r)[:3] for r in token_counts.count_tokens(two, path, cache).collect())
    assert got == [(4, 1, 1), (5, 5, 3), (6, 5, 3), (7, 0, 0)] and asked == [2] and len(stored()) == 4
    assert token_counts.count_tokens(one, other, cache).count() == 3 and len(stored()) == 6  # another tokenizer has counts of its own
    assert token_counts.count_tokens(one.where("false"), path, cache).count() == 0 and len(stored()) == 6


def test_new_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["op13_token_counts"](spark, sf).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert queries.QUERIES["op12_hard_negatives"](spark, sf).dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert [t for _, t in queries.QUERIES["op11_collocations"](spark, sf).dtypes] == ["string", "bigint", "string", *["bigint"] * 5]


def test_sums_hold_a_bounded_number(monkeypatch):
    monkeypatch.setattr(col, "SUMMED_HASHES", 50)
    rng = np.random.default_rng(1)
    found = [(np.unique(rng.integers(0, 120, 30)).astype(np.uint64),) for _ in range(40)]
    want = Counter(x for (h,) in found for x in h.tolist())
    got, parts = Counter(), list(col.sums((h, np.ones(len(h), np.int32)) for h, in found))
    for h, n in parts:
        assert len(h) <= 130 and len(set(h.tolist())) == len(h)
        got.update(dict(zip(h.tolist(), n.tolist())))
    assert got == want and len(parts) > 1


def lines_run(page):
    """Lines of the HTML module that run for a page."""
    import sys

    from locusweave.llm import html

    n, name = 0, html.__file__

    def count(frame, event, arg):
        nonlocal n
        if frame.f_code.co_filename != name:
            return None
        n += event == "line"
        return count

    sys.settrace(count)
    try:
        html.text_of(page)
    finally:
        sys.settrace(None)
    return n


@pytest.mark.parametrize("page", [lambda n: "<p><button>" + "<div>" * n, lambda n: "<ul><li>" + "<b>" * n + "<p>" * n, lambda n: "<table><tr>" + "<td rowspan=0>x" * n + "<tr>" * n, lambda n: "<ul><li>x" * n, lambda n: "<table><tr><td>y" * n, lambda n: "<i>" * n + "</b>" * n + "</i>" * n])
def test_html_steps_grow_with_the_page(page):
    few, many = lines_run(page(1500)), lines_run(page(3000))
    assert few > 1500 and many < 2.3 * few


def test_html_last_declaration_counts():
    from locusweave.llm import html

    shown = lambda style: html.text_of(f'<p style="{style}">a')
    assert [shown(x) for x in ("display:none;display:block", "display:block;display:none", "display:none !important;display:block", "DISPLAY : none", "visibility:hidden;visibility:visible", "visibility:hidden")] == ["a", "", "", "", "a", ""]
    assert html.text_of("<table><tr><td>" * 40 + "deep" + "</table>" * 40 + "end").split() == ["deep", "end"]


def test_samples_of_repeated_rows(spark, monkeypatch):
    from locusweave.llm import common, language, quality, warc

    docs = spark.createDataFrame([(1, "el perro come la carne en la casa", "es")], "doc_id long, text string, lang string").crossJoin(spark.range(9_000)).drop("id")
    model = language.learn(docs)
    assert model.langs == ["es"] and language.identify(docs.limit(3), model).first()["lang_pred"] == "es"
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int").crossJoin(spark.range(9_000)).drop("id")
    asked = []
    monkeypatch.setattr(quality, "fit", lambda x, y: asked.append(len(y)))
    quality.learn(docs, labels)
    assert asked == [1]
    pages = spark.createDataFrame([("x" * 3000,)], "html string").crossJoin(spark.range(500)).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), "html")
    assert isinstance(warc.dictionary_of(pages, "page_id", "html", "url"), bytes)
    # Between nothing and everything: about nine tenths of what is wanted, and never more than that.
    many = spark.range(50_000).select((F.col("id") % 20_000).alias("k"))
    n = common.sampled(many, 1_000, "k", seed=1).select("_sample").distinct().count()
    assert 700 < n <= 1_000
    assert common.sampled(many, 30_000, "k", seed=1).count() == 50_000


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from locusweave.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    real = bpe.words_of

    def colliding(texts):
        h, per, low, starts, lengths = real(texts)
        return h % np.uint64(7), per, low, starts, lengths

    monkeypatch.setattr(bpe, "words_of", colliding)
    tok, lib = bpe.Bpe(path), Tokenizer.from_file(path)
    for texts in (["some words here"], ["other words there", "and more of them again and again"], ["x"], ["some words"]):
        want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert tok.encode_batch(texts) == want


def test_language_kernel_and_regression_plainly():
    """Kernel, landmarks and ridge regression of a few short texts against loops over their n-grams."""
    from locusweave.llm import language

    texts = {"de": ["der hund und die katze", "das haus und der baum", "die frau und das kind"], "en": ["the dog and the cat", "the house and the tree", "a woman and the child"]}
    rows = [(lang, t) for lang, ts in texts.items() for t in ts]

    def sets(text):
        codes, owner = language.grams([text.encode()])
        return {n: np.unique(codes[n][language._inside(codes[n], n)]).astype(np.int32) for n in language.ORDERS}

    model = language.Kernel([sets(t) for _, t in rows], [lang for lang, _ in rows])
    vocab = {n: [c for c, k in Counter(c for _, t in rows for c in sets(t)[n].tolist()).items() if k >= 2] for n in language.ORDERS}
    have = lambda t, n: set(sets(t)[n].tolist()) & set(vocab[n])

    def kernel(a, b):
        return sum(len(have(a, n) & have(b, n)) / math.sqrt(max(1, len(have(a, n))) * max(1, len(have(b, n)))) for n in language.ORDERS) / len(language.ORDERS)

    marks = [t for pair in zip(texts["de"], texts["en"]) for t in pair]
    kmm = np.array([[kernel(a, b) for b in marks] for a in marks])
    val, vec = np.linalg.eigh(kmm)
    root = vec[:, val > 1e-6 * val.max()] / np.sqrt(val[val > 1e-6 * val.max()])
    a = np.array([[*(np.array([kernel(t, m) for m in marks]) @ root), 1.0] for _, t in rows])
    for j, lang in enumerate(("de", "en")):
        y = np.array([1.0 if g == lang else -1.0 for g, _ in rows])
        w = np.linalg.solve(a.T @ a + language.RIDGE * np.eye(a.shape[1]), a.T @ y)
        for text in ("der baum", "the tree and a cat"):
            f = np.array([*(np.array([kernel(text, m) for m in marks]) @ root), 1.0]) @ w
            got = model.predict([text])
            if got[0] == [lang]:
                assert abs(got[1][0] - min(1, max(0, (f + 1) / 2))) < 2e-3
    assert model.predict(["der baum", "the tree and a cat", "1 2", ""])[0] == ["de", "en", "und", "und"]
