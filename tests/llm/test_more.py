"""Brute force on parts of the operators, edge cases that their docstrings define, and the pipeline on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from html import parser as html_parser

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.llm import bpe, common, content_sort, html, jaccard, language, lm, packing, quality, queries, shingle, warc
from locusweave.llm.bitslice import top_k

from .test_ops import brute_components, rows_of, shingles, texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_shingle_sets():
    rng = random.Random(1)
    many = [None, b"", b"  ", b"a", b"A b", b"x" * 300 + b" y", b"x" * 300 + b" Y\x0bz", b"a\x00 a", "É ü  x".encode()]
    many += [bytes(rng.choice(b"ab \t\nABC\x00\x1d\x85") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    many.append(b" ".join(b"w%d" % rng.randrange(99) for _ in range(200_000)))
    got, number = list(shingle.shingle_sets(many)), {}
    for t, s in zip(many, got):
        want = shingles(t.decode("latin-1") if t else None)
        assert len(want) == len(s) and (len(s) < 2 or (s[1:] > s[:-1]).all())
        for x in want:
            number[x] = 1
    assert len(np.unique(np.concatenate(got))) == len(number)
    for a, b in (rng.sample(range(len(many) - 1), 2) for _ in range(2000)):
        assert len(np.intersect1d(got[a], got[b])) == len(shingles((many[a] or b"").decode("latin-1")) & shingles((many[b] or b"").decode("latin-1")))


def family(rng, n, base, edits):
    """Near copies of a random set."""
    core = [rng.randrange(1 << 62) for _ in range(base)]
    out = []
    for _ in range(n):
        s = list(core)
        for _ in range(rng.randrange(edits + 1) if base > 5 else 1):
            at = rng.randrange(len(s))
            s[at : at + rng.randrange(6)] = [rng.randrange(1 << 62) for _ in range(rng.randrange(1, 6))]
        out.append(np.unique(np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
@pytest.mark.parametrize("seed", range(6))
def test_prefixes_lose_no_link(monkeypatch, seed, hot):
    """Every two sets that reach the threshold and lie in different components are a candidate, also where shingles are cut into parts."""
    monkeypatch.setattr(jaccard, "HOT_SHINGLE", hot)
    rng = random.Random(seed)
    sets = [s for size in (3, 12, 60, 200) for s in family(rng, 25, size, rng.choice([3, 6, 9]))]
    codes = np.zeros(1 << 16, np.uint8)
    times = np.bincount(np.concatenate([jaccard.slot(s, 16) for s in sets]), minlength=1 << 16)
    codes[times > 1] = np.minimum(1 + 8 * np.log2(times[times > 1]), 255)
    comp = np.array([i if rng.random() < 0.6 else i - i % 5 for i in range(len(sets))])
    rows = []
    for i, s in enumerate(sets):
        p, code, ell = jaccard.prefix(s, codes)
        rows.append((p, code, np.full(len(p), comp[i]), np.full(len(p), len(s)), np.full(len(p), ell), len(s) - 1 - np.arange(len(p)), np.full(len(p), i)))
    s, code, c, n, ell, rest, owner = (np.concatenate(x) for x in zip(*rows))
    n_of, ell_of = {r[6][0]: r[3][0] for r in rows}, {r[6][0]: r[4][0] for r in rows}
    s, owner, rest, home = jaccard.spread(s, code, c, n, ell, rest, owner)
    look = lambda d: np.array([d[i] for i in owner.tolist()])
    a, b, need, times = jaccard.pairs_of(s, comp[owner], look(n_of), rest, look(ell_of), home, most=500)
    got = {(x, y) for x, y, k, t in zip(a.tolist(), b.tolist(), need.tolist(), times.tolist()) if t >= k}
    links = 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        common_ = len(np.intersect1d(sets[i], sets[j]))
        if comp[i] != comp[j] and 100 * common_ >= 80 * (len(sets[i]) + len(sets[j]) - common_):
            links += 1
            assert (min(comp[i], comp[j]), max(comp[i], comp[j])) in got
    assert links > 10


def test_bitmaps_lose_no_link():
    """Bitmaps never differ in more bits than the sets in shingles, whatever the two sizes, so no pair that reaches the threshold is left out."""
    rng = random.Random(3)
    sets = [s for size in (1, 3, 15, 16, 17, 60, 120, 300) for s in family(rng, 12, size, 6)]
    links = left = 0
    for a, b in itertools.combinations(sets, 2):
        both = len(np.intersect1d(a, b))
        differ = jaccard.room(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b))
        assert differ is None or differ <= len(a) + len(b) - 2 * both
        if 100 * both >= 80 * (len(a) + len(b) - both):
            links += 1
            assert differ is not None
        left += differ is None
    assert links > 50 and left > 1000


def test_jaccard_of_large_families(spark, monkeypatch):
    """Rounds of pivots, blocks of bases and queries, and groups that are broadcast change nothing in the result."""
    for name, value in (("HOT_GROUP", 4), ("QUERY_BLOCK", 3), ("BASE_SHINGLES", 300)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(9)
    rows = []
    for size in (30, 60):
        words = [f"w{rng.randrange(500)}" for _ in range(size)]
        for _ in range(60):
            t = list(words)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(size)] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(3)
    got = {r.doc: (r.n, r.component) for r in jaccard.components_of(df).collect()}
    assert got == brute_components(rows) and 2 < len({c for _, c in got.values()}) < 100


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 5, 6, 7, 8), (None, "a b c d e f", 9, 9, 9, 9)], "doc_id long, text string, _maybe int, _w int, _bits int, doc int")
    got = jaccard.keep_first(df)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.where("doc_id = 1 or doc_id is null").collect()))
    with pytest.raises(ValueError, match="reserved"):
        content_sort.keep_one(df.withColumnRenamed("_w", "_cs_sha"))


def test_content_sort_of_one_id(spark):
    """One id for all rows: the sample of splitters neither holds all rows nor none, and one row stays."""
    df = spark.createDataFrame([(None, "same")] * 3000 + [(7, f"t{i}") for i in range(50)] + [(8, None), (8, "")], "doc_id long, text string").repartition(4)
    got = content_sort.content_groups(df)
    assert got.where("kept").count() == 52 and {r.group_size for r in got.where("doc_id is null").collect()} == {3000}
    assert {r.group_size for r in got.where("doc_id = 8").collect()} == {2}


def test_samples_never_vanish():
    for total in (10, 10**6, 10**12, 10**18):
        for want in (1, 1_000, 20_000):
            share = common.threshold(want, total) / 2**63
            assert share > 0 and (total <= want or abs(share * total / want - 1) < 0.2)


def test_join_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i, i % 7 if i < 50 else 100) for i in range(200)] + [(900, None)], "id long, k int")
    groups = rows.where("k is not null and k <> 3").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    got = sorted(map(tuple, common.join_groups(rows, groups, ["k"]).select("id", "k", "first").collect()))
    assert got == sorted(map(tuple, rows.join(groups, "k", "left").select("id", "k", "first").collect())) and len(got) == 201


def test_packing_pieces_equal_library(spark):
    from tokenizers import Tokenizer

    path, size = queries.tokenizer("word_bpe_49k.json"), 64
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "one two")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, size).collect()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k // size, k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())) for k in range(0, len(ids), size)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= size


class Still(packing.Plan):
    """The index without a solution."""

    def _solve(self):
        pass


def test_packing_finds_every_exact_fill():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.randint(5, 40)
        plan = Still({rng.randint(1, size): rng.randint(1, 3) for _ in range(rng.randint(1, 10))}, size)
        while (there := np.flatnonzero(plan.left).tolist()):
            for gap in range(1, size + 1):
                ways = [t for k in (1, 2, 3) for t in itertools.combinations_with_replacement(there, k) if sum(t) == gap and all(plan.left[x] >= t.count(x) for x in t)]
                got = plan._exact(gap)
                assert (got is None) == (not ways) and (got is None or (len(got) == min(map(len, ways)) and tuple(sorted(got)) in ways))
            x = rng.choice(there)
            plan._use(x, rng.randint(1, int(plan.left[x])))
    assert Still(dict.fromkeys(range(2101, 2300), 1) | {1000: 3}, 4096)._exact(3000) == (1000, 1000, 1000)


def test_lm_columns_equal_sql(spark, tmp_path):
    """What SQL can express of the scores, on the registered query and on a table with odd rows."""
    import duckdb

    sql = r"""
        WITH d AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') w FROM t),
        e AS (SELECT row_number() OVER () AS row, doc_id, list_append(list_filter(w, lambda x: x <> ''), '<end> ') w FROM d),
        k AS (SELECT row, doc_id, unnest(w) word FROM e), h AS (SELECT unnest(?) doc_id, unnest(?) held),
        c AS (SELECT word, count(*) c FROM k LEFT JOIN h USING (doc_id) WHERE NOT coalesce(held, false) GROUP BY word), n AS (SELECT coalesce(sum(c), 0) n, count(*) v FROM c)
        SELECT doc_id, count(*), count(c), any_value(n), sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) FROM k LEFT JOIN c USING (word), n GROUP BY row, doc_id"""
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(3, "one two"), (50, "\u2003 new\x85words <end>"), (51, None)], "doc_id long, text string").repartition(3)
    for docs in (queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"), odd):
        path = str(tmp_path / f"t{docs.count()}")
        docs.coalesce(1).write.parquet(path)
        ids = sorted({r.doc_id for r in docs.collect()})
        con = duckdb.connect()
        con.execute(f"CREATE VIEW t AS SELECT * FROM '{path}/*.parquet'")
        want = sorted(con.execute(sql, [ids, [common.fold_of(i) == 1 for i in ids]]).fetchall())
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score_documents(docs).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])


def test_lm_probabilities_sum_to_one():
    """After any class the probabilities of all words seen, of one unseen word for each spelling class, and of the end, sum to 1."""
    rng = np.random.default_rng(3)
    classes, k = 4, 4 + lm.SHAPES + 1
    n2 = rng.integers(0, 9, (k, k))
    shapes, words = {}, []
    for s in range(lm.SHAPES):
        counts = [1] * int(rng.integers(0, 4))
        shapes[s] = (sum(counts), len(counts), counts.count(1), counts.count(2))
        words += [(classes + s, c) for c in counts]
    for c in range(classes):  # counts inside a class sum to how often it follows something
        words += [(c, int(n2[:, c].sum()) - 2), (c, 2)]
    m = lm.Model(n2, shapes, 1, 1)
    unseen = [(classes + s, 0) for s in range(lm.SHAPES)]
    emit = 10 ** m.emission(*np.array(words + unseen).T)
    per_class = np.bincount([c for c, _ in words + unseen], emit, k)
    per_class[m.end] = 1.0
    assert np.allclose((10**m.step).sum(axis=1), 1) and np.allclose(per_class[:classes], 1) and (per_class <= 1 + 1e-9).all()


def test_lm_weighs_many_as_one():
    rng = np.random.default_rng(5)
    classes, home = 5, 7
    kinds = classes + 4
    n = rng.integers(20, 60, (kinds, kinds)).astype(float)
    rows, cols = n.sum(axis=1), n.sum(axis=0)
    before, after, own = rng.integers(0, 3, (6, kinds)), rng.integers(0, 3, (6, kinds)), rng.integers(0, 2, 6)
    after[2], before[3] = 0, 0
    total = np.maximum(after.sum(axis=1), before.sum(axis=1)) + own
    got = lm.weigh_many(n, rows, cols, classes, np.full(6, home), before, after, own, total)
    for w in range(6):
        m = n.copy()
        m[home] -= after[w]
        m[:, home] -= before[w]
        m[home, home] -= own[w]
        assert np.allclose(got[w], lm.weigh(m, rows, cols, classes, after[w], before[w], own[w], (total[w], total[w])))


def test_warc_rolls_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(50, 900)))) for i in range(300)]
    rows += [(None, None, "n" * 150), (400, "u", "n" * 150), (7, *rows[7][1:]), (7, *rows[7][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = common.scratch(spark, "warc-test")
    warc.write(pages, path, archive_bytes=3_000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").collect()
    assert len(files) > 10 and max(f.length for f in files) < 3_000 + 70_000 and all(bytes(f.content[:4]) == b"\x5d\x2a\x4d\x18" for f in files)
    got = sorted(((r.id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()), key=str)
    want = [(i, len(p), hashlib.sha256(p.encode()).hexdigest(), "revisit" if i is None else "response", 400 if i is None else None) for i, _, p in rows]
    assert got == sorted(want, key=str)
    assert warc.archive(pages.where("false")).count() == 0


def test_topk_odd_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1.0]), (2, [0.5, 0.5, 2.0]), (3, []), (None, [9.0, 9.0]), (4, [0.5, 0.5, 2.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert top_k(df.where("false"), df, 2).count() == 0 == top_k(df, df.where("false"), 2).count()
    twice = df.where("vec_id = 0").unionByName(df.where("vec_id = 0"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, twice, 2).collect())
    assert got == sorted([(0, 1, 1, 65536), (0, 2, 2, 49152)] * 2)  # each query row has its own ranks


def test_language_odd_rows(spark):
    rng = random.Random(2)
    word = {"en": ["the", "house", "which", "thing"], "de": ["der", "haus", "welche", "ding"]}
    say = lambda g, n: " ".join(rng.choice(word[g]) + rng.choice("abcd") for _ in range(n))
    rows = [(i, say(g, 30), g) for i, g in enumerate(["en", "de"] * 60)] + [(200, None, "en"), (201, "", "de"), (202, "123 !?", "en"), (203, say("de", 60_000), None), (204, say("en", 40), None), (204, say("en", 40), None), (None, say("de", 40), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(3)
    model = language.learn(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df, model).collect()]
    by = {i: (g, s) for i, g, s in got}
    assert len(got) == len(rows) and [by[i] for i in (200, 201, 202)] == [("und", 0.0)] * 3 and (by[203][0], by[204][0], by[None][0]) == ("de", "en", "de")
    assert all(0 <= s <= 1 for _, _, s in got) and all(by[i][0] == g for i, _, g in rows[:120])
    kept = language.accept(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert language.identify(df.where("false"), model).count() == 0
    # Ties: equal regression values give the first language in order.
    model.weights, model.bias = model.weights * 0, model.bias * 0
    assert {r.lang_pred for r in language.identify(df, model).collect()} == {"de", "und"}


def test_quality_odd_rows(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdefgh") for _ in range(50)) + "."
    bad = lambda: "$$$ " * 30 + "BUY!!! " * rng.randrange(9)
    rows = [(i, good() if i % 2 else bad()) for i in range(200)] + [(300, None), (301, ""), (302, "x" * 300_000), (302, "x" * 300_000), (None, good())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(300, None), (301, 0), (301, 1), (None, 1), (999, 1)], "doc_id long, quality int")
    trees = quality.learn(df, labels)
    got = quality.score(df, trees).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and by[300] == by[301] and all((by[i] >= 0.5) == (i % 2 == 1) for i in range(200))
    kept = quality.accept(df, trees)
    assert kept.columns == df.columns and kept.count() == sum(r.score >= quality.ACCEPT for r in got)
    assert quality.score(df.where("false"), trees).count() == 0
    # The flattened walk equals one that goes down each tree by itself.
    x = quality.statistics([(t or "").encode() for _, t in rows])
    for row, s in zip(x, trees.score(x)):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-9


class Visible(html_parser.HTMLParser):
    """All words of a page outside scripts and styles, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def page(rng, depth=0):
    tags = ["p", "div", "ul", "ol", "blockquote", "b", "span", "h2", "pre", "section", "em", "style"]
    out = []
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(tags)
        if tag == "style":
            out.append("<style>n{}</style>")
        elif depth < 3 and rng.random() < 0.6:
            inner = page(rng, depth + 1)
            out.append(f"<{tag}>{''.join(f'<li>{x}' for x in [inner, inner[:0] + 'w9'])}</{tag}>" if tag in ("ul", "ol") else f"<{tag}>{inner}</{tag}>")
        else:
            out.append(f" t{rng.randrange(99)} &lt;{rng.randrange(9)} ")
    return "".join(out)


def test_html_words_in_order():
    rng = random.Random(8)
    for _ in range(300):
        p = page(rng)
        v = Visible()
        v.feed(p)
        got = re.sub(r"(?m)^[ ]*(?:(?:\*|\d+\.) +)+", "", html.text_of(p)).split()
        assert got == v.words, p


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"), ("<table><tr><td>漢字<td>x<tr><td>abc<td>y</table>", "漢字  x\nabc   y"),
        ("<div style='visibility:hidden'>n<b style='visibility: visible'>v</b>n</div>z", "v\nz"), ("<svg><title>t</title><text>one</text><text>two</text></svg>", "one two"),
        ("<button>ok</button><label>l", "ok l"), ("a<noscript>n</noscript>b", "anb"), ("<object>fall</object>x", "fall x"), ("<math><mi>x</mi><annotation>q</annotation></math>", "x"),
        ("<input type=email value='a@b'><input type=password value=s><input placeholder=name>", "a@b name"), ("<table><tr><td colspan=2>w<td>e<tr><td>1<td>2<td>3</table>", "w     e\n1  2  3"),
        ("<table><tbody><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
    ],
)
def test_html_layout(page, want):
    assert html.text_of(page) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, doc_id long, text string")
    assert html.extract(none).count() == 0 and bpe.digests(none, queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_bpe_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5_000)
    tok = bpe.Bpe(queries.tokenizer("byte_bpe_50k.json"))
    for i in range(40):
        tok.encode_batch([" ".join(f"w{i}x{k}" for k in range(50)) + " " + "y" * 5_000])
    assert max(sum(len(p) + len(x) + bpe.ENTRY_BYTES for p, x in c.items()) for c in (tok.cache, tok.older)) < 5_000 + 70 * (bpe.ENTRY_BYTES + 50)
    assert max(map(len, tok.cache)) <= bpe.LONGEST_PIECE


def test_settings_stay(spark):
    """No query changes a setting of the session."""
    before = dict(spark.conf.getAll)
    for name, q in queries.QUERIES.items():
        q(spark, "/root/testdata/sf0.001").count()
        after = {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"}
        assert after == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}, name


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return ""

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Session(), "x")


def test_pipeline_odd_tables(spark, tmp_path):
    """Null, empty and repeated rows, extra and clashing columns, and an empty table; the last stage against a plain tokenizer."""
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    odd = docs.unionByName(docs.limit(20)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(3).withColumn("text", F.lit("")))
    odd = odd.withColumn("_maybe", F.lit(1)).withColumn("component", F.lit("c")).withColumn("_part", F.lit(2)).withColumn("score", F.lit(0.1))
    for name, rows in (("odd", odd), ("empty", odd.where("false"))):
        at = str(tmp_path / name)
        rows.write.parquet(f"{at}/documents.parquet")
        queries.table(spark, sf, "labels").write.parquet(f"{at}/labels.parquet")
        stage = spark.read.parquet(f"{at}/documents.parquet")
        for title, f in cp.STAGES[:-1]:
            out = f(spark, stage, at).cache()
            assert out.columns == rows.columns and out.count() <= stage.count(), title
            stage = out
        kept = stage.select("doc_id", "text").collect()
        assert (len(kept) > 50 if name == "odd" else not kept) and all(t for _, t in kept) and len({t for _, t in kept}) == len(kept)
        got = cp.run(spark, at).collect()
        tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
        tok.no_truncation(), tok.no_padding()
        want = []
        for i, t in kept:
            ids = tok.encode(t, add_special_tokens=False).ids + [1]
            want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
