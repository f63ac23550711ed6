"""The training-data operators: brute force on small tables that hold nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from locusweave.llm import content_sort, html, jaccard, language, lm, packing, quality, queries, warc
from locusweave.llm.bitslice import top_k
from locusweave.llm.bpe import digests

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc int, n string, _part string, component string"


def texts():
    rng = random.Random(5)
    out = [None, "", "   ", "one two", "One TWO", "x" * 3000]
    long = [" ".join(rng.choice(BASE) + str(rng.randrange(40)) for _ in range(n)) for n in (40, 60, 90, 4000)]
    for t in long:
        words = t.split()
        out += [t, t, t.upper(), " ".join(words[:-2] + ["new", "end"]), " ".join(words[: len(words) // 2])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i + 1, t, ("en", "de", None)[i % 3], None, None, 1, "n", "p", "c") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[7]], SCHEMA).repartition(5)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(docs):
    want = brute_components(rows_of(docs))
    got = {r.doc: (r.n, r.component) for r in jaccard.components_of(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("buckets", [1, 7])
def test_content_sort(docs, keep, buckets):
    pick = max if keep == "largest" else min
    rows = rows_of(docs)
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    got = content_sort.content_groups(docs, keep=keep, buckets=buckets).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted((i, pick(ids[t or ""]), len(ids[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sum(r.kept for r in got) == len(ids)
    one = content_sort.keep_one(docs, keep=keep, buckets=buckets)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(map(pick, ids.values()))


def test_topk(spark):
    rng = random.Random(2)
    v = [(i, [rng.choice([-0.5, 0.1, 0.25, 1.0]) for _ in range(8)]) for i in range(120)] + [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    q = {i: [int(256 * x // 1) for x in e] for i, e in v[:120]}
    want = []
    for a in (0, 50, 100):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:5]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    # The float 0.1 isn't the double 0.1, but both have the same floor.
    assert got == sorted(want)


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    for r in digests(docs, path).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing(docs):
    got = packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), 512).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 512
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 512) + 2 and {r.doc_id for r in got} == {i for i, _ in rows_of(docs)}


def test_plan_prefers_exact_fills():
    plan = packing.Plan({7: 1, 3: 1, 5: 1, 4: 1, 1: 1}, 10).patterns
    assert sum(n for _, n in plan) == 2 and all(sum(x) <= 10 for x, _ in plan)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<b>a</b>b  c\n d", "ab c d"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>t", "* x\n* y\n  3. z\n\nt"), ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<div hidden>n</div><p style='color:red; display: none'>n</p><script>if (a<b) '</p>'</script><title>t</title>v", "v"), ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<div>a</span></div></p>b", "a\n\nb"), ("<!-- x -->a<!doctype html>b", "ab"), ("1 < 2 <", "1 < 2 <"), ("<details><summary>s</summary>n</details>", "s"),
        ("<table><tr><td>a<table><tr><td>in</table><td>z</table>", "a   z\n\nin") , ("<head><meta x>seen", "seen"), ("<select><option>a<option>b</select>", "a\nb"),
    ],
)
def test_html(page, want):
    assert html.text_of(page) == want


def test_html_table_and_depth(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, "y"), (2, "<div>" * 30000 + "deep", "z")], "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in html.extract(df).collect()) == [("1", "a"), ("1", "a"), ("2", "deep"), ("None", "")]
    words = re.findall(r"\w+", html.text_of("<table><tr><td>one<td><p>two<p>three</table><ul><li>four<table><td>five</table></ul>six"))
    assert sorted(words) == sorted("one two three four five six".split())


def test_warc(spark):
    pages = spark.createDataFrame([(5, "u", "a" * 200), (2, "u", "a" * 200), (3, None, None), (4, "v", "short"), (6, "v", "short"), (7, "w", "ß" * 60)], "page_id long, url string, html string")
    got = {r.id: (r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {5: (200, sha("a" * 200), "revisit", 2), 2: (200, sha("a" * 200), "response", None), 3: (0, sha(""), "response", None), 4: (5, sha("short"), "response", None), 6: (5, sha("short"), "response", None), 7: (120, sha("ß" * 60), "response", None)}


def test_language_and_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d = queries.table(spark, sf, "documents")
    got = queries.op2_language_id(spark, sf).join(d.where("lang is not null"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0
    q = queries.op8_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out and quality is not null")
    assert q.where("predicted = quality").count() >= 0.85 * q.count() > 0


def test_lm_beats_base(spark):
    got = queries.op7_lm_scoring(spark, "/root/testdata/sf0.001").agg(F.sum(F.when(F.col("held_out"), F.col("score"))), F.sum(F.when(F.col("held_out"), F.col("base_score"))), F.min("n_tokens")).first()
    assert got[0] > got[1] and got[2] >= 1


def test_odd_tables(spark, docs):
    """Empty and untrained tables give empty or defined results."""
    none, labels = docs.where("false"), spark.createDataFrame([], "doc_id long, quality int")
    assert [jaccard.components_of(none).count(), content_sort.content_groups(none).count(), lm.score_documents(none).count()] == [0, 0, 0]
    assert packing.pack(none, queries.tokenizer("word_bpe_49k.json")).count() == 0
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels)).collect()} == {0.5}
    assert {r.lang_pred for r in language.identify(docs, language.learn(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert lm.score_documents(docs).count() == docs.count()


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    at = docs
    for name, stage in cp.STAGES[:-1]:
        before, at = at, stage(spark, at, sf).cache()
        assert at.columns == docs.columns and 0 < at.count() <= before.count(), name
    kept = at.select("doc_id", "text").collect()
    assert len({t for _, t in kept}) == len(kept) and all(i == c for i, (_, c) in brute_components(kept).items())
    out = cp.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == {i for i, _ in kept}


def test_lm_clusters_all_words(spark):
    """Words beyond the head get the class of their neighbourhood, and the exchange ends where no move raises the likelihood, summed directly."""
    import numpy as np

    rng = random.Random(4)
    kinds = [[f"{c}{i}x" for i in range(700)] for c in "ab"]
    pairs = list(zip(*(rng.sample(9 * k, 9 * len(k)) for k in kinds)))
    df = spark.createDataFrame([(i, " ".join(w for p in pairs[i::60] for w in p) + f" once{i}") for i in range(60)], "doc_id long, text string").repartition(3)
    parts = lm.chunks(df, "doc_id", "text", 5, 1)
    classed, n_classes, shapes, tokens, distinct = lm.clustered(parts)
    of = {}
    for r in classed.join(parts.select("chunk", "words"), "chunk").collect():
        for w, c, k in zip(np.frombuffer(r.words, np.int64).tolist(), lm.expand(r.c, np.int64).tolist(), lm.expand(r["class"], np.int16).tolist()):
            assert of.setdefault(w, (c, k)) == (c, k)
    from xxhash import xxh3_64_intdigest

    hashed = lambda w: int(np.uint64((xxh3_64_intdigest(w.encode()) & ~31) | lm.shape(w.encode())).view(np.int64))
    train = [i for i in range(60) if lm.fold_of(i) != 1]
    want = {}
    for i in train:
        for w in [w for p in pairs[i::60] for w in p] + [f"once{i}"]:
            want[w] = want.get(w, 0) + 1
    assert (tokens, distinct) == (sum(want.values()), len(want)) and {hashed(w): c for w, c in want.items()} == {w: c for w, (c, _) in of.items() if c}
    frequent = [[of[hashed(w)][1] for w in kind if want.get(w, 0) >= lm.MIN_COUNT] for kind in kinds]
    n_frequent = sum(c >= lm.MIN_COUNT for c in want.values())
    assert n_frequent > lm.HEAD + 200 and max(map(max, frequent)) < n_classes
    assert sum(min(kind.count(k) for kind in frequent) for k in range(n_classes)) < 0.02 * n_frequent
    assert sum(x[1] for x in shapes.values()) == len(want) - n_frequent

    t = np.random.default_rng(1).integers(0, 9, (20, 20)).astype(float)
    cls, n = lm.exchange(t, 15, 4)

    def likelihood(cls):
        g = np.zeros((9, 9))
        np.add.at(g, (cls[:, None], cls[None, :]), t)
        return lm.f(g).sum() - lm.f(g.sum(axis=0)).sum() - lm.f(g.sum(axis=1)).sum()

    for w in range(15):
        for k in range(4):
            moved = cls.copy()
            moved[w] = k
            assert likelihood(moved) <= likelihood(cls) + 1e-6


@pytest.mark.parametrize("most", [1e5, 3e6, 2e9])
def test_topk_takes_all_finite_vectors(spark, most):
    """Vectors with large components are candidates, and queries where the scores fit a long."""
    rng = random.Random(3)
    v = [(i, [rng.choice([-0.5, 0.25, 1.0]) for _ in range(8)]) for i in range(60)] + [(100 + i, [rng.choice([-most, most]) if rng.random() < 0.3 else 0.25 for _ in range(8)]) for i in range(7)]
    v += [(150, [most * 1.0] * 4 + [0.5] * 4), (151, [-most] * 4 + [0.5] * 4), (152, [float("inf")] * 8), (153, [float("nan")] + [most] * 7)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id in (0, 50, 150)" if most < 1e9 else "vec_id in (0, 50)"), 5).collect())
    q = {i: [int(256 * x // 1) for x in e] for i, e in v[:-2]}
    want = []
    for a in (0, 50, 150) if most < 1e9 else (0, 50):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:5]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert got == sorted(want)


def test_topk_sums_beyond_a_long(spark):
    """Scores beyond a long below the k best do no harm; among the k best they are an error."""
    df = spark.createDataFrame([(0, [1e9, 1.0]), (1, [-1e9, 1.0]), (2, [0.5, 1e9]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>").coalesce(1)
    got = top_k(df, df.where("vec_id = 0"), 2).collect()
    q = [256 * 10**9, 256]
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 2, q[0] * 128 + q[1] * q[0]), (2, 3, q[1] * 512)]
    with pytest.raises(Exception, match="doesn't fit a long"):
        top_k(df, df.where("vec_id = 0"), 3).collect()


def test_components_end_only_when_nothing_changes(spark, monkeypatch):
    from locusweave.llm import components

    monkeypatch.setattr(components, "ROUNDS", 1, raising=False)  # a bound on the rounds must not cut the work
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert sorted((r.id, r.component) for r in components.components(links).collect()) == [(i, 0) for i in range(31)]
