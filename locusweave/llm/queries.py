"""The queries of this subpackage: thin calls of its operators that give the columns of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

SIZE = 4096


def tokenizer(name: str) -> str:
    """Where a public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitslice import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), SIZE)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .content_sort import content_groups

    return content_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_topk_search, op3_bpe, op6_packing, op9_exact_dedup, op10_warc)}

ORACLE_SQL = {
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT a.vec_id query_id, b.vec_id vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size, doc_id = max(doc_id) OVER w kept, sha256(coalesce(text, '')) text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) payload_bytes, sha256(html) payload_digest, min(page_id) OVER (PARTITION BY html) first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END refers_to FROM d""",
}


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn

    docs = table(spark, sf_dir, "documents")
    got = identify(docs, learn(docs))
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import ACCEPT, learn, score

    docs = table(spark, sf_dir, "documents")
    got = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


QUERIES |= {f.__name__: f for f in (op2_language_id, op8_quality)}


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op7_lm_scoring,)}


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import components_of

    got = components_of(table(spark, sf_dir, "documents"))
    return got.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES |= {f.__name__: f for f in (op4_ngram_jaccard,)}


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES |= {f.__name__: f for f in (op5_html,)}


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES |= {f.__name__: f for f in (op13_token_counts,)}


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES |= {f.__name__: f for f in (op12_hard_negatives,)}

ORACLE_SQL["op12_hard_negatives"] = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) q
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
               AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT a.vec_id anchor_id, b.vec_id vec_id, a.label = b.label same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.*, s.vec_id negative_id, s.score negative_score,
                 CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) rank
          FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op11_collocations,)}

ORACLE_SQL["op11_collocations"] = r"""
    WITH d AS (SELECT coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) piece FROM d),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') ws FROM p),
    n AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) n FROM w GROUP BY lang),
    g AS (SELECT lang, k, unnest(list_transform(range(1, CAST(len(ws) - k + 2 AS BIGINT)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) phrase
          FROM w, unnest(range(1, 6)) r(k) WHERE len(ws) >= k),
    f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) a FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, k, phrase, a FROM f WHERE k >= 2),
    inner_ AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') phrase, max(a) b FROM c, unnest(range(2, 5)) s(m), unnest(range(1, 5)) t(i)
               WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
    kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE inner_.b IS NULL OR 100 * inner_.b < 100 * c.a),
    cuts AS (SELECT kept.*, i, array_to_string(string_split(phrase, ' ')[1:i], ' ') fst, array_to_string(string_split(phrase, ' ')[i + 1:], ' ') rst FROM kept, unnest(range(1, 5)) t(i) WHERE i < k),
    s AS (SELECT cuts.lang, cuts.phrase, cuts.a, i, x.a l, y.a r, n.n, 1000 * cuts.a * n.n // (x.a * y.a) score
          FROM cuts JOIN f x ON cuts.lang = x.lang AND fst = x.phrase JOIN f y ON cuts.lang = y.lang AND rst = y.phrase JOIN n ON cuts.lang = n.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank" FROM b)
    SELECT lang, CAST("rank" AS BIGINT) AS "rank", phrase, CAST(a AS BIGINT) a, CAST(l AS BIGINT) l, CAST(r AS BIGINT) r, CAST(n AS BIGINT) n, CAST(score AS BIGINT) score FROM t WHERE "rank" <= 2000"""
