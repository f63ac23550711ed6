"""Token counts by a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens), one folder for each tokenizer version: the SHA-256 of its file and of COUNTING, which
names the rules of counting. Documents are known by the SHA-256 of their normalised content. Digests are joined with the
stored counts; the texts of distinct misses alone are encoded and their counts appended; then every document takes its count from the cache.

Texts are read twice: once for their digests and once, if there are misses, for the texts behind them. Copies are dropped inside each task before texts are
shuffled by digest, so a text that makes up a third of the rows moves once for each task; the rest of the work is on digests. An append is one
job, which appears whole or not at all; a digest that two runs append at once is stored twice with the same count and read once.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; strings of special tokens inside a text are handled as the library's default
does (.json: they are one token each; .model: ordinary text); there are no added begin or end tokens; repeated rows are rows of their
own; null and repeated ids are returned as they are; an empty table gives no rows and leaves the cache as it is; other columns are ignored, whatever their names; very long
texts are whole: a row has to fit a task's memory. Normalised content is the text itself (null: empty), as any other form of it could have another count.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import drop, exists, held, join_groups, partitions, scratch, sliced, small, stash

#: Part of the tokenizer's version: to be raised when counting changes.
COUNTING = b"whole text, no added tokens, 1"
#: Digests that a task remembers while it drops copies; bytes of text that a task encodes, beyond which there are more tasks than the session's shuffle partitions.
REMEMBERED, TASK_BYTES = 100_000, 64_000_000


def version(path: str) -> str:
    """What stored counts of a tokenizer file are filed under."""
    with open(path, "rb") as f:
        return hashlib.sha256(hashlib.file_digest(f, "sha256").digest() + COUNTING).hexdigest()


def counter(path: str):
    """A function from texts to their numbers of tokens, kept in the worker."""
    if path.endswith(".model"):

        def make():
            from sentencepiece import SentencePieceProcessor

            return SentencePieceProcessor(model_file=path)

        model = held("pieces", path, make)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    tok = bpe.load(path)
    return lambda texts: [len(x) // 4 for x in tok.encode_batch(texts)]


def digest_of(text: Column | str) -> Column:
    """The SHA-256 of the normalised content, never null."""
    return F.coalesce(F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)), F.lit(b""))


def stored(spark, cache: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; a digest once."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _copies_dropped(batches):
    """(digest, text) rows without those that the task has seen among its last digests."""
    import pyarrow as pa

    seen: set = set()
    for b in sliced(batches):
        keep = []
        for i, d in enumerate(b.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield b.take(pa.array(keep, pa.int64()))


def encode_misses(docs: DataFrame, new: DataFrame | None, path: str, text: str, tasks: int) -> DataFrame:
    """digest, n_tokens of each distinct text of docs whose digest is in `new` (a written table; None: of all)."""
    import pyarrow as pa

    texts = docs.select(digest_of(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_copies_dropped, "digest binary, text string")
    if new is not None:
        texts = texts.join(small(new.select("digest")), "digest", "left_semi")
    texts = texts.repartition(tasks, "digest").sortWithinPartitions("digest")

    def run(batches):
        count, last = counter(path), None
        for b in sliced(batches):
            digests, fresh = b.column(0).to_pylist(), []
            for i, d in enumerate(digests):
                if d != last:
                    fresh.append(i)
                    last = d
            n = count(b.column(1).take(pa.array(fresh, pa.int64())).to_pylist()) if fresh else []
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in fresh], pa.binary()), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 1024, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, n_bytes, n_tokens, over_limit: one row for each row of docs. cache: the table of counts, which is made where it isn't there and added to (None: one for this call)."""
    spark = docs.sparkSession
    cache, tokenizer = cache or scratch(spark, "token-counts"), version(path)
    rows = stash(docs.select(F.col(ident).alias("_id"), digest_of(text).alias("digest"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")), "digests")
    groups = stash(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.max("n_bytes").alias("size")), "digest-groups")
    new = stash(groups.select("digest", "size").join(stored(spark, cache, tokenizer), "digest", "left_anti"), "misses")
    misses, size = new.agg(F.count(F.lit(1)), F.sum("size")).first()
    if misses:
        found = encode_misses(docs, None if misses == groups.count() else new, path, text, max(partitions(spark), size // TASK_BYTES))
        found.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = stash(groups.drop("size").join(stored(spark, cache, tokenizer), "digest"), "counted")
    drop(new, groups)
    out = join_groups(rows, counts, ["digest"])
    return out.select(F.col("_id").alias(ident), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
