"""WARC archives compressed record by record with an embedded Zstandard dictionary.

Every archive is one file: a leading skippable frame (magic 0x184D2A5D) holds the dictionary, then each record is a Zstandard
frame of its own, so a reader can begin at any record. The dictionary is built once from archived records (about
DICT_RECORDS records, at most DICT_SAMPLE_BYTES bytes, each with the same share of them) and goes into every archive. An archive ends when it has
ARCHIVE_BYTES bytes, so tasks of any size write many archives, and each is read back as one row of bounded size. Spark's text writer
puts them into files on any file system that Spark can reach: its line separator is itself an empty skippable
frame, which every Zstandard reader passes over. The dictionary comes from the file's own first frame.

Records with equal payloads of at least MIN_REVISIT bytes: the one with the smallest id is the response, the others are
revisits without payload that refer to it. Payloads count as equal by SHA-256.

Defined results: a null payload counts as empty; a null url gives an empty target; repeated rows (same id and payload) are all
responses if theirs is the smallest id; null ids sort highest; an empty table writes no archive and gives no records; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_groups, sampled, scratch, sliced, stash

MIN_REVISIT = 100
#: Bytes of an archive, after which the next one begins.
ARCHIVE_BYTES = 16_000_000
#: Bytes of the dictionary; records (in expectation) and bytes of records it is built from at most.
DICT_BYTES, DICT_RECORDS, DICT_SAMPLE_BYTES = 65_536, 1_000, 4_000_000
#: The magic numbers of a dictionary frame, of an empty skippable frame (also as the separator) and of a compressed frame.
DICT_MAGIC, EMPTY_FRAME, ZSTD_MAGIC = 0x184D2A5D, b"P*M\x18\0\0\0\0", 0xFD2FB528
DATE = "2024-01-01T00:00:00Z"


def record(ident, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit without one."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record; ValueError where it is cut or malformed."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record does not end where it should")
    return headers, rest[:n]


def frames(data: bytes):
    """(magic, frame) of each frame: skippable frames by their length, compressed ones as the decompressor finds their end."""
    import zstandard

    at, dictionary = 0, None
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (n,) = struct.unpack_from("<I", data, at + 4)
            if magic == DICT_MAGIC:
                dictionary = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + n])) if n else zstandard.ZstdDecompressor()
            at += 8 + n
        elif magic == ZSTD_MAGIC:
            if dictionary is None:
                raise ValueError("no dictionary frame")
            one = dictionary.decompressobj()
            out = one.decompress(data[at:at + (1 << 16)])
            end = at + (1 << 16)
            while not one.eof and end < len(data):
                out += one.decompress(data[end : end + (1 << 20)])
                end += 1 << 20
            if not one.eof:
                raise ValueError("archive is cut")
            at = min(end, len(data)) - len(one.unused_data)
            yield out
        else:
            raise ValueError(f"no frame at {at}")


def train(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICT_BYTES; empty where the samples are too few."""
    import zstandard

    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, d=8, k=256).as_bytes()
    except zstandard.ZstdError:
        return b""


def decisions(pages: DataFrame, ident: str, payload: str, url: str) -> tuple[DataFrame, DataFrame]:
    """_id, _url, _payload, _digest, _first (the response's id where the record revisits it), and the written table of digests that it reads."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    base = pages.select(F.col(ident).alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"), body.alias("_payload"), F.sha2(body, 256).alias("_digest"))
    # Only digests that occur more than once are joined.
    twice = base.where(F.length("_payload") >= MIN_REVISIT).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    twice = stash(twice, "twice")
    joined = join_groups(base, twice, ["_digest"])
    return joined.withColumn("_first", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first"))), twice


def dictionary_of(pages: DataFrame, ident: str, payload: str, url: str) -> bytes:
    """The dictionary, from DICT_RECORDS distinct payloads at most, picked by a hash; of each the first bytes, the same number of all."""
    share = DICT_SAMPLE_BYTES // DICT_RECORDS
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    some = sampled(pages.select(F.col(ident).alias("i"), F.coalesce(F.col(url), F.lit("")).alias("u"), body.alias("b")), DICT_RECORDS, "b", seed=11)
    cut = some.groupBy("_sample").agg(F.min(F.struct("i", F.substring("u", 1, share).alias("u"), F.substring("b", 1, share).alias("b"))).alias("r"))
    return train([record(r["i"], r["u"], bytes(r["b"]), hashlib.sha256(r["b"]).hexdigest(), None) for _, r in sorted(cut.collect(), key=lambda x: x["_sample"])])


def write(pages: DataFrame, path: str, ident: str = "page_id", payload: str = "html", url: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives to the folder at path."""
    import pyarrow as pa

    made, twice = decisions(pages, ident, payload, url)
    dictionary = dictionary_of(pages, ident, payload, url)

    def run(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        head = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary
        out, size = [], 0
        for b in sliced(batches):
            for row in zip(*(x.to_pylist() for x in b.columns)):
                out.append(c.compress(record(*row)))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(out)], pa.binary())], ["archive"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(out)], pa.binary())], ["archive"])

    archives = made.select("_id", "_url", "_payload", "_digest", "_first").mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", 1).text(path)  # a row is an archive
    drop(twice)


def read(spark, path: str, id_type: str = "long") -> DataFrame:
    """Each record of the archives below path: id, record_type, refers_to, url, digest, payload_bytes, body."""
    import pyarrow as pa

    def run(batches):
        names = ["id", "record_type", "refers_to", "url", "digest", "payload_bytes", "body"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in sliced(batches, 1):
            for data in b.column(0).to_pylist():
                rows, size = [], 0
                for raw in frames(data):
                    h, body = parse(raw)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and (len(body) != int(h["X-Payload-Length"]) or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
                    name = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
                    rows.append((name(h["WARC-Record-ID"]), h["WARC-Type"], name(h.get("WARC-Refers-To")), h["WARC-Target-URI"], digest, int(h["X-Payload-Length"]), body))
                    size += len(body)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    got = files.mapInArrow(run, "id string, record_type string, refers_to string, url string, digest string, payload_bytes long, body binary")
    own = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(id_type)
    return got.withColumn("id", own("id")).withColumn("refers_to", own("refers_to"))


def archive(pages: DataFrame, ident: str = "page_id", payload: str = "html", url: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives into the shared folder and read every record back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, ident, payload, url, archive_bytes)
    return read(spark, path, pages.schema[ident].dataType.simpleString())
