"""Block-gzipped variant text with a position index, as a Spark data source.

Files are in the public block-gzip format (gzip members of at most 64 KB of text, so readers of plain gzip read them too) with the
public binned index beside them (name + ".tbi"). A region is read by its index: the bins and the linear index give ranges of virtual
offsets (place of a block, place in its text), and only those blocks are read and unpacked. Each (file, window of a region) is a partition, whose task opens the index
itself; the driver only lists names. Lines of a window are those whose position lies in it, so none is read twice.

Files are opened through pyarrow's file systems, so paths are local ones or of stores that it knows.
Results: value (a line without its end) and file_name. Headers are left out. A file without an index is an error; contigs are found by name with or without "chr"; an empty
file has no lines.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.variant import CHROM_NAMES
from ..operators.filters import merged_regions
from ..operators.partition import LENGTHS

#: Text of a block; positions of a window, which is a partition of a read.
BLOCK_TEXT, WINDOW = 0xFF00, 16_000_000
#: The empty block that ends a file; head of a block; settings of a VCF index (kind, columns of name, start and end, comment, skipped lines).
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD = struct.Struct("<4BI2BH2BHH")
VCF_LAYOUT = (2, 1, 2, 0, ord("#"), 0)
#: Positions of a window of the linear index as a power of two; levels of bins above such windows.
LINEAR, LEVELS = 14, 5


def number_of(contig: str) -> int | None:
    """1 to 26 of a contig's name, or None."""
    name = contig[3:] if contig[:3].lower() == "chr" else contig
    n = CHROM_NAMES.get(name.upper()) or (int(name) if name.isdecimal() and name.isascii() else 0)
    return n if 1 <= n <= 26 else None


def first_bin(level: int) -> int:
    """The number of a level's first bin: level 0 is one bin for everything, and each level has eight times the bins of the one above."""
    return (8**level - 1) // 7


def bin_at(begin: int, end: int) -> int:
    """The smallest bin that holds all of [begin, end) (0-based)."""
    for level in range(LEVELS, -1, -1):
        shift = LINEAR + 3 * (LEVELS - level)
        if begin >> shift == (end - 1) >> shift:
            return first_bin(level) + (begin >> shift)
    return 0


def bins_over(begin: int, end: int) -> list[int]:
    """All bins that may hold something of [begin, end)."""
    out = []
    for level in range(LEVELS + 1):
        shift = LINEAR + 3 * (LEVELS - level)
        out += range(first_bin(level) + (begin >> shift), first_bin(level) + (end - 1 >> shift) + 1)
    return out


class Index:
    """Bins and linear index of each contig: bins[contig][bin] is a list of (begin, end) virtual offsets, linear[contig] the least offset of each window."""

    def __init__(self) -> None:
        self.bins: dict[str, dict[int, list[list[int]]]] = {}
        self.linear: dict[str, list[int]] = {}

    def add(self, contig: str, pos: int, length: int, begin: int, end: int) -> None:
        """A line at 1-based pos over `length` positions, in the order of the file."""
        chunks = self.bins.setdefault(contig, {}).setdefault(bin_at(pos - 1, pos - 1 + length), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        windows = self.linear.setdefault(contig, [])
        last = pos - 2 + length >> LINEAR
        while len(windows) <= last:
            windows.append(0)
        for w in range(pos - 1 >> LINEAR, last + 1):
            windows[w] = windows[w] or begin + 1  # 0: none yet; stored one too high until packed

    def pack(self) -> bytes:
        names = b"".join(x.encode() + b"\0" for x in self.bins)
        out = [b"TBI\1", struct.pack("<8i", len(self.bins), *VCF_LAYOUT, len(names)), names]
        for contig, bins in self.bins.items():
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)))
                out += [struct.pack("<2Q", *c) for c in chunks]
            least, windows = 0, []
            for x in self.linear[contig]:
                least = x - 1 if x else least
                windows.append(least)
            out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
        return b"".join(out)

    @classmethod
    def unpack(cls, data: bytes) -> Index:
        self, at = cls(), 36
        if data[:4] != b"TBI\1":
            raise ValueError("not a position index")
        n, size = struct.unpack_from("<i", data, 4)[0], struct.unpack_from("<i", data, 32)[0]
        names = data[at : at + size].split(b"\0")[:n]
        at += size

        def take(kind: str) -> tuple:
            nonlocal at
            got = struct.unpack_from("<" + kind, data, at)
            at += struct.calcsize("<" + kind)
            return got

        for name in names:
            bins: dict[int, list[list[int]]] = {}
            for _ in range(take("i")[0]):
                number, chunks = take("Ii")
                bins[number] = [list(take("2Q")) for _ in range(chunks)]
            (windows,) = take("i")
            self.bins[name.decode()], self.linear[name.decode()] = bins, list(take(f"{windows}Q"))
        return self

    def ranges(self, contig: str, begin: int, end: int) -> list[tuple[int, int]]:
        """Virtual offsets to be read for the 1-based positions begin to end, in order and without overlaps."""
        bins, windows = self.bins[contig], self.linear[contig]
        w = begin - 1 >> LINEAR
        if w >= len(windows):
            return []
        least = windows[w]
        upto = min(end, len(windows) << LINEAR)
        found = sorted((max(a, least), z) for b in bins_over(begin - 1, max(upto, begin)) for a, z in bins.get(b, ()) if z > least)
        out: list[tuple[int, int]] = []
        for a, z in found:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(z, out[-1][1]))
            else:
                out.append((a, z))
        return out


class Writer:
    """Lines into blocks; begin and end of a line are virtual offsets."""

    def __init__(self, out) -> None:
        self.out, self.text, self.place = out, bytearray(), 0

    def line(self, line: bytes) -> tuple[int, int]:
        begin = self.place << 16 | len(self.text)
        self.text += line + b"\n"
        while len(self.text) >= BLOCK_TEXT:
            self.block(BLOCK_TEXT)
        return begin, self.place << 16 | len(self.text)

    def block(self, n: int) -> None:
        text, self.text = bytes(self.text[:n]), self.text[n:]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(text) + c.flush()
        size = HEAD.size + len(body) + 8
        self.out.write(HEAD.pack(31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<2I", zlib.crc32(text), len(text)))
        self.place += size

    def close(self) -> None:
        if self.text:
            self.block(len(self.text))
        self.out.write(END)


def lines_in(file, begin: int, end: int, count=None):
    """The lines that begin between two virtual offsets of an open file. count: gets the bytes of each block that is read."""
    place, skip = begin >> 16, begin & 0xFFFF
    rest = b""
    while True:
        file.seek(place)
        head = file.read(18)
        if len(head) < 18 or (place >= end >> 16 and not end & 0xFFFF):
            break
        # The size is in the extra field, which other writers may share with more.
        extra = head[12:] + file.read(struct.unpack_from("<H", head, 10)[0] - 6)
        at, size = 0, None
        while at + 4 <= len(extra):
            if extra[at : at + 2] == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + struct.unpack_from("<H", extra, at + 2)[0]
        if size is None:
            raise ValueError("not a block-gzipped file")
        used = 12 + len(extra)
        text = zlib.decompress(file.read(size - used - 8), -15)
        if count:
            count(size)
        last = place == end >> 16
        # A line that begins before the end may go on in the next block; the last block is cut at the end.
        *full, rest = (rest + (text[skip : end & 0xFFFF] if last else text[skip:])).split(b"\n")
        yield from full
        if last:
            break
        place, skip = place + size, 0
    if rest:
        yield rest


def opened(uri: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:")) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


@dataclass
class Span(InputPartition):
    """A window of a region in a file."""

    uri: str
    chrom_num: int
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.regions = options["path"], [x for x in options.get("regions", "").split(",") if x]

    def partitions(self) -> list[Span]:
        from pyarrow import fs

        files, at = opened(self.path)
        found = [x.path for x in files.get_file_info(fs.FileSelector(at)) if x.path.endswith(".gz") and not x.base_name.startswith(("_", "."))]
        scheme = self.path[: self.path.index(at)] if at in self.path else ""
        spans = merged_regions(self.regions) or [(c, 1, None) for c in range(1, 27)]
        windows = []
        for c, start, end in spans:
            # Beyond the known length of a chromosome lies one last window without an end.
            edges = [*range(start, min(end or LENGTHS[c - 1], LENGTHS[c - 1]) + 1, WINDOW)] or [start]
            windows += [(c, a, z - 1) for a, z in zip(edges, edges[1:])] + [(c, edges[-1], end or (1 << LINEAR + 3 * LEVELS))]
        return [Span(scheme + f, *w) for f in sorted(found) for w in windows]

    def read(self, partition: Span | None):
        if partition is None:  # no file: Spark asks once all the same
            return
        name = partition.uri.rsplit("/", 1)[1]
        for line in lines_of(partition):
            yield line.decode("utf-8", "replace"), name


def lines_of(span: Span, count=None):
    """The lines of a file whose position lies in the window."""
    files, at = opened(span.uri)
    with files.open_input_stream(at + ".tbi", compression=None) as f:
        index = Index.unpack(gzip.decompress(f.read()))
    with files.open_input_file(at) as f:
        for contig in (x for x in index.bins if number_of(x) == span.chrom_num):
            for begin, end in index.ranges(contig, span.start, span.end):
                for line in lines_in(f, begin, end, count):
                    own, pos, _ = line.split(b"\t", 2)
                    if own.decode() == contig and span.start <= int(pos) <= span.end:
                        yield line


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class FileWriter(DataSourceWriter):
    """One file and index for each partition, whose rows (value, contig, pos, length) are in order; they get their names when the job commits."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.header, self.job = options["path"], options.get("header", ""), uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        files, at = opened(self.path)
        files.create_dir(at)
        first = next(iterator, None)
        if first is None:
            return Written([])
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.vcf.gz"
        index = Index()
        with files.open_output_stream(f"{at}/_{name}", compression=None) as out:
            w = Writer(out)
            for line in self.header.split("\n") if self.header else []:
                w.line(line.encode())
            row = first
            while row is not None:
                index.add(row["contig"], row["pos"], row["length"], *w.line(row["value"].encode()))
                row = next(iterator, None)
            w.close()
        with files.open_output_stream(f"{at}/_{name}.tbi", compression=None) as out:
            out.write(gzip.compress(index.pack()))
        return Written([name])

    def commit(self, messages) -> None:
        files, at = opened(self.path)
        files.create_dir(at)
        for name in (n for m in messages if m for n in m.names):
            for x in (name + ".tbi", name):
                files.move(f"{at}/_{x}", f"{at}/{x}")

    def abort(self, messages) -> None:
        files, at = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            for x in (name, name + ".tbi"):
                files.delete_file(f"{at}/_{x}")


class Bgzf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "value string, file_name string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def read_bgzf(spark: SparkSession, path: str, regions: list[str] | None = None) -> DataFrame:
    """value and file_name of the lines in any of the regions (chr:start-end, chr:start, chr), or of all lines on known contigs."""
    spark.dataSource.register(Bgzf)
    return spark.read.format("bgzf").option("regions", ",".join(regions or [])).load(path)


def write_bgzf(lines: DataFrame, line: Column, path: str, header: list[str] | None = None, length: Column | None = None) -> None:
    """lines (chrom, chrom_num, pos) as block-gzipped files with their index, in ranges of the genome. length: positions that a line covers (1)."""
    lines.sparkSession.dataSource.register(Bgzf)
    out = lines.repartitionByRange("chrom_num", "pos").sortWithinPartitions("chrom_num", "pos")
    out = out.select(line.alias("value"), F.col("chrom").alias("contig"), F.col("pos").cast("long").alias("pos"), F.coalesce(length if length is not None else F.lit(1), F.lit(1)).cast("int").alias("length"))
    out.write.format("bgzf").mode("append").option("header", "\n".join(header or [])).save(path)
