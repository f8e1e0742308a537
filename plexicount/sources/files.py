"""Data sources for sequencing files: ``fastq``, ``alignments`` (SAM and BAM), ``numbered_lines``
and ``fastq_pairs``.

Plain files are split by bytes and BGZF files (BAM, block gzip) by blocks; only a gzip
stream of another kind is one partition.  A split holds the records that start in it, and
reads the last one to its end.  Rows come as Arrow batches with a contiguous
``ordinal``: where files are split, a first pass counts the records of each split.  That
pass also proves the splits: each must begin where the one before ended, else the file
is read whole.  Several files follow each other in order of name, each with its own
range of ordinals.  Paths are folders, files or URIs that pyarrow can open.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import ALIGNMENTS, LINES, PAIRS, READS

#: Rows that a file may have before the next one's ordinals begin.
FILE_SPAN = 1 << 40
#: Bytes of a file that one task reads, and of it at a time.
SPLIT_BYTES, CHUNK = 64 << 20, 1 << 20
GZIP = b"\x1f\x8b\x08\x04"


class FormatError(ValueError):
    """A file that isn't what it should be."""


def open_fs(path: str):
    import pyarrow.fs as pafs

    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    import os

    return pafs.LocalFileSystem(), os.path.abspath(path)


def files_of(path: str) -> list[str]:
    import pyarrow.fs as pafs

    fs, place = open_fs(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    found = fs.get_file_info(pafs.FileSelector(place))
    return sorted(prefix + f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def size_of(path: str) -> int:
    fs, place = open_fs(path)
    return fs.get_file_info(place).size


def open_text(path: str) -> io.TextIOBase:
    """A text stream; a name that ends in .gz, in any case, is decompressed, all its members."""
    fs, place = open_fs(path)
    raw = fs.open_input_file(place)
    stream = gzip.GzipFile(fileobj=raw) if path.lower().endswith(".gz") else raw
    return io.TextIOWrapper(stream, encoding="latin-1", newline="\n")


# -------------------------------------------------------------------- blocks


def bgzf_size(head: bytes) -> int:
    """Bytes of the BGZF block that begins with ``head``; 0 if none does."""
    if len(head) < 18 or head[:4] != GZIP:
        return 0
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 6 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return 0


def is_bgzf(path: str) -> bool:
    fs, place = open_fs(path)
    with fs.open_input_file(place) as f:
        return bgzf_size(f.read(64)) > 0


def inflated(block: bytes) -> bytes | None:
    """What a BGZF block holds; None if the bytes aren't one."""
    try:
        data = zlib.decompressobj(-15).decompress(block[12 + int.from_bytes(block[10:12], "little") : -8])
    except zlib.error:
        return None
    return data if block[-8:] == struct.pack("<II", zlib.crc32(data), len(data)) else None


def bgzf_blocks(f, begin: int) -> Iterator[tuple[int, bytes]]:
    """(offset, data) from the first block at or after ``begin`` on; checksums tell a block from chance."""
    f.seek(begin)
    held, at, searching = f.read(CHUNK), begin, begin > 0
    while held:
        if len(held) < 1 << 17:
            held += f.read(CHUNK)
        if searching:
            step = held.find(GZIP)
            if step < 0:
                step = max(1, len(held) - 3)
            elif not step:
                size = bgzf_size(held[:64])
                searching = not (size and inflated(held[:size]) is not None)
                step = int(searching)
            held, at = held[step:], at + step
            continue
        size = bgzf_size(held[:64])
        data = inflated(held[:size]) if size else None
        if data is None:
            raise FormatError(f"a damaged block at byte {at}")
        if data:
            yield at, data
        held, at = held[size:], at + size


def plain_blocks(f, begin: int) -> Iterator[tuple[int, bytes]]:
    f.seek(begin)
    while data := f.read(CHUNK):
        yield begin, data
        begin += len(data)


def gzip_blocks(f, begin: int) -> Iterator[tuple[int, bytes]]:
    """All members of a gzip stream."""
    stream = gzip.GzipFile(fileobj=f)
    while data := stream.read(CHUNK):
        yield begin, data


class Records:
    """The records that start in a part of a file, as byte chunks of whole records.

    ``first`` and ``next`` are the places in the file where its first record begins and
    where the one after its last does; -1 is the end of the file."""

    #: Whether a record that starts where the part ends is the part's, and one where it begins the one before's.
    #: For records of lines this says which is whose without a look at the byte before.
    inclusive = True

    def __init__(self, path: str, begin: int = 0, end: int | None = None):
        fs, place = open_fs(path)
        f = fs.open_input_file(place)
        self.path, self.begin, self.end = path, begin, end
        self.bgzf, self.plain = is_bgzf(path), not path.lower().endswith((".gz", ".bam"))
        self.blocks = (bgzf_blocks if self.bgzf else plain_blocks if self.plain else gzip_blocks)(f, begin)
        #: The bytes held, where they begin in what was read, how much that was, and where the part ends in it.
        self.held, self.base, self.total, self.limit = b"", 0, 0, None
        self.peeked, self.starts, self.places = None, [], []
        self.first = self.next = None

    def start(self, ended: bool) -> int | None:
        """Where in ``held`` the first record starts; None if that can't be told yet."""
        raise NotImplementedError

    def ends(self) -> np.ndarray:
        """Where the whole records in ``held`` end."""
        raise NotImplementedError

    def fill(self) -> bool:
        at, data = self.peeked or next(self.blocks, (None, None))
        self.peeked = None
        if data is None:
            self.limit = self.total if self.limit is None else self.limit
            return False
        if self.limit is None and self.end is not None and at + (0 if self.bgzf else len(data)) >= self.end:
            if self.bgzf or at >= self.end:
                self.limit = self.total
            elif self.plain and at + len(data) > self.end:
                data, self.peeked = data[: self.end - at], (self.end, data[self.end - at :])
        self.starts.append(self.total)
        self.places.append(at)
        self.held += data
        self.total += len(data)
        while len(self.starts) > 1 and self.starts[1] <= self.base:
            del self.starts[0], self.places[0]
        return True

    def place(self, at: int) -> int:
        """Of the ``at``-th byte of what is read: its place in the file."""
        if at >= self.total:
            self.peeked = self.peeked or next(self.blocks, None)
            if self.peeked is None:
                return -1
            return self.peeked[0] << 16 if self.bgzf else self.peeked[0]
        k = bisect_right(self.starts, at) - 1
        return self.places[k] << 16 | at - self.starts[k] if self.bgzf else self.places[k] + at - self.starts[k]

    def _past(self, at: int) -> bool:
        return self.limit is not None and (at > self.limit or at == self.limit and not self.inclusive)

    def chunks(self) -> Iterator[bytes]:
        ended = not self.fill()
        while (at := self.start(ended)) is None:
            # Given up far behind the end; if a record began here, the parts don't meet and that is noticed.
            if ended or self._past(len(self.held) - 64 * CHUNK):
                return
            ended = not self.fill()
        if self._past(self.base + at):
            return
        self.first = self.place(at)
        self.held, self.base = self.held[at:], at
        while True:
            ends = self.ends()
            n = len(ends)
            if self.limit is not None:
                starts = np.r_[0, ends[:-1]] + self.base if n else ends
                n = int(np.searchsorted(starts, self.limit, "right" if self.inclusive else "left"))
            if n:
                cut = int(ends[n - 1])
                yield self.held[:cut]
                self.held, self.base = self.held[cut:], self.base + cut
            if self._past(self.base):
                self.next = self.place(self.base)
                return
            if ended:
                self.next = -1
                if self.held.strip():
                    yield self.held
                return
            ended = not self.fill()
            while not ended and self.limit is None and len(self.held) < CHUNK:
                ended = not self.fill()


class Lines(Records):
    """A line is a record."""

    def start(self, ended: bool) -> int | None:
        at = self.held.find(b"\n") + 1
        return 0 if not self.begin else at or None

    def ends(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.held, np.uint8) == 10) + 1


class Fastq(Records):
    def start(self, ended: bool) -> int | None:
        if not self.begin:
            return 0
        lines = self.held.split(b"\n")
        at = 0
        for k in range(len(lines) - 4 + ended):
            if k and lines[k][:1] == b"@" and lines[k + 2][:1] == b"+" and len(lines[k + 1]) == len(lines[k + 3]):
                return at
            at += len(lines[k]) + 1
        return None

    def ends(self) -> np.ndarray:
        return (np.flatnonzero(np.frombuffer(self.held, np.uint8) == 10) + 1)[3::4]


class Bam(Records):
    inclusive = False
    contigs: list[tuple[str, int]]

    def start(self, ended: bool) -> int | None:
        if not self.begin:
            try:
                return bam_header(self.held)[2]
            except (struct.error, IndexError) as e:
                if ended:
                    raise FormatError("not a BAM file") from e
                return None
        if len(self.held) < CHUNK and not ended:
            return None
        return next((k for k in range(len(self.held) - 36) if self._chained(k)), None)

    def _chained(self, at: int, links: int = 4) -> bool:
        """Whether records that make sense follow each other from here."""
        for _ in range(links):
            if at + 36 > len(self.held):
                break
            size, tid, pos, n_name, n_cigar, n_seq, mtid, mpos = struct.unpack_from("<iiiB3xH2xiii", self.held, at)
            ok = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size < 1 << 28 and n_name and n_seq >= 0
            if not ok or not all(-1 <= t < len(self.contigs) and -1 <= p <= (self.contigs[t][1] if t >= 0 else 1 << 31) for t, p in ((tid, pos), (mtid, mpos))):
                return False
            name = self.held[at + 36 : at + 36 + n_name]
            if len(name) == n_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
                return False
            at += 4 + size
        return True

    def ends(self) -> np.ndarray:
        out, at, held = [], 0, self.held
        while at + 4 <= len(held):
            at += 4 + int.from_bytes(held[at : at + 4], "little", signed=True)
            if at > len(held):
                break
            out.append(at)
        return np.array(out, np.int64)


# ------------------------------------------------------------------- records


def fastq_columns(chunk: bytes) -> list[pa.Array]:
    """id, seq, qual of four-line records."""
    lines = chunk.decode("latin-1").replace("\r\n", "\n").rstrip("\r\n").split("\n")
    if len(lines) % 4 == 3 and not lines[-2]:
        lines.append("")
    heads, seqs, marks, quals = (lines[k::4] for k in range(4))
    if len(heads) != len(quals) or not all(h[:1] == "@" for h in heads) or not all(m[:1] == "+" for m in marks):
        bad = next((h for h, m in zip(heads, marks) if h[:1] != "@" or m[:1] != "+"), heads[-1])
        raise FormatError(f"not a FASTQ record: {bad[:60]}")
    seq, qual = pa.array(seqs, pa.string()), pa.array(quals, pa.string())
    if not pc.all(pc.equal(pc.utf8_length(seq), pc.utf8_length(qual))).as_py():
        raise FormatError("sequence and quality differ in length: " + next(h for h, s, q in zip(heads, seqs, quals) if len(s) != len(q))[:60])
    return [pa.array([h[1:] for h in heads], pa.string()), seq, qual]


def sam_record(line: str, tids: dict[str, int]) -> tuple:
    f = line.rstrip("\r\n").split("\t")
    if len(f) < 11:
        raise FormatError(f"a SAM line has at least 11 fields: {line[:60]}")
    tags = [tuple(t.split(":", 2)) for t in f[11:]]
    mate = f[2] if f[6] == "=" else f[6]
    return (f[0], int(f[1]), tids.get(f[2], -1), None if f[2] == "*" else f[2], int(f[3]) - 1, int(f[4]), f[5], tids.get(mate, -1), int(f[7]) - 1, int(f[8]), f[9], f[10], [(n, {"type": k, "value": v}) for n, k, v in tags])


def bam_header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs, and where the records begin.  Raises struct.error or IndexError where the data is too short."""
    if data[:4] != b"BAM\1"[: len(data)]:
        raise FormatError("not a BAM file")
    number = lambda at: struct.unpack_from("<i", data, at)[0]

    def text(at: int, n: int) -> str:
        if at + n > len(data):
            raise IndexError
        return data[at : at + n].rstrip(b"\0").decode("latin-1")

    head, at = text(8, number(4)), 8 + number(4)
    contigs, many, at = [], number(at), at + 4
    for _ in range(many):
        n = number(at)
        contigs.append((text(at + 4, n), number(at + 4 + n)))
        at += 8 + n
    return head, contigs, at


# Codes of the BAM format.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
LETTERS = str.maketrans("0123456789abcdef", BASES)
VISIBLE = bytes(min(q + 33, 255) for q in range(256))
FIXED = np.dtype([("size", "<i4"), ("tid", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("mtid", "<i4"), ("mpos", "<i4"), ("tlen", "<i4")])


def bam_tags(data: bytes) -> list[tuple[str, dict]]:
    out, at = [], 0
    while at < len(data):
        name, kind, at = data[at : at + 2].decode("latin-1"), chr(data[at + 2]), at + 3
        if kind in NUMBERS:
            size = struct.calcsize(NUMBERS[kind])
            value, shown = str(struct.unpack_from(NUMBERS[kind], data, at)[0]), "f" if kind == "f" else "i"
            at += size
        elif kind == "A":
            value, shown, at = chr(data[at]), "A", at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, shown, at = data[at:end].decode("latin-1"), kind, end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[sub][1]}", data, at + 5)
            value, shown, at = ",".join([sub, *map(str, values)]), "B", at + 5 + n * struct.calcsize(NUMBERS[sub])
        else:
            raise FormatError(f"an unknown tag type: {kind}")
        out.append((name, {"type": shown, "value": value}))
    return out


def bam_columns(chunk: bytes, names: list[str]) -> list[pa.Array]:
    starts, at = [], 0
    while at < len(chunk):
        starts.append(at)
        at += 4 + int.from_bytes(chunk[at : at + 4], "little", signed=True)
    if at != len(chunk):
        raise FormatError("a BAM record is cut off")
    # The fixed fields of all records at once; what varies in length one by one.
    raw = np.frombuffer(chunk, np.uint8)
    fixed = raw[np.array(starts, np.int64)[:, None] + np.arange(FIXED.itemsize)].copy().view(FIXED)[:, 0]
    qnames, cigars, seqs, quals, tags = [], [], [], [], []
    for at, size, n_name, n_cigar, n_seq in zip(starts, *[fixed[f].tolist() for f in ("size", "n_name", "n_cigar", "n_seq")]):
        a = at + 36 + n_name
        qnames.append(chunk[at + 36 : a - 1].decode("latin-1"))
        cigars.append("".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", chunk, a)) or "*")
        a += 4 * n_cigar
        z = a + (n_seq + 1) // 2
        seqs.append(chunk[a:z].hex().translate(LETTERS)[:n_seq] or "*")
        qual = chunk[z : z + n_seq]
        quals.append("*" if not n_seq or qual[0] == 255 else qual.translate(VISIBLE).decode("latin-1"))
        tags.append(bam_tags(chunk[z + n_seq : at + 4 + size]))
    number = lambda f, kind: pa.array(fixed[f].astype(kind))
    contig = pa.array([names[t] if t >= 0 else None for t in fixed["tid"].tolist()], pa.string())
    return [pa.array(qnames), number("flag", np.int32), number("tid", np.int32), contig, number("pos", np.int64), number("mapq", np.int32), pa.array(cigars), number("mtid", np.int32), number("mpos", np.int64), number("tlen", np.int64), pa.array(seqs), pa.array(quals), pa.array(tags, TAGS)]


TAGS = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))


def is_bam(path: str) -> bool:
    return path.lower().endswith(".bam")


def header_of(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and contigs (name, length)."""
    if is_bam(path):
        held = Bam(path)
        while True:
            ended = not held.fill()
            try:
                return bam_header(held.held)[:2]
            except (struct.error, IndexError) as e:
                if ended:
                    raise FormatError("not a BAM file") from e
    lines, contigs = [], []
    for line in open_text(path):
        if not line.startswith("@"):
            break
        lines.append(line.rstrip("\r\n"))
        if line.startswith("@SQ"):
            told = dict(x.split(":", 1) for x in lines[-1].split("\t")[1:])
            contigs.append((told["SN"], int(told["LN"])))
    return "\n".join(lines), contigs


def records_of(kind: str, path: str, begin: int = 0, end: int | None = None) -> tuple[Records, Iterator[list[pa.Array]]]:
    """The records of a part of a file, and their columns in chunks."""
    if kind == "fastq":
        part = Fastq(path, begin, end)
        return part, (fastq_columns(c) for c in part.chunks())
    if kind == "alignments":
        contigs = header_of(path)[1]
        names = [n for n, _ in contigs]
        if is_bam(path):
            part = Bam(path, begin, end)
            part.contigs = contigs
            return part, (bam_columns(c, names) for c in part.chunks())
        part, tids = Lines(path, begin, end), {n: k for k, n in enumerate(names)}
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), TAGS]

        def columns() -> Iterator[list[pa.Array]]:
            for chunk in part.chunks():
                rows = [sam_record(x, tids) for x in chunk.decode("latin-1").split("\n") if x.strip() and x[0] != "@"]
                if rows:
                    yield [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]

        return part, columns()
    part = Lines(path, begin, end)
    return part, ([pa.array(c.decode("latin-1").removesuffix("\n").split("\n"), pa.string())] for c in part.chunks())


# ------------------------------------------------------------------- sources

COUNTED = "file int, part int, n bigint, first bigint, next bigint"


class Part(InputPartition):
    def __init__(self, path: str, file: int, part: int, begin: int, end: int | None, ordinal: int = 0):
        self.path, self.file, self.part, self.begin, self.end, self.ordinal = path, file, part, begin, end, ordinal


def parts_of(paths: list[str], split_bytes: int | None, whole: set[int] = frozenset()) -> list[Part]:
    """The parts of files: of ``split_bytes`` each, but for ``whole`` files and streams that can't be entered midway."""
    out = []
    for k, path in enumerate(paths):
        size = size_of(path) if split_bytes else 0
        cuts = [0]
        if split_bytes and size > split_bytes and k not in whole and (not path.lower().endswith((".gz", ".bam")) or is_bgzf(path)):
            cuts = list(range(0, size, split_bytes))
        out += [Part(path, k, j, a, z, k * FILE_SPAN) for j, (a, z) in enumerate(zip(cuts, [*cuts[1:], None]))]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.path, self.kind, self.options = options["path"], kind, options

    def partitions(self):
        split = self.options.get("split_bytes")
        told = json.loads(self.options.get("ordinals", "[]"))
        made = parts_of(files_of(self.path), int(split) if split else None, set(json.loads(self.options.get("whole", "[]"))))
        for part, ordinal in zip(made, told):
            part.ordinal = ordinal
        return made

    def read(self, partition):
        part, chunks = records_of(self.kind, partition.path, partition.begin, partition.end)
        if self.options.get("counted"):
            n = sum(len(c[0]) for c in chunks)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((partition.file, partition.part, n, part.first, part.next), (pa.int32(), pa.int32(), *[pa.int64()] * 3))], names=["file", "part", "n", "first", "next"])
            return
        at = partition.ordinal
        for columns in chunks:
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *columns], names=["ordinal", *COLUMNS[self.kind]])
            at += n


COLUMNS = {k: [c.split()[0] for c in d.replace("map<string,struct<type:string,value:string>>", "map").split(", ")][1:] for k, d in (("fastq", READS), ("alignments", ALIGNMENTS), ("numbered_lines", LINES))}


class _Files(DataSource):
    kind, columns = "", ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return COUNTED if self.options.get("counted") else self.columns

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self.kind)


class FastqFiles(_Files):
    kind, columns = "fastq", READS


class AlignmentFiles(_Files):
    kind, columns = "alignments", ALIGNMENTS


class LineFiles(_Files):
    kind, columns = "numbered_lines", LINES


class PairPart(InputPartition):
    """Records of one file from its ``first``-th on, ``n`` of them (all, if None), and where the second file has them."""

    def __init__(self, one: Part, two: Part, skip: int, n: int | None, ordinal: int):
        self.one, self.two, self.skip, self.n, self.ordinal = one, two, skip, n, ordinal


class _PairReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        paths = [files_of(self.options[k]) for k in ("path", "path2")]
        if len(paths[0]) != len(paths[1]):
            raise FormatError("the two sides have different numbers of files")
        plan = json.loads(self.options.get("plan", "null"))
        if plan is None:
            return [PairPart(Part(a, k, 0, 0, None), Part(b, k, 0, 0, None), 0, None, k * FILE_SPAN) for k, (a, b) in enumerate(zip(*paths))]
        return [PairPart(Part(paths[0][k], k, 0, *one), Part(paths[1][k], k, 0, *two), skip, n, ordinal) for k, one, two, skip, n, ordinal in plan]

    def read(self, partition):
        one = records_of("fastq", partition.one.path, partition.one.begin, partition.one.end)[1]
        two = records_of("fastq", partition.two.path, partition.two.begin, partition.two.end)[1]
        kind = pa.struct([(c, pa.string()) for c in COLUMNS["fastq"]])
        skip, at, left = partition.skip, partition.ordinal, pa.array([], kind)
        struct_of = lambda columns: pa.StructArray.from_arrays(columns, fields=list(kind))
        for columns in one:
            r1 = struct_of(columns)
            while len(left) < len(r1):
                more = next(two, None)
                if more is None:
                    raise FormatError("the two files have different numbers of reads")
                more = struct_of(more)
                drop = min(skip, len(more))
                skip -= drop
                left = pa.concat_arrays([left, more.slice(drop)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(r1))), r1, left.slice(0, len(r1))], names=["ordinal", "r1", "r2"])
            at, left = at + len(r1), left.slice(len(r1))
        if partition.n is None and (len(left) or next(two, None) is not None):
            raise FormatError("the two files have different numbers of reads")


class FastqPairs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return PAIRS

    def reader(self, schema) -> DataSourceReader:
        return _PairReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (FastqFiles, AlignmentFiles, LineFiles, FastqPairs):
        spark.dataSource.register(source)


def _counted(spark: SparkSession, kind: str, path: str, split_bytes: int) -> tuple[list[Part], list, list[int]] | None:
    """Parts, their counts in order, and the files whose parts don't meet; None if nothing is split."""
    paths = files_of(path)
    parts = parts_of(paths, split_bytes)
    if len(parts) == len(paths):
        return None
    rows = sorted(spark.read.format(kind).option("counted", "true").option("split_bytes", split_bytes).load(path).collect(), key=lambda r: (r["file"], r["part"]))
    whole = []
    for k in range(len(paths)):
        held = [r for r in rows if r["file"] == k and r["first"] is not None]
        # Of an empty part nothing is known; the ones around it must meet.
        if any(a["next"] != b["first"] for a, b in zip(held, held[1:])) or (held and held[-1]["next"] != -1):
            whole.append(k)
    return parts, rows, whole


def read(spark: SparkSession, kind: str, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of a file or of all files of a folder; files over ``split_bytes`` in as many parts as that makes."""
    register(spark)
    made = _counted(spark, kind, path, split_bytes)
    if made is None:
        return spark.read.format(kind).load(path)
    parts, rows, whole = made
    ordinals, at = [], 0
    for part, row in zip(parts, rows):
        at = part.file * FILE_SPAN if part.part == 0 else at
        if part.file not in whole or part.part == 0:
            ordinals.append(at)
        at += row["n"]
    return spark.read.format(kind).option("split_bytes", split_bytes).option("whole", json.dumps(whole)).option("ordinals", json.dumps(ordinals)).load(path)


def read_pairs(spark: SparkSession, first: str, second: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ordinal, r1, r2 of two FASTQ files read in step, by the tasks themselves: nothing is
    exchanged.  Raises where one file is longer."""
    register(spark)
    base = spark.read.format("fastq_pairs").option("path2", second)
    made = [_counted(spark, "fastq", p, split_bytes) for p in (first, second)]
    if any(m is None or m[2] for m in made):
        return base.load(first)
    plan = []
    (one, n_one, _), (two, n_two, _) = made
    for k in {p.file for p in one}:
        a, b = ([(p, r["n"]) for p, r in zip(ps, rs) if p.file == k] for ps, rs in ((one, n_one), (two, n_two)))
        if sum(n for _, n in a) != sum(n for _, n in b):
            raise FormatError("the two files have different numbers of reads")
        starts = np.cumsum([0, *[n for _, n in b]])
        at = 0
        for p, n in a:
            j = min(int(np.searchsorted(starts, at, "right")) - 1, len(b) - 1)
            if n:
                plan.append((k, (p.begin, p.end), (b[j][0].begin, None), int(at - starts[j]), n, k * FILE_SPAN + at))
            at += n
    return base.option("plan", json.dumps(plan)).load(first)


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, length of the header."""
    return spark.createDataFrame([(k, n, size) for k, (n, size) in enumerate(header_of(path)[1])], "tid int, name string, length bigint")
