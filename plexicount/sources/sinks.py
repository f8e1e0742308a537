"""Writers: FASTQ, tab-separated tables, SAM and BAM.

Tables and FASTQ are folders of parts in order, gzipped on demand, written by all
tasks.  ``one_file`` and the alignment writers make one file of such parts: tasks write
and pack them to the shared folder, and only finished bytes are put together.
"""

from __future__ import annotations

import contextlib
import gzip
import re
import shutil
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir
from .files import BASES, OPERATIONS, open_fs

#: Bytes of a BGZF block before it is packed.
BLOCK = 60_000


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.orderBy("ordinal").select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str, compress: bool = False) -> None:
    fastq_lines(reads).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_tsv(table: DataFrame, path: str, header: bool = True, compress: bool = False) -> None:
    table.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", escape="", emptyValue="", compression="gzip" if compress else "none")


def _joined(spark: SparkSession, parts: str, path: str, head: bytes, tail: bytes = b"") -> None:
    """One file of the files in a folder, in order of name, between ``head`` and ``tail``; ``-`` is standard output."""
    fs, place = open_fs(parts)
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(place, allow_not_found=True)) if f.is_file and not f.base_name.startswith((".", "_")))
    target = None if path == "-" else open_fs(path)
    with contextlib.nullcontext(sys.stdout.buffer) if target is None else target[0].open_output_stream(target[1], compression=None) as out:
        out.write(head)
        for name in names:
            with fs.open_input_stream(name) as f:
                shutil.copyfileobj(f, out, 1 << 20)
        out.write(tail)
        out.flush()
    if names:
        fs.delete_dir(place)


def one_file(lines: DataFrame, path: str, head: Iterable[str] = ()) -> None:
    """The rows of a one-column table as lines of one file; .gz is gzipped (a stream of
    several members), ``-`` is standard output."""
    packed, spark = path.lower().endswith(".gz"), lines.sparkSession
    parts = fresh_dir(spark, "lines")
    text = "".join(f"{line}\n" for line in head).encode("latin-1")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[bytes]:
            for batch in batches:
                data = "".join(f"{v}\n" for v in batch.column(0).to_pylist()).encode("latin-1")
                yield gzip.compress(data, 3) if packed else data

        yield _part_file(parts, made())

    lines.mapInArrow(write, "bytes bigint").collect()
    _joined(spark, parts, path, gzip.compress(text, 3) if packed and text else text)


def _part_file(folder: str, chunks: Iterator[bytes]) -> pa.RecordBatch:
    """Writes a task's chunks to a file named by its partition; it appears whole, so a task that is run again does no harm."""
    from pyspark import TaskContext

    fs, place = open_fs(folder)
    fs.create_dir(place, recursive=True)
    target, size = f"{place}/part-{TaskContext.get().partitionId():08d}", 0
    with fs.open_output_stream(own := f"{place}/.{uuid4().hex}") as f:
        for chunk in chunks:
            f.write(chunk)
            size += len(chunk)
    fs.move(own, target)
    return pa.record_batch({"bytes": pa.array([size], pa.int64())})


def tsv_lines(table: DataFrame) -> DataFrame:
    """A table's rows as tab-separated lines, in its order; nulls are empty."""
    return table.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]).alias("value"))


def sam_lines(alignments: DataFrame) -> DataFrame:
    """SAM lines in the table's order."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat_ws(":", t.key, t.value["type"], t.value["value"]))
    mate = F.when(F.col("mtid") < 0, "*").when(F.col("mtid") == F.col("tid"), "=").otherwise(F.col("mate_contig"))
    return alignments.select(F.concat_ws("\t", "qname", "flag", F.coalesce("contig", F.lit("*")), F.col("pos") + 1, "mapq", F.coalesce("cigar", F.lit("*")), mate, F.col("mpos") + 1, "tlen", F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")), F.when(F.size(tags) > 0, F.array_join(tags, "\t"))).alias("value"))


def write_sam(alignments: DataFrame, path: str, header: str, contigs: list[tuple[str, int]]) -> None:
    names = F.create_map(*[x for k, (n, _) in enumerate(contigs) for x in (F.lit(k), F.lit(n))]) if contigs else F.create_map().cast("map<int,string>")
    one_file(sam_lines(alignments.withColumn("mate_contig", F.element_at(names, F.col("mtid")))), path, header.split("\n") if header else ())


def _bam_tag(name: str, kind: str, value: str) -> bytes:
    head = name.encode("latin-1") + kind.encode()
    if kind == "i":
        return head + struct.pack("<i", int(value))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    if kind == "A":
        return head + value.encode("latin-1")
    if kind == "B":
        sub, *numbers = value.split(",")
        code = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[sub]
        return head + sub.encode() + struct.pack(f"<i{len(numbers)}{code}", len(numbers), *[(float if code == "f" else int)(x) for x in numbers])
    return head + value.encode("latin-1") + b"\0"


def reference_bin(begin: int, end: int) -> int:
    """The smallest bin of the binning index that holds [begin, end)."""
    end -= 1
    for shift in (14, 17, 20, 23, 26):
        if begin >> shift == end >> shift:
            return ((1 << (29 - shift)) - 1) // 7 + (begin >> shift)
    return 0


def bam_bytes(row) -> bytes:
    cigar = [(int(n), OPERATIONS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [BASES.index(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    name = row["qname"].encode("latin-1") + b"\0"
    span = sum(n for n, o in cigar if OPERATIONS[o] in "MDN=X") or 1
    place = reference_bin(row["pos"], row["pos"] + span) if row["pos"] >= 0 else 4680
    body = struct.pack("<iiBBHHHiiii", row["tid"], row["pos"], len(name), row["mapq"], place, len(cigar), row["flag"], len(seq), row["mtid"], row["mpos"], row["tlen"]) + name
    body += struct.pack(f"<{len(cigar)}I", *[n << 4 | o for n, o in cigar]) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + qual
    body += b"".join(_bam_tag(k, t["type"], t["value"]) for k, t in (row["tags"] or {}).items())
    return struct.pack("<i", len(body)) + body


def _block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(alignments: DataFrame, path: str, header: str, contigs: list[tuple[str, int]]) -> None:
    text = header.encode("latin-1") + (b"\n" if header and not header.endswith("\n") else b"")
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for name, size in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode("latin-1") + b"\0" + struct.pack("<i", size)
    blocks = lambda data: b"".join(_block(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK))
    parts = fresh_dir(alignments.sparkSession, "bam")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[bytes]:
            held = bytearray()
            for batch in batches:
                for row in batch.to_pylist():
                    row["tags"] = dict(row["tags"] or {})
                    record = bam_bytes(row)
                    # A record doesn't cross blocks unless it is longer than one.
                    if held and len(held) + len(record) > BLOCK:
                        yield blocks(bytes(held))
                        held.clear()
                    held += record
            yield blocks(bytes(held))

        yield _part_file(parts, made())

    alignments.mapInArrow(write, "bytes bigint").collect()
    _joined(alignments.sparkSession, parts, path, blocks(head), _block(b""))
