"""Files read in parts give the rows and ordinals that they give whole."""

import gzip
import random

import pytest

from plexicount.sources import files, sinks


def blocks(data: bytes, size: int = 3000) -> bytes:
    return b"".join(sinks._block(data[k : k + size]) for k in range(0, len(data), size)) + sinks._block(b"")


def fastq(n: int, seed: int = 1) -> str:
    """Names and qualities with marks that look like the beginning of a record."""
    rng, out = random.Random(seed), []
    for k in range(n):
        size = rng.randint(1, 90)
        out.append(f"@r{k} a@b +c\n{''.join(rng.choice('ACGT') for _ in range(size))}\n+{rng.choice(('', f'r{k}'))}\n{''.join(rng.choice('@+IF#') for _ in range(size))}\n")
    return "".join(out)


@pytest.fixture(params=["plain", "blocks", "stream"])
def stored(request, tmp_path):
    def go(text: str, name: str) -> str:
        data = text.encode("latin-1")
        path = tmp_path / (name if request.param == "plain" else name + ".gz")
        path.write_bytes(data if request.param == "plain" else blocks(data) if request.param == "blocks" else gzip.compress(data))
        return str(path)

    go.splits = request.param != "stream"
    return go


def rows(df) -> list[str]:
    return [str(r) for r in df.orderBy("ordinal").collect()]


def test_fastq_in_parts(spark, stored):
    path = stored(fastq(1500), "r.fastq")
    whole = files.read(spark, "fastq", path)
    parts = files.read(spark, "fastq", path, split_bytes=7001)
    assert rows(parts) == rows(whole) and whole.count() == 1500
    assert (parts.rdd.getNumPartitions() > 5) == stored.splits


def test_lines_in_parts(spark, stored):
    text = "\n".join("x" * (k * 7919 % 60) for k in range(3000)) + "\nlast without an end"
    path = stored(text, "l.tsv")
    parts = files.read(spark, "numbered_lines", path, split_bytes=2500)
    assert [r["value"] for r in parts.orderBy("ordinal").collect()] == text.split("\n")
    assert [r["ordinal"] for r in parts.orderBy("ordinal").collect()] == list(range(3001))


def test_alignments_in_parts(spark, tmp_path):
    rng = random.Random(2)
    head = "@SQ\tSN:c1\tLN:9000\n@SQ\tSN:c2\tLN:9000"
    lines = [f"q{k}:UMI_A\t{rng.choice((0, 16))}\tc{rng.randint(1, 2)}\t{rng.randint(1, 8000)}\t{rng.randint(0, 60)}\t{rng.randint(1, 90)}M\t*\t0\t0\t{'ACGT' * rng.randint(1, 30)}\t*\tNM:i:{k}" for k in range(2500)]
    sam, bam = tmp_path / "a.sam", str(tmp_path / "a.bam")
    sam.write_text(head + "\n" + "\n".join(lines) + "\n")
    whole = files.read(spark, "alignments", str(sam))
    assert rows(files.read(spark, "alignments", str(sam), split_bytes=9000)) == rows(whole)
    sinks.write_bam(whole.repartition(5).orderBy("ordinal"), bam, *files.header_of(str(sam)))
    assert rows(files.read(spark, "alignments", bam)) == rows(whole)
    parts = files.read(spark, "alignments", bam, split_bytes=9000)
    assert parts.rdd.getNumPartitions() > 3 and rows(parts) == rows(whole)
    # Records that cross blocks at any byte.
    data = gzip.decompress(open(bam, "rb").read())
    crossed = tmp_path / "b.bam"
    crossed.write_bytes(blocks(data, 7777))
    assert rows(files.read(spark, "alignments", str(crossed), split_bytes=6000)) == rows(whole)


def test_parts_that_do_not_meet_are_read_whole(spark, tmp_path):
    # Every line could begin a record, so a guess in the middle of the file is wrong somewhere.
    path = tmp_path / "w.fastq"
    path.write_text("@a\n+A\n+\n@@\n" * 4000)
    got = files.read(spark, "fastq", str(path), split_bytes=1001)
    assert got.count() == 4000 and got.where("seq <> '+A'").isEmpty()


def test_folder_of_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.fastq").write_text(fastq(400, k))
    whole, parts = files.read(spark, "fastq", str(tmp_path)), files.read(spark, "fastq", str(tmp_path), split_bytes=5000)
    assert rows(parts) == rows(whole) and whole.count() == 1200


@pytest.mark.parametrize("split_bytes", [4000, 1 << 30])
def test_pairs_in_step(spark, stored, split_bytes):
    one, two = stored(fastq(900, 3), "one.fastq"), stored(fastq(900, 4), "two.fastq")
    pairs = files.read_pairs(spark, one, two, split_bytes)
    a, b = ({r["ordinal"]: (r["id"], r["seq"], r["qual"]) for r in files.read(spark, "fastq", p).collect()} for p in (one, two))
    assert {r["ordinal"]: (tuple(r["r1"]), tuple(r["r2"])) for r in pairs.collect()} == {k: (a[k], b[k]) for k in a}
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    short = stored(fastq(899, 4), "short.fastq")
    for x, y in ((one, short), (short, one)):
        with pytest.raises(Exception, match="different numbers"):
            files.read_pairs(spark, x, y, split_bytes).collect()
