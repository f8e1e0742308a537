import gzip

import pytest
from pyspark.sql import functions as F

from plexicount.operators import dedup, extract, group
from plexicount.operators.alignments import AlignmentError, KeyOptions, best_reads_exact, keyed, on_contig
from plexicount.sources import files, lists, sinks

SAM = """@HD\tVN:1.6
@SQ\tSN:chr1\tLN:5000
@SQ\tSN:chr2\tLN:9000
r1_AAAA\t0\tchr1\t101\t30\t5S10M\t*\t0\t0\tACGTACGTACGTACG\tIIIIIIIIIIIIIII\tXF:Z:g1\tNM:i:2
r2_AAAC\t0\tchr1\t101\t20\t5S10M\t*\t0\t0\tACGTACGTACGTACG\tIIIIIIIIIIIIIII\tXF:Z:g1
r3_AAAA\t0\tchr1\t101\t40\t5S10M\t*\t0\t0\tACGTACGTACGTACN\tIIIIIIIIIIIIIII\tXF:Z:g2\tZB:B:c,1,-2
r4_GGGG\t16\tchr2\t201\t30\t10M2S\tchr1\t7\t0\tACGTACGTACGT\tIIIIIIIIIIII\tXF:i:3
r5_GGGG\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*
"""


@pytest.fixture
def sam(tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM)
    return str(path)


def test_fastq(spark, tmp_path):
    path = tmp_path / "a.fastq.GZ"
    with gzip.open(path, "wt") as f:
        f.write("@r1 c\nACGTAC\n+\nIIIIII\n@r2\nAC\n+\nII\n")
    reads = files.read(spark, "fastq", str(path))
    assert [tuple(r) for r in reads.orderBy("ordinal").collect()] == [(0, "r1 c", "ACGTAC", "IIIIII"), (1, "r2", "AC", "II")]
    found = extract.extract(reads, extract.ExtractOptions("NNN"))
    assert {r["id"]: r["status"] for r in found.collect()} == {"r1_ACG c": "output", "r2": "too_short"}
    sinks.one_file(sinks.fastq_lines(extract.kept(found)), str(tmp_path / "out.fastq"))
    assert (tmp_path / "out.fastq").read_text() == "@r1_ACG c\nTAC\n+\nIII\n"


@pytest.mark.parametrize("text", ["@r\nACG\n+\nII\n", "r\nA\n+\nI\n", "@r\nA\n"])
def test_broken_fastq(spark, tmp_path, text):
    path = tmp_path / "b.fastq"
    path.write_text(text)
    with pytest.raises(Exception, match="FASTQ|length"):
        files.read(spark, "fastq", str(path)).count()


def test_sam_and_bam(spark, sam, tmp_path):
    rows = files.read(spark, "alignments", sam)
    got = [tuple(r) for r in rows.orderBy("ordinal").select("qname", "flag", "tid", "pos", "cigar", "mtid", "mpos").collect()]
    assert got[0] == ("r1_AAAA", 0, 0, 100, "5S10M", -1, -1) and got[3] == ("r4_GGGG", 16, 1, 200, "10M2S", 0, 6) and got[4][2] == -1
    header, contigs = files.header_of(sam)
    bam = str(tmp_path / "x.bam")
    sinks.write_bam(rows.orderBy("ordinal"), bam, header, contigs)
    assert files.header_of(bam) == (header + "\n", contigs)
    back = files.read(spark, "alignments", bam)
    columns = [c for c in rows.columns if c != "tags"]
    assert sorted(map(tuple, back.select(*columns).collect()), key=str) == sorted(map(tuple, rows.select(*columns).collect()), key=str)
    assert {r["qname"]: r["tags"] for r in back.collect()} == {r["qname"]: r["tags"] for r in rows.collect()}
    out = str(tmp_path / "y.sam")
    sinks.write_sam(rows.orderBy("ordinal"), out, header, contigs)
    again = files.read(spark, "alignments", out)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_dedup_and_group_of_files(spark, sam):
    rows = files.read(spark, "alignments", sam)
    kept = dedup.dedup(rows, dedup.DedupOptions())
    assert {r["qname"] for r in kept.collect()} == {"r3_AAAA", "r4_GGGG"}
    grouped = group.group(rows, group.GroupOptions(output_unmapped=True))
    tagged = {r["qname"]: (r["tags"]["BX"]["value"] if "BX" in r["tags"] else None) for r in grouped.collect()}
    assert tagged == {"r1_AAAA": "AAAA", "r2_AAAC": "AAAA", "r3_AAAA": "AAAA", "r4_GGGG": "GGGG", "r5_GGGG": None}
    genes = dedup.leads(rows, dedup.DedupOptions("unique", keys=KeyOptions(per_gene=True)))
    assert {(r["gene"], r["umi"]) for r in genes.collect()} == {("g1", "AAAA"), ("g1", "AAAC"), ("g2", "AAAA")}
    with pytest.raises(AlignmentError):
        on_contig(rows, "chrX", files.contigs(spark, sam))


def test_exact_ties(spark):
    rows = [(k, f"r{k}_AA", 0, 0, "c", 10, 5, "4M", -1, -1, 0, "*", "*", {}) for k in range(50)]
    from plexicount.schemas import ALIGNMENTS

    df = spark.createDataFrame(rows, ALIGNMENTS)
    options = KeyOptions(seed=123456789)
    reads = keyed(df, options)
    best = best_reads_exact(reads, ["tid", "start", "is_reverse", "tlen_key"], options).first()
    import random

    rng, want, ties = random.Random(123456789), 0, 0
    for k in range(1, 50):
        ties += 1
        if rng.random() < 1.0 / ties:
            want = k
    assert (best["n"], best["first"], best["best"]) == (50, 0, want)


def test_exact_subset_and_ties_share_a_stream(spark):
    import random

    from plexicount.schemas import ALIGNMENTS

    rows = [(k, f"r{k}", 0, 0, "c", 10, 5, "4M", -1, -1, 0, "*", "*", {} if k % 3 == 0 else {"RX": {"type": "Z", "value": "AA"}}) for k in range(60)]
    options = dedup.DedupOptions("unique", keys=KeyOptions(umi_from="tag", subset=0.5, seed=7), exact=True)
    got = dedup.leads(spark.createDataFrame(rows, ALIGNMENTS), options).first()
    rng, kept, best, ties = random.Random(7), 0, None, 0
    for k in range(60):
        if rng.random() < 0.5 and k % 3:
            kept += 1
            if kept == 1:
                best = k
                continue
            ties += 1
            best = k if rng.random() < 1.0 / ties else best
    assert (got["n"], got["best"]) == (kept, best)


def test_lists(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("AAA\tAAC,AAG\t10\n\nCCC\tAAC\n# x\n")
    path = str(tmp_path / "w.tsv")
    assert {r[0] for r in lists.whitelist(spark, path).collect()} == {"AAA", "CCC", "# x"}
    assert {tuple(r) for r in lists.whitelist_corrections(spark, path).collect()} == {("AAC", "CCC"), ("AAG", "AAA")}
    assert {r[0] for r in lists.umi_list(spark, path).collect()} == {"AAA", "CCC"}
    one = spark.createDataFrame([("A",), ("C",)], "umi string")
    assert {r[0] for r in dedup.whitelist_product(one, one).collect()} == {"AA", "AC", "CA", "CC"}
    with pytest.raises(ValueError, match="limit"):
        dedup.whitelist_product(one, one, limit=3)


def test_unequal_pairs_raise(spark):
    r = spark.createDataFrame([(0, "a", "ACGT", "IIII"), (1, "b", "ACGT", "IIII")], "ordinal bigint, id string, seq string, qual string")
    with pytest.raises(Exception, match="different numbers"):
        extract.zip_pairs(r, r.where("ordinal = 0")).collect()
    with pytest.raises(Exception, match="missing"):
        extract.reconcile_pairs(r, r.where("ordinal = 0")).collect()
    assert extract.reconcile_pairs(r.where(F.col("ordinal") == 1), r).count() == 1
