import pytest

from plexicount.cli import main

FASTQ = "".join(f"@r{k} c\n{s}\n+\n{'I' * len(s)}\n" for k, s in enumerate(["ACGTACGTAA", "ACGTTTGTAA", "AC", "TTGTACGTAA"]))
SAM = "@SQ\tSN:chr1\tLN:5000\n" + "".join(f"x:CELL_C{k % 2}:UMI_{u}\t0\tchr1\t{p}\t{q}\t4M\t*\t0\t0\tACGT\tIIII\tXF:Z:g{k % 3}\n" for k, (u, p, q) in enumerate([("AAAA", 10, 1), ("AAAA", 10, 5), ("AAAC", 10, 3), ("GGGG", 10, 2), ("GGGG", 90, 2), ("CCCC", 90, 9)]))


@pytest.fixture
def run(spark, tmp_path):
    def go(text, *args, name="in.fastq"):
        (tmp_path / name).write_text(text)
        out = tmp_path / "out"
        assert main([args[0], "-I", str(tmp_path / name), "-S", str(out), *[a.replace("@", str(tmp_path)) for a in args[1:]]], spark) == 0
        return out.read_text()

    return go


def test_extract(run, tmp_path):
    assert run(FASTQ, "extract", "--bc-pattern", "NNXX").split("\n")[:2] == ["@r0_AC c", "GTACGTAA"]
    (tmp_path / "r2.fastq").write_text(FASTQ)
    (tmp_path / "w").write_text("AC\tTT\n")
    got = run(FASTQ, "extract", "--bc-pattern", "CCNN", "--read2-in", "@/r2.fastq", "--read2-stdout", "--whitelist", "@/w", "--error-correct-cell", "--filtered-out", "@/gone.fastq")
    assert [x for x in got.split("\n") if x[:1] == "@"] == ["@r0_AC_GT c", "@r1_AC_GT c", "@r3_AC_GT c"]
    assert (tmp_path / "gone.fastq").read_text() == "@r2 c\nAC\n+\nII\n"
    run(FASTQ, "extract", "--bc-pattern2", "NN", "--read2-in", "@/r2.fastq", "--read2-out", "@/o2.fastq")
    assert (tmp_path / "o2.fastq").read_text().startswith("@r0_AC c\nGTACGTAA\n")


def test_whitelist(run):
    text = "".join(f"@r{k}\n{s}AA\n+\nIIIIII\n" for k, s in enumerate(["AAAA"] * 9 + ["CCCC"] * 8 + ["GGGG"] * 7 + ["AAAC"]))
    assert run(text, "whitelist", "--bc-pattern", "CCCC", "--set-cell-number", "3") == "AAAA\tAAAC\t9\t1\nCCCC\t\t8\t\n"


def test_alignments(run, tmp_path):
    got = run(SAM, "dedup", "--out-sam", "--extract-umi-method", "umis", "--output-stats", "@/s", name="in.sam")
    assert [x.split("\t")[0][-4:] for x in got.split("\n") if x[:1] == "x"] == ["AAAA", "GGGG", "GGGG", "CCCC"]
    assert (tmp_path / "s_per_umi_per_position.tsv").read_text() == "counts\tinstances_pre\tinstances_post\n1\t4\t3\n2\t1\t0\n3\t0\t1\n"
    assert (tmp_path / "s_edit_distance.tsv").read_text().startswith("unique\tunique_null\tdirectional\tdirectional_null\tedit_distance\n")
    assert (tmp_path / "s_per_umi.tsv").read_text().split("\n")[1] == "AAAA\t2\t1\t2\t3\t1\t3"
    run(SAM, "group", "--out-sam", "--output-bam", "--umi-separator", ":", "--group-out", "@/g.tsv", name="in.sam")
    table = [x.split("\t") for x in (tmp_path / "g.tsv").read_text().strip().split("\n")]
    assert table[0][-1] == "unique_id" and len(table) == 7 and {r[8] for r in table[1:]} == {"0", "1", "2", "3"}


def test_counts(run):
    assert run(SAM, "count", name="in.sam") == "gene\tcount\ng0\t2\ng1\t2\ng2\t2\n"
    assert run(SAM, "count", "--per-cell", "--wide-format-cell-counts", name="in.sam") == "gene\tC0\tC1\ng0\t1\t1\ng1\t1\t1\ng2\t1\t1\n"
    tab = "a_C1_AA\tg1\nb_C2_AA\tg1\nc_C1_TT\tg2\nd_C1_AA\tg1\n"
    assert run(tab, "count_tab", name="t.tsv") == "gene\tcount\ng1\t1\ng2\t1\ng1\t1\n"
    assert run(tab, "count_tab", "--per-cell", name="t.tsv").split("\n")[:3] == ["cell\tgene\tcount", "C1\tg1\t1", "C2\tg1\t1"]


def test_errors(spark, tmp_path):
    (tmp_path / "x.fastq").write_text(FASTQ)
    assert main(["extract", "-I", str(tmp_path / "x.fastq"), "--bc-pattern", "NZ"], spark) == 2
    (tmp_path / "x.sam").write_text(SAM)
    assert main(["dedup", "-I", str(tmp_path / "x.sam"), "--chrom", "chrX"], spark) == 2
    assert main(["dedup", "-I", str(tmp_path / "x.sam"), "--filter-umi"], spark) == 2
