"""Queries that go through files: sources, writers, lists, the commands and the stream.

Each writes its input to the shared folder first, reads it back in parts, and compares
rows with their place in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..operators import dedup as deduping
from ..operators import extract as extraction
from ..operators import group as grouping
from ..operators import whitelist as listing
from ..operators.alignments import KeyOptions
from ..sources import files, lists, sinks
from ..storage import fresh_dir
from ..streaming.coordinate import group_stream
from . import fixtures as fx
from .catalog import _AL_READS, _BARCODES, _BC, _CELLS, _CORRECTED, _FASTQ, _FIXED, _GENE_READS, _GENES, _HEAD, _IDS, _PLACE, _PLACE_KEYS, _TAB, _TAIL, KEYS, _groups_sql, _with, query

#: Small, so that the files of small tables have several parts too.
SPLIT = 50_000
CONTIGS = [(t, 100_000) for t in fx.TYPES]
HEADER = "\n".join(f"@SQ\tSN:{n}\tLN:{size}" for n, size in CONTIGS)


def _place(spark: SparkSession, name: str) -> str:
    files.open_fs(folder := fresh_dir(spark, "files"))[0].create_dir(files.open_fs(folder)[1], recursive=True)
    return f"{folder}/{name}"


def _fastq_file(spark: SparkSession, sf_dir: str, name: str, seed: str = "a") -> str:
    sinks.one_file(sinks.fastq_lines(fx.fastq_reads(spark, sf_dir, seed)), path := _place(spark, name))
    return path


def _sam_file(spark: SparkSession, rows: DataFrame) -> str:
    sinks.write_sam(rows.orderBy("ordinal"), path := _place(spark, "in.sam"), HEADER, CONTIGS)
    return path


def _command(spark: SparkSession, *args: str) -> None:
    if cli.main(list(args), spark):
        raise RuntimeError(f"the command failed: {' '.join(args)}")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return files.read(spark, "numbered_lines", path, SPLIT)


# ------------------------------------------------------------------ sources


@query("source_fastq", f"{_FASTQ} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, id, seq, qual FROM reads")
def source_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read(spark, "fastq", _fastq_file(spark, sf_dir, "r.fastq"), SPLIT)


@query("source_fastq_gzip", f"{_FASTQ} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, id, seq, qual FROM reads")
def source_fastq_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read(spark, "fastq", _fastq_file(spark, sf_dir, "r.fastq.gz"), SPLIT)


@query("source_fastq_folder", f"{_FASTQ} SELECT id, seq, qual FROM reads")
def source_fastq_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_fastq(fx.fastq_reads(spark, sf_dir), path := _place(spark, "parts"), compress=True)
    return files.read(spark, "fastq", path, SPLIT).where("id <> ''").select("id", "seq", "qual")


_PAIR = f"{_FASTQ}, {fx.duck_fastq('mates', 'm')}, pairs AS (SELECT row_number() OVER (ORDER BY a.ordinal) - 1 AS ordinal, a.id, a.seq AS s1, a.qual AS q1, b.seq AS s2, b.qual AS q2 FROM reads a JOIN mates b USING (ordinal))"


@query("source_pairs", f"{_PAIR} SELECT ordinal, id, s1, q1, s2, q2 FROM pairs")
def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = files.read_pairs(spark, _fastq_file(spark, sf_dir, "1.fastq"), _fastq_file(spark, sf_dir, "2.fastq", "m"), SPLIT)
    return pairs.select("ordinal", "r1.id", F.col("r1.seq").alias("s1"), F.col("r1.qual").alias("q1"), F.col("r2.seq").alias("s2"), F.col("r2.qual").alias("q2"))


_SHOWN = "qname, flag, tid, contig, pos, cigar, gene, rx, nm"
_DUCK_SHOWN = "qname, flag, tid, contig, pos, cigar, gene, umi AS rx, '1' AS nm"


def _shown(rows: DataFrame, *more) -> DataFrame:
    value = lambda t, name: F.element_at("tags", F.lit(t))["value"].alias(name)
    return rows.select(*more, "qname", "flag", "tid", "contig", "pos", "cigar", value("XF", "gene"), value("RX", "rx"), value("NM", "nm"))


@query("source_sam", f"WITH {fx.DUCK_ALIGNMENTS} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, mapq::INT AS mapq, {_DUCK_SHOWN} FROM al")
def source_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(files.read(spark, "alignments", _sam_file(spark, fx.alignments(spark, sf_dir)), SPLIT), "ordinal", "mapq")


@query("source_bam_in_coordinate_order", f"WITH {fx.DUCK_ALIGNMENTS} SELECT row_number() OVER (ORDER BY tid, pos, ordinal) - 1 AS ordinal, (mapq % 250)::INT AS mapq, {_DUCK_SHOWN} FROM al")
def source_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.alignments(spark, sf_dir).withColumn("mapq", F.col("mapq") % 250)
    sinks.write_bam(deduping.coordinate_order(rows), path := _place(spark, "x.bam"), HEADER, CONTIGS)
    return _shown(files.read(spark, "alignments", path, SPLIT), "ordinal", "mapq")


# -------------------------------------------------------------------- lists

_LINES = "lines AS (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN '#' WHEN event_id % 31 = 0 THEN '' ELSE '' END || b || chr(9) || v1 || ',' || v2 AS value, b, v1, v2, event_id % 29 = 0 AS said FROM (SELECT event_id, 'B' || (user_id % 50) AS b, 'V' || (event_id % 97) AS v1, 'V' || (user_id % 61) AS v2 FROM events))"


def _list_file(spark: SparkSession, sf_dir: str) -> str:
    rows = fx._read(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 29 = 0 THEN '#' ELSE '' END || 'B' || (user_id % 50) || '\t' || 'V' || (event_id % 97) || ',' || 'V' || (user_id % 61) AS value")
    sinks.one_file(rows.orderBy("event_id").select(F.concat("value", F.when(F.col("event_id") % 5 == 0, F.lit("\r")).otherwise(F.lit("")), F.when(F.col("event_id") % 7 == 0, F.lit("\n")).otherwise(F.lit(""))).alias("value")), path := _place(spark, "list.tsv"))
    return path


@query("list_barcodes", f"WITH {_LINES} SELECT DISTINCT CASE WHEN said THEN '#' || b ELSE b END AS barcode FROM lines")
def list_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.blacklist(spark, _list_file(spark, sf_dir))


@query("list_corrections", f"WITH {_LINES} SELECT variant, arg_max(CASE WHEN said THEN '#' || b ELSE b END, event_id) AS barcode FROM (SELECT event_id, b, said, unnest([v1, v2]) AS variant FROM lines) GROUP BY variant")
def list_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.whitelist_corrections(spark, _list_file(spark, sf_dir))


@query("list_umis", f"WITH {_LINES} SELECT DISTINCT b AS umi FROM lines WHERE NOT said")
def list_umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.umi_list(spark, _list_file(spark, sf_dir))


# ----------------------------------------------------- whitelists over files

_HALVES = "halves AS (SELECT seq, row_number() OVER (ORDER BY ordinal % 2, ordinal) - 1 AS nth FROM reads)"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of two files: the reads of even ordinals, then the odd ones."""
    reads, folder = fx.fastq_reads(spark, sf_dir), _place(spark, "halves")
    files.open_fs(folder)[0].create_dir(files.open_fs(folder)[1])
    for k in (0, 1):
        sinks.one_file(sinks.fastq_lines(reads.where(F.col("ordinal") % 2 == k)), f"{folder}/{k}.fastq")
    return files.read(spark, "fastq", folder, SPLIT)


@query("barcodes_of_two_files", f"{_FASTQ} SELECT substr(seq, 1, 3) AS cell, count(*) AS n FROM reads WHERE length(seq) >= 4 GROUP BY 1")
def barcodes_of_two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.barcode_counts(_halves(spark, sf_dir), listing.WhitelistOptions("CCCN")).select("cell", "n")


_PART = "nth < (SELECT (count(*) * 7) // 10 FROM reads)"


@query("barcodes_of_the_first_reads", f"{_FASTQ}, {_HALVES} SELECT substr(seq, 1, 3) AS cell, count(*) AS n FROM halves WHERE {_PART} AND length(seq) >= 4 GROUP BY 1")
def barcodes_of_the_first_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit ends inside the second file; it is the feature here."""
    reads = _halves(spark, sf_dir)
    return listing.barcode_counts(reads, listing.WhitelistOptions("CCCN", subset_reads=reads.count() * 7 // 10)).select("cell", "n")


@query("whitelist_unmatched", f"{_FASTQ}, {_HALVES} SELECT seq FROM halves WHERE {_PART} AND length(seq) < 8")
def whitelist_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _halves(spark, sf_dir)
    return listing.unmatched(reads, listing.WhitelistOptions("CCCNNNNN", subset_reads=reads.count() * 7 // 10)).select("seq")


@query("barcodes_without_a_cell", f"{_FASTQ} SELECT regexp_extract(seq, '^(A*)[CGT]{{2}}', 1) AS cell, count(*) AS n FROM reads WHERE regexp_matches(seq, '^A+[CGT]{{2}}') GROUP BY 1")
def barcodes_without_a_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The barcode may be empty; such reads count for none."""
    return listing.barcode_counts(fx.fastq_reads(spark, sf_dir), listing.WhitelistOptions("^(?P<cell_1>A*)(?P<umi_1>[CGT]{2})", "regex")).select("cell", "n")


_DENSE = """hist AS (SELECT n, count(*) AS many, log10(n) AS l FROM counts WHERE n > 0.001 * (SELECT max(n) FROM counts) GROUP BY n),
shape AS (SELECT min(l) AS lo, max(l) AS hi, sqrt(sum(many * (l - (SELECT sum(many * l) / sum(many) FROM hist)) ** 2) / (sum(many) - 1)) * 0.1 AS bw FROM hist),
dense AS (SELECT i, lo + (hi - lo) * i / 9999.0 AS x, hi, (SELECT sum(many * exp(-0.5 * ((lo + (hi - lo) * i / 9999.0 - l) / bw) ** 2)) FROM hist) AS d FROM shape, range(10000) t(i)),
minima AS (SELECT i, x, hi, (SELECT sum(many) FROM (SELECT n, count(*) AS many FROM counts GROUP BY n) WHERE n > 10 ** x) AS passing FROM (SELECT *, lag(d) OVER (ORDER BY i) AS before, lead(d) OVER (ORDER BY i) AS after FROM dense) WHERE d < before AND d < after)"""


@query("whitelist_density", f"{_BARCODES}, {_DENSE} SELECT cell, n FROM counts WHERE n > (SELECT 10 ** arg_max(x, i) FROM minima WHERE i >= 2000 AND (hi - x > 0.5 OR x < hi / 2))")
def whitelist_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = listing.WhitelistOptions(_BC, knee="density")
    return listing.choose(listing.barcode_counts(fx.barcode_reads(spark, sf_dir), options), options).select("cell", "n")


@query("whitelist_density_expected", f"{_BARCODES}, {_DENSE} SELECT cell, n FROM counts WHERE n > (SELECT 10 ** arg_max(x, i) FROM minima WHERE passing > 60 AND passing <= 600)")
def whitelist_density_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = listing.WhitelistOptions(_BC, knee="density", expect_cells=600)
    return listing.choose(listing.barcode_counts(fx.barcode_reads(spark, sf_dir), options), options).select("cell", "n")


# -------------------------------------------------------- groups and policies

_MATED = f"""{fx.DUCK_ALIGNMENTS}, firsts AS (SELECT ordinal * 2 AS ordinal, tid, start, is_reverse, umi, (flag & 4) <> 0 AS gone, ordinal % 3 = 0 AS alone, ordinal % 3 <> 0 AND ordinal % 5 = 0 AS apart, 110 + ordinal % 2 * 10 AS tlen FROM al),
role AS (SELECT *, CASE WHEN gone THEN 'gone' WHEN apart THEN 'apart' WHEN alone THEN 'alone' ELSE 'use' END AS role, CASE WHEN apart OR alone THEN 0 ELSE tlen END AS tlen_key FROM firsts)"""


def _mated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which some have their mates unmapped, and others on another contig."""
    rows, first = fx.paired_alignments(spark, sf_dir), F.col("ordinal") % 2 == 0
    at = F.floor(F.col("ordinal") / 2)
    return rows.withColumn("mtid", F.when(first & (at % 5 == 0), (F.col("tid") + 1) % 5).otherwise(F.col("mtid"))).withColumn("tlen", F.when(first, 110 + at % 2 * 10).otherwise(F.col("tlen")))


for _apart, _alone in (("use", "use"), ("output", "discard"), ("discard", "output"), ("use", "discard")):
    _used = f"role IN ('use'{''.join(f''', '{n}' ''' for n, p in (('apart', _apart), ('alone', _alone)) if p == 'use')})"
    _told = " OR ".join(["false", *[f"role = '{n}'" for n, p in (("apart", _apart), ("alone", _alone)) if p == "output"]])
    # Second reads are written as they are, and unmapped reads unless unmapped ones are discarded.
    _second = "ordinal % 3 <> 0" if _alone == "discard" else "true"
    _first = "" if _alone == "discard" else " UNION ALL SELECT ordinal, NULL FROM role WHERE role = 'gone'"

    def _policies(spark: SparkSession, sf_dir: str, chimeric: str = _apart, unmapped: str = _alone) -> DataFrame:
        options = grouping.GroupOptions("unique", KeyOptions(umi_from="umis", paired=True), chimeric=chimeric, unmapped=unmapped)
        return grouping.group(_mated(spark, sf_dir), options).select("ordinal", "umi_count")

    query(
        f"group_chimeric_{_apart}_unmapped_{_alone}",
        f"WITH {_MATED} SELECT ordinal, count(*) OVER (PARTITION BY tid, start, is_reverse, tlen_key, umi) AS umi_count FROM role WHERE {_used} UNION ALL SELECT ordinal, NULL FROM role WHERE {_told}{_first} UNION ALL SELECT ordinal * 2 + 1, NULL FROM al WHERE {_second}",
    )(_policies)


@query("group_tags", f"{_with(_groups_sql('directional', _AL_READS, _PLACE_KEYS))}, {_IDS.format(k='tid, start, is_reverse')} SELECT r.ordinal, CASE WHEN r.ordinal % 4 = 0 THEN 'own' ELSE led.lead END AS bx, 'i' AS ug_type, ids.unique_id::VARCHAR AS ug FROM reads r JOIN led USING (tid, start, is_reverse, umi) JOIN ids ON ids.tid = r.tid AND ids.start = r.start AND ids.is_reverse = r.is_reverse AND ids.lead = led.lead")
def group_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag that a read has already is kept."""
    own = F.map_concat("tags", F.create_map(F.lit("BX"), F.struct(F.lit("Z").alias("type"), F.lit("own").alias("value"))))
    al = fx.alignments(spark, sf_dir).withColumn("tags", F.when(F.col("ordinal") % 4 == 0, own).otherwise(F.col("tags")))
    tag = lambda name: F.element_at("tags", F.lit(name))
    return grouping.group(al, grouping.GroupOptions(keys=_PLACE)).select("ordinal", tag("BX")["value"].alias("bx"), tag("UG")["type"].alias("ug_type"), tag("UG")["value"].alias("ug"))


@query("group_gene_order", f"WITH {fx.DUCK_ALIGNMENTS}, runs AS (SELECT *, sum(cut) OVER (ORDER BY ordinal) - 1 AS run FROM (SELECT *, CASE WHEN tid = lag(tid) OVER (ORDER BY ordinal) THEN 0 ELSE 1 END AS cut FROM al WHERE (flag & 4) = 0 AND gene <> '__skip')), firsts AS (SELECT run, gene, umi, min(ordinal) AS first FROM runs GROUP BY ALL), ids AS (SELECT *, row_number() OVER (ORDER BY run, gene, first) - 1 AS unique_id FROM firsts) SELECT ordinal, unique_id FROM runs JOIN ids USING (run, gene, umi)")
def group_gene_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group(fx.alignments(spark, sf_dir), grouping.GroupOptions("unique", keys=_GENES)).select("ordinal", "unique_id")


@query("extract_filtered_out", f"{_FASTQ} SELECT ordinal, id, seq, CASE WHEN length(seq) < 8 THEN 'too_short' ELSE 'quality_filtered' END AS status FROM reads WHERE length(seq) < 8 OR regexp_matches(substr(qual, 1, 8), '[\\x00-\\x25]')")
def extract_filtered_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.filtered_out(extraction.extract(fx.fastq_reads(spark, sf_dir), extraction.ExtractOptions("NNNNNNNN", quality_threshold=5))).select("ordinal", "id", "seq", "status")


# ---------------------------------------------------------------- commands


@query("command_extract", f"{_FASTQ}, made AS (SELECT row_number() OVER (ORDER BY ordinal) - 1 AS r, '@' || {_HEAD} || '_' || substr(seq, 1, 4) || '_' || substr(seq, 5, 4) || {_TAIL} AS a, substr(seq, 9) AS b, substr(qual, 9) AS c FROM reads WHERE length(seq) >= 8) SELECT 4 * r + k AS ordinal, [a, b, '+', c][k + 1] AS value FROM made, range(4) t(k)")
def command_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    _command(spark, "extract", "-I", _fastq_file(spark, sf_dir, "r.fastq.gz"), "-S", out := _place(spark, "out.fastq"), "--bc-pattern", "CCCCNNNN")
    return _numbered(spark, out)


@query("command_extract_pairs", f"{_PAIR}, made AS (SELECT row_number() OVER (ORDER BY ordinal) - 1 AS r, '@' || {_HEAD} || '_' || substr(s1, 1, 6) || {_TAIL} AS a, s2 AS b, q2 AS c FROM pairs WHERE length(s1) >= 7) SELECT 4 * r + k AS ordinal, [a, b, '+', c][k + 1] AS value FROM made, range(4) t(k)")
def command_extract_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _command(spark, "extract", "-I", _fastq_file(spark, sf_dir, "1.fastq"), "--read2-in", _fastq_file(spark, sf_dir, "2.fastq", "m"), "--read2-stdout", "-S", out := _place(spark, "out.fastq"), "--bc-pattern", "NNNNNNX")
    return _numbered(spark, out)


@query("command_whitelist", f"{_BARCODES}, {_FIXED}, {_CORRECTED}, listed AS (SELECT c.cell, concat_ws(chr(9), c.cell, coalesce(string_agg(f.variant, ',' ORDER BY f.variant), ''), c.n, coalesce(string_agg(f.n::VARCHAR, ',' ORDER BY f.variant), '')) AS value FROM chosen c LEFT JOIN fix f ON f.barcode = c.cell GROUP BY c.cell, c.n) SELECT row_number() OVER (ORDER BY cell) - 1 AS ordinal, value FROM listed")
def command_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.one_file(sinks.fastq_lines(fx.barcode_reads(spark, sf_dir)), path := _place(spark, "b.fastq"))
    _command(spark, "whitelist", "-I", path, "-S", out := _place(spark, "out.tsv"), "--bc-pattern", _BC, "--set-cell-number", "30")
    return _numbered(spark, out)


@query("command_dedup", f"{_with(_groups_sql('directional', _AL_READS, _PLACE_KEYS))}, best AS (SELECT tid, start, is_reverse, umi, arg_max(ordinal, mapq) AS ordinal FROM reads GROUP BY ALL) SELECT row_number() OVER (ORDER BY al.tid, al.pos, al.ordinal) - 1 AS ordinal, al.mapq::INT AS mapq, {_DUCK_SHOWN.replace('umi AS', 'al.umi AS').replace('qname', 'al.qname').replace('tid,', 'al.tid,').replace('contig', 'al.contig')} FROM led JOIN best USING (tid, start, is_reverse, umi) JOIN al ON al.ordinal = best.ordinal WHERE led.umi = led.lead")
def command_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _command(spark, "dedup", "-I", _sam_file(spark, fx.alignments(spark, sf_dir)), "-S", out := _place(spark, "out.sam"), "--out-sam", "--extract-umi-method", "umis")
    return _shown(files.read(spark, "alignments", out, SPLIT), "ordinal", "mapq")


@query("command_group", f"{_with(_groups_sql('directional', _AL_READS, _PLACE_KEYS))}, {_IDS.format(k='tid, start, is_reverse')}, shown AS (SELECT r.qname, r.contig, r.pos, 'UMI_' || r.umi AS umi, led.n, 'UMI_' || led.lead AS lead, led.lead_n, ids.unique_id FROM reads r JOIN led USING (tid, start, is_reverse, umi) JOIN ids ON ids.tid = r.tid AND ids.start = r.start AND ids.is_reverse = r.is_reverse AND ids.lead = led.lead) SELECT 0 AS ordinal, concat_ws(chr(9), 'read_id', 'contig', 'position', 'gene', 'umi', 'umi_count', 'final_umi', 'final_umi_count', 'unique_id') AS value UNION ALL SELECT row_number() OVER (ORDER BY unique_id, umi, qname), concat_ws(chr(9), qname, contig, pos, 'NA', umi, n, lead, lead_n, unique_id) FROM shown")
def command_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    _command(spark, "group", "-I", _sam_file(spark, fx.alignments(spark, sf_dir)), "-S", _place(spark, "out.bam"), "--group-out", out := _place(spark, "out.tsv"), "--umi-separator", ":")
    return _numbered(spark, out)


_GENE_LED = _with(_groups_sql("directional", _GENE_READS, ["gene", "cell"]))


@query("command_count_wide", f"{_GENE_LED}, t AS (SELECT gene, concat_ws(chr(9), gene, {', '.join(f'''count(*) FILTER (cell = '{c}')''' for c in _CELLS)}) AS value FROM led WHERE umi = lead GROUP BY gene) SELECT 0 AS ordinal, concat_ws(chr(9), 'gene', {', '.join(repr(c) for c in _CELLS)}) AS value UNION ALL SELECT row_number() OVER (ORDER BY gene), value FROM t")
def command_count_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    _command(spark, "count", "-I", _sam_file(spark, fx.alignments(spark, sf_dir)), "-S", out := _place(spark, "out.tsv"), "--per-cell", "--wide-format-cell-counts", "--skip-tags-regex", "^__")
    return _numbered(spark, out)


@query("command_count_tab", f"{_with(_groups_sql('directional', _TAB, ['run', 'gene']))}, t AS (SELECT run, gene, count(*) AS count FROM led WHERE umi = lead GROUP BY run, gene) SELECT 0 AS ordinal, 'gene' || chr(9) || 'count' AS value UNION ALL SELECT row_number() OVER (ORDER BY run), gene || chr(9) || count FROM t")
def command_count_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.one_file(fx.tab_lines(spark, sf_dir).orderBy("ordinal").select("value"), path := _place(spark, "in.tsv"))
    _command(spark, "count_tab", "-I", path, "-S", out := _place(spark, "out.tsv"))
    return _numbered(spark, out)


@query("stream_of_groups", f"{_with(_groups_sql('directional', fx.DUCK_READS, KEYS))} SELECT contig, pos, is_reverse, umi, n, lead, lead_n FROM led")
def stream_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads come in coordinate order, in several files; their groups are those of the whole table."""
    reads = fx.umi_reads(spark, sf_dir).selectExpr("contig", "cast(pos * 5000 as bigint) AS start", "is_reverse", "cast(0 as bigint) AS tlen_key", "umi", "ordinal", f"cast({fx.TID.replace('event_type', 'contig')} as int) AS tid")
    folder, out = _place(spark, "in"), _place(spark, "out")
    # One contig after the other, so that files come in the order of coordinates; then one read behind the last.
    for k in range(len(fx.TYPES)):
        reads.where(F.col("tid") == k).drop("contig").coalesce(1).write.mode("append").parquet(folder)
    end = spark.range(1).selectExpr("cast(0 as bigint) AS start", "false AS is_reverse", "cast(0 as bigint) AS tlen_key", "cast(null as string) AS umi", "id AS ordinal", f"{len(fx.TYPES)} AS tid")
    end.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = group_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", _place(spark, "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).select(F.element_at(F.array(*map(F.lit, fx.TYPES)), F.col("tid") + 1).alias("contig"), (F.col("start") / 5000).cast("long").alias("pos"), "is_reverse", "umi", "n", "lead", "lead_n")
