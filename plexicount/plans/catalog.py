"""Every query over the barcode operators, with its oracle SQL.

Each query runs an operator over whole tables, by the projections of ``fixtures``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.cigar import group_position
from ..functions.distance import hamming, packed, packed_hamming, prefix_edit_distance
from ..functions.patterns import compile_pattern
from ..operators import count as counting
from ..operators import dedup as deduping
from ..operators import extract as extraction
from ..operators import group as grouping
from ..operators import null_model, stats
from ..operators import whitelist as listing
from ..operators.alignments import KeyOptions, best_reads, key_columns, keyed
from ..operators.kernels import METHODS, count_molecules, edges_of, relational_groups, umi_groups
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["contig", "pos", "is_reverse"]
DEEP_KEYS = ["contig", "pos"]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ------------------------------------------------------------ UMI clustering


def _obs(reads: DataFrame, keys: list[str]) -> DataFrame:
    return reads.groupBy(*keys, "umi").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


def _groups_sql(method: str, source: str, keys: list[str]) -> str:
    """A chain of CTEs that ends in ``led``: keys, umi, n, first, lead, lead_n."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    pre = lambda a: ", ".join(f"{a}.{c}" for c in keys)
    obs = f"{source}, obs AS MATERIALIZED (SELECT {k}, umi, count(*) AS n, min(ordinal) AS first FROM reads GROUP BY {k}, umi)"
    if method == "unique":
        return f"{obs}, led AS (SELECT *, umi AS lead, n AS lead_n FROM obs)"
    if method == "percentile":
        return f"{obs}, led AS (SELECT {k}, umi, n, first, umi AS lead, n AS lead_n FROM (SELECT *, median(n) OVER (PARTITION BY {k}) AS m FROM obs) WHERE 100 * n > m)"
    edge = "a.n >= 2 * b.n - 1" if method == "directional" else "true"
    seed = "s.n DESC, s.first" if method == "directional" else "s.n DESC, s.umi"
    near = f"near AS (SELECT {pre('e')}, e.a AS umi, min(r.r) AS near FROM edges e JOIN ranked r ON {on('e', 'r')} AND e.b = r.umi GROUP BY ALL)"
    chain = f"""{obs},
edges AS MATERIALIZED (SELECT {pre('a')}, a.umi AS a, b.umi AS b FROM obs a JOIN obs b ON {on('a', 'b')} AND a.umi <> b.umi AND length(a.umi) = length(b.umi) AND hamming(a.umi, b.umi) <= 1 AND {edge}),
reach AS (SELECT {k}, umi AS a, umi AS b FROM obs UNION SELECT {pre('r')}, r.a, e.b FROM reach r JOIN edges e ON {on('r', 'e')} AND r.b = e.a),
seeded AS (SELECT s.*, row_number() OVER (PARTITION BY {k} ORDER BY {seed}) AS seed_rank FROM obs s),
placed AS MATERIALIZED (SELECT {pre('r')}, r.b AS umi, min(s.seed_rank) AS c FROM reach r JOIN seeded s ON {on('r', 's')} AND r.a = s.umi GROUP BY ALL),
ranked AS MATERIALIZED (SELECT o.*, p.c, row_number() OVER (PARTITION BY {pre('o')}, p.c ORDER BY o.n DESC, o.umi) AS r FROM obs o JOIN placed p ON {on('o', 'p')} AND o.umi = p.umi)"""
    if method == "adjacency":
        chain += f""", {near},
bound AS (SELECT ranked.*, near.near, max(least(ranked.r, coalesce(near.near, ranked.r))) OVER (PARTITION BY {pre('ranked')}, ranked.c) AS last FROM ranked LEFT JOIN near ON {on('ranked', 'near')} AND ranked.umi = near.umi),
told AS MATERIALIZED (SELECT *, CASE WHEN r <= last THEN r ELSE near END AS lead_r FROM bound)"""
    else:
        chain += ", told AS MATERIALIZED (SELECT *, 1 AS lead_r FROM ranked)"
    return chain + f""",
led AS (SELECT {pre('t')}, t.umi, t.n, t.first, l.umi AS lead, sum(t.n) OVER (PARTITION BY {pre('t')}, t.c, t.lead_r)::BIGINT AS lead_n FROM told t JOIN told l ON {on('t', 'l')} AND t.c = l.c AND t.lead_r = l.r)"""


def _with(chain: str) -> str:
    return "WITH RECURSIVE " + chain


for _method in METHODS:

    def _leads(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        led = umi_groups(_obs(fx.umi_reads(spark, sf_dir), KEYS), KEYS, method)
        return led.where("umi = lead").select(*KEYS, "umi", "n", "lead_n")

    def _membership(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        return umi_groups(_obs(fx.umi_reads(spark, sf_dir), KEYS), KEYS, method).select(*KEYS, "umi", "n", "lead", "lead_n")

    def _deep(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        return count_molecules(_obs(fx.deep_reads(spark, sf_dir), DEEP_KEYS), DEEP_KEYS, method)

    def _relational(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        return relational_groups(_obs(fx.umi_reads(spark, sf_dir), KEYS), KEYS, method).select(*KEYS, "umi", "n", "lead", "lead_n")

    _sql = _with(_groups_sql(_method, fx.DUCK_READS, KEYS))
    query(f"leads_{_method}", f"{_sql} SELECT contig, pos, is_reverse, umi, n, lead_n FROM led WHERE umi = lead")(_leads)
    query(f"groups_{_method}", f"{_sql} SELECT contig, pos, is_reverse, umi, n, lead, lead_n FROM led")(_membership)
    query(f"molecules_deep_{_method}", f"{_with(_groups_sql(_method, fx.DUCK_DEEP, DEEP_KEYS))} SELECT contig, pos, count(*) AS count FROM led WHERE umi = lead GROUP BY contig, pos")(_deep)
    if _method in ("cluster", "adjacency", "directional"):
        query(f"groups_{_method}_by_joins", f"{_sql} SELECT contig, pos, is_reverse, umi, n, lead, lead_n FROM led")(_relational)


@query("umi_observations", f"WITH {fx.DUCK_READS} SELECT contig, pos, is_reverse, umi, count(*) AS n, min(ordinal) AS first FROM reads GROUP BY ALL")
def umi_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(fx.umi_reads(spark, sf_dir), KEYS)


@query("hamming_edges", f"WITH {fx.DUCK_READS}, obs AS (SELECT contig, pos, is_reverse, umi FROM reads GROUP BY ALL) SELECT a.contig, a.pos, a.is_reverse, a.umi AS a, b.umi AS b FROM obs a JOIN obs b ON a.contig = b.contig AND a.pos = b.pos AND a.is_reverse = b.is_reverse AND a.umi <> b.umi AND hamming(a.umi, b.umi) <= 1")
def hamming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(_obs(fx.umi_reads(spark, sf_dir), KEYS), KEYS).select(*KEYS, "a", "b")


@query("hamming_edges_two", f"WITH {fx.DUCK_READS}, obs AS (SELECT contig, pos, is_reverse, umi FROM reads GROUP BY ALL) SELECT a.contig, a.pos, a.is_reverse, a.umi AS a, b.umi AS b FROM obs a JOIN obs b ON a.contig = b.contig AND a.pos = b.pos AND a.is_reverse = b.is_reverse AND a.umi <> b.umi AND hamming(a.umi, b.umi) <= 2")
def hamming_edges_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(_obs(fx.umi_reads(spark, sf_dir), KEYS), KEYS, threshold=2).select(*KEYS, "a", "b")


@query("distances", f"WITH {fx.DUCK_READS}, u AS (SELECT DISTINCT umi FROM reads) SELECT a.umi AS a, b.umi AS b, hamming(a.umi, b.umi)::BIGINT AS far, hamming(a.umi, b.umi)::BIGINT AS packed_far, list_min(list_transform(range(0, 5), lambda k: levenshtein(a.umi, b.umi[1:k])))::BIGINT AS prefix_far FROM u a JOIN u b ON a.umi[1] = b.umi[1]")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    umis = fx.umi_reads(spark, sf_dir).select("umi").distinct()
    a, b = umis.select(F.col("umi").alias("a")), umis.select(F.col("umi").alias("b"))
    pairs = a.join(b, F.substring("a", 1, 1) == F.substring("b", 1, 1))
    return pairs.select("a", "b", hamming(F.col("a"), F.col("b")).alias("far"), packed_hamming(packed(F.col("a")), packed(F.col("b"))).cast("long").alias("packed_far"), prefix_edit_distance(F.col("a"), F.col("b")).cast("long").alias("prefix_far"))


# --------------------------------------------------------------- extraction

_FASTQ = "WITH " + fx.duck_fastq("reads")
_HEAD = "split_part(id, ' ', 1)"
_TAIL = "' ' || substr(id, strpos(id, ' ') + 1)"


def _kept(reads: DataFrame, options: extraction.ExtractOptions) -> DataFrame:
    return extraction.kept(extraction.extract(reads, options)).select("ordinal", "id", "seq", "qual")


@query("extract_string_5p", f"{_FASTQ} SELECT ordinal, {_HEAD} || '_' || substr(seq, 1, 3) || substr(seq, 8, 2) || {_TAIL} AS id, substr(seq, 4, 4) || substr(seq, 10) AS seq, substr(qual, 4, 4) || substr(qual, 10) AS qual FROM reads WHERE length(seq) >= 9")
def extract_string_5p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(fx.fastq_reads(spark, sf_dir), extraction.ExtractOptions("NNNXXXXNN"))


@query("extract_string_3p", f"{_FASTQ} SELECT ordinal, {_HEAD} || '_' || substr(seq, length(seq) - 6, 3) || substr(seq, length(seq) - 1, 2) || {_TAIL} AS id, substr(seq, 1, length(seq) - 7) || substr(seq, length(seq) - 3, 2) AS seq, substr(qual, 1, length(qual) - 7) || substr(qual, length(qual) - 3, 2) AS qual FROM reads WHERE length(seq) >= 7")
def extract_string_3p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(fx.fastq_reads(spark, sf_dir), extraction.ExtractOptions("NNNXXNN", three_prime=True))


@query("extract_cell", f"{_FASTQ} SELECT ordinal, {_HEAD} || '_' || substr(seq, 1, 8) || '_' || substr(seq, 9, 6) || {_TAIL} AS id, substr(seq, 15) AS seq, substr(qual, 15) AS qual FROM reads WHERE length(seq) >= 14")
def extract_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(fx.fastq_reads(spark, sf_dir), extraction.ExtractOptions("CCCCCCCCNNNNNN"))


@query("extract_regex_fixed", f"{_FASTQ} SELECT ordinal, {_HEAD} || '_' || substr(seq, 1, 3) || '_' || substr(seq, 4, 4) || {_TAIL} AS id, substr(seq, 10) AS seq, substr(qual, 10) AS qual FROM reads WHERE length(seq) >= 9")
def extract_regex_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(fx.fastq_reads(spark, sf_dir), extraction.ExtractOptions("^(?P<cell_1>.{3})(?P<umi_1>.{4})(?P<discard_1>.{2})", method="regex"))


_FUZZY_AT = "length(regexp_extract(seq, '^(.*?)ACG..{4}', 1))"


@query("extract_regex_fuzzy", f"{_FASTQ} SELECT ordinal, {_HEAD} || '_' || substr(seq, {_FUZZY_AT} + 5, 4) || {_TAIL} AS id, substr(seq, 1, {_FUZZY_AT}) || substr(seq, {_FUZZY_AT} + 9) AS seq, substr(qual, 1, {_FUZZY_AT}) || substr(qual, {_FUZZY_AT} + 9) AS qual FROM reads WHERE regexp_matches(seq, 'ACG..{{4}}')".replace("{{4}}", "{4}"))
def extract_regex_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(fx.fastq_reads(spark, sf_dir), extraction.ExtractOptions("(?P<discard_1>ACGT{s<=1})(?P<umi_1>.{4})", method="regex"))


@query("extract_quality_filter", f"{_FASTQ} SELECT ordinal, substr(seq, 1, 5) AS umi FROM reads WHERE length(seq) >= 5 AND NOT regexp_matches(substr(qual, 1, 5), '[\\x00-\\x34]')")
def extract_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.kept(extraction.extract(fx.fastq_reads(spark, sf_dir), extraction.ExtractOptions("NNNNN", quality_threshold=20))).select("ordinal", "umi")


@query("extract_counters", f"{_FASTQ} SELECT CASE WHEN length(seq) < 9 THEN 'too_short' WHEN regexp_matches(substr(qual, 1, 9), '[\\x00-\\x25]') THEN 'quality_filtered' ELSE 'output' END AS status, count(*) AS n FROM reads GROUP BY 1")
def extract_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.counters(extraction.extract(fx.fastq_reads(spark, sf_dir), extraction.ExtractOptions("NNNNNNNNN", quality_threshold=5)))


_PAIR = f"{_FASTQ}, {fx.duck_fastq('mates', 'm')}, pairs AS (SELECT a.ordinal, a.id, a.seq AS s1, a.qual AS q1, b.seq AS s2, b.qual AS q2 FROM reads a JOIN mates b USING (ordinal))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.zip_pairs(fx.fastq_reads(spark, sf_dir), fx.fastq_reads(spark, sf_dir, "m"))


@query("extract_pairs_lockstep", f"{_PAIR} SELECT ordinal, {_HEAD} || '_' || substr(s2, 1, 6) || {_TAIL} AS id, s1, substr(s2, 7) AS s2 FROM pairs WHERE length(s2) >= 6")
def extract_pairs_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.kept(extraction.extract_second(_pairs(spark, sf_dir), extraction.ExtractOptions(pattern2="NNNNNN")))
    return found.select("ordinal", "out1.id", F.col("out1.seq").alias("s1"), F.col("out2.seq").alias("s2"))


@query("extract_pairs_reconciled", f"{_PAIR} SELECT ordinal, {_HEAD} || '_' || substr(s1, 1, 6) || {_TAIL} AS id, s2 FROM pairs WHERE ordinal % 3 = 0 AND length(s1) >= 6")
def extract_pairs_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = extraction.reconcile_pairs(fx.fastq_reads(spark, sf_dir, keep="event_id % 3 = 0"), fx.fastq_reads(spark, sf_dir, "m"))
    found = extraction.kept(extraction.extract_first_to_second(pairs, extraction.ExtractOptions("NNNNNN")))
    return found.select("ordinal", "out2.id", F.col("out2.seq").alias("s2"))


_LISTS = "wl AS (SELECT DISTINCT substr(seq, 1, 3) AS b FROM reads WHERE ordinal % 400 = 1), fix AS (SELECT substr(seq, 1, 3) AS v, max(substr(seq, 5, 3)) AS b FROM reads WHERE ordinal % 300 = 2 GROUP BY 1), bl AS (SELECT DISTINCT substr(seq, 1, 3) AS b FROM reads WHERE ordinal % 1000 = 7)"


@query("extract_whitelist_corrected", f"{_PAIR}, {_LISTS}, c AS (SELECT *, substr(s1, 1, 3) AS cell FROM pairs WHERE length(s1) >= 7) SELECT ordinal, {_HEAD} || '_' || CASE WHEN cell IN (SELECT b FROM wl) THEN cell ELSE fix.b END || '_' || substr(s1, 4, 4) || {_TAIL} AS id, s2 FROM c LEFT JOIN fix ON c.cell = fix.v WHERE cell NOT IN (SELECT b FROM bl) AND (cell IN (SELECT b FROM wl) OR fix.b IS NOT NULL)")
def extract_whitelist_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fx.fastq_reads(spark, sf_dir)
    white = reads.where("ordinal % 400 = 1").selectExpr("substr(seq, 1, 3) AS barcode")
    fix = reads.where("ordinal % 300 = 2").groupBy(F.expr("substr(seq, 1, 3)").alias("variant")).agg(F.expr("max(substr(seq, 5, 3))").alias("barcode"))
    black = reads.where("ordinal % 1000 = 7").selectExpr("substr(seq, 1, 3) AS barcode")
    found = extraction.kept(extraction.extract_first_to_second(_pairs(spark, sf_dir), extraction.ExtractOptions("CCCNNNN"), white, fix, black))
    return found.select("ordinal", "out2.id", F.col("out2.seq").alias("s2"))


_ONE, _TWO = "regexp_matches(s1, '^AC')", "regexp_matches(s2, '^GT')"


@query("extract_either_read", f"{_PAIR} SELECT ordinal, {_HEAD} || '_' || CASE WHEN {_ONE} THEN substr(s1, 3, 4) ELSE substr(s2, 3, 4) END || {_TAIL} AS id, CASE WHEN {_ONE} THEN substr(s1, 7) ELSE s1 END AS s1, CASE WHEN {_TWO} THEN substr(s2, 7) ELSE s2 END AS s2 FROM pairs WHERE (regexp_matches(s1, '^AC.{{4}}') AND NOT regexp_matches(s2, '^GT.{{4}}')) OR (NOT regexp_matches(s1, '^AC.{{4}}') AND regexp_matches(s2, '^GT.{{4}}'))")
def extract_either_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = extraction.ExtractOptions("^(?P<discard_1>AC)(?P<umi_1>.{4})", "^(?P<discard_1>GT)(?P<umi_1>.{4})", method="regex")
    found = extraction.kept(extraction.extract_either(_pairs(spark, sf_dir), options))
    return found.select("ordinal", "out1.id", F.col("out1.seq").alias("s1"), F.col("out2.seq").alias("s2"))


# ------------------------------------------------------- names and positions


@query("umi_names", f"WITH {fx.DUCK_ALIGNMENTS} SELECT ordinal, umi, cell, umi AS tag_umi, qname AS plain FROM al")
def umi_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.alignments(spark, sf_dir)
    return a.select("ordinal", names.umi_field(F.col("qname")).alias("umi"), names.cell_field(F.col("qname")).alias("cell"), names.tag(F.col("tags"), "RX").alias("tag_umi"), names.umi_from_name(F.col("qname"), "#").alias("plain"))


@query("cigar_position", f"WITH {fx.DUCK_ALIGNMENTS} SELECT ordinal, cigar, is_reverse, start::BIGINT AS start FROM al")
def cigar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    reverse = F.col("flag").bitwiseAND(16) != 0
    return fx.alignments(spark, sf_dir).select("ordinal", "cigar", reverse.alias("is_reverse"), group_position(F.col("pos"), F.col("cigar"), reverse).alias("start"))


# ------------------------------------------------------------- alignments

_PLACE = KeyOptions(umi_from="umis")
_PLACE_KEYS = key_columns(_PLACE)
_AL_READS = f"{fx.DUCK_ALIGNMENTS}, reads AS (SELECT *, 0 AS tlen_key FROM al WHERE (flag & 4) = 0)"
_GENE_READS = f"{fx.DUCK_ALIGNMENTS}, reads AS (SELECT * FROM al WHERE (flag & 4) = 0 AND gene <> '__skip')"
_GENES = KeyOptions(umi_from="umis", per_gene=True, skip_tags="^__")


@query("best_read", f"WITH {_AL_READS} SELECT tid, start::BIGINT AS start, is_reverse, umi, count(*) AS n, min(ordinal) AS first, arg_max(ordinal, mapq) AS best FROM reads GROUP BY ALL")
def best_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_reads(keyed(fx.alignments(spark, sf_dir), _PLACE), _PLACE_KEYS).drop("tlen_key")


for _method in METHODS:

    def _dedup(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        return deduping.dedup(fx.alignments(spark, sf_dir), deduping.DedupOptions(method, keys=_PLACE)).select("ordinal", "qname", "tid", "pos", "mapq", "cigar")

    query(f"dedup_{_method}", f"{_with(_groups_sql(_method, _AL_READS, _PLACE_KEYS))}, best AS (SELECT tid, start, is_reverse, umi, arg_max(ordinal, mapq) AS ordinal FROM reads GROUP BY ALL) SELECT al.ordinal, al.qname, al.tid, al.pos, al.mapq::INT AS mapq, al.cigar FROM led JOIN best USING (tid, start, is_reverse, umi) JOIN al ON al.ordinal = best.ordinal WHERE led.umi = led.lead")(_dedup)


_GENE_BEST = "best AS (SELECT gene, umi, arg_max(ordinal, mapq) AS ordinal FROM reads GROUP BY ALL)"


@query("dedup_per_gene", f"{_with(_groups_sql('directional', _GENE_READS, ['gene']))}, {_GENE_BEST} SELECT best.ordinal, led.gene, led.umi FROM led JOIN best USING (gene, umi) WHERE led.umi = led.lead")
def dedup_per_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = deduping.leads(fx.alignments(spark, sf_dir), deduping.DedupOptions(keys=_GENES))
    return led.select(F.col("best").alias("ordinal"), "gene", "umi")


@query("dedup_ignore_umi", f"WITH {_AL_READS} SELECT arg_max(ordinal, mapq) AS ordinal FROM reads GROUP BY tid, start, is_reverse")
def dedup_ignore_umi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduping.dedup(fx.alignments(spark, sf_dir), deduping.DedupOptions("unique", keys=KeyOptions(ignore_umi=True))).select("ordinal")


@query("dedup_chrom", f"WITH {_AL_READS} SELECT arg_max(ordinal, mapq) AS ordinal FROM reads WHERE contig = 'view' GROUP BY tid, start, is_reverse, umi")
def dedup_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduping.dedup(fx.alignments(spark, sf_dir), deduping.DedupOptions("unique", keys=KeyOptions(umi_from="tag", chrom="view"))).select("ordinal")


_PAIRED_READS = f"{fx.DUCK_ALIGNMENTS}, reads AS (SELECT * EXCLUDE (ordinal), ordinal * 2 AS ordinal FROM al WHERE (flag & 4) = 0 AND ordinal % 3 <> 0)"


@query("dedup_paired", f"WITH {_PAIRED_READS}, best AS (SELECT tid, start, is_reverse, umi, arg_max(ordinal, mapq) AS ordinal FROM reads GROUP BY ALL) SELECT ordinal FROM best UNION ALL SELECT ordinal + 1 FROM best")
def dedup_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduping.dedup(fx.paired_alignments(spark, sf_dir), deduping.DedupOptions("unique", keys=KeyOptions(umi_from="umis", paired=True))).select("ordinal")


@query("dedup_umi_whitelist", f"{_with(_groups_sql('directional', _AL_READS, _PLACE_KEYS))}, listed AS (SELECT a.u || b.u AS umi FROM (SELECT DISTINCT substr(umi, 1, 2) AS u FROM al WHERE ordinal % 5 = 0) a, (SELECT DISTINCT substr(umi, 3, 2) AS u FROM al WHERE ordinal % 11 = 0) b), best AS (SELECT tid, start, is_reverse, umi, arg_max(ordinal, mapq) AS ordinal FROM reads GROUP BY ALL) SELECT best.ordinal FROM led JOIN best USING (tid, start, is_reverse, umi) WHERE led.umi = led.lead AND led.umi IN (SELECT umi FROM listed)")
def dedup_umi_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = fx.alignments(spark, sf_dir)
    half = lambda cut, at: al.where(cut).select(F.substring(names.umi_field(F.col("qname")), at, 2).alias("umi")).distinct()
    return deduping.dedup(al, deduping.DedupOptions(keys=_PLACE), deduping.whitelist_product(half("ordinal % 5 = 0", 1), half("ordinal % 11 = 0", 3))).select("ordinal")


@query("dedup_summary", f"{_with(_groups_sql('directional', _AL_READS, _PLACE_KEYS))} SELECT (SELECT count(*) FROM reads) AS input_reads, count(*) FILTER (umi = lead) AS output_reads, count(DISTINCT (tid, start, is_reverse)) AS positions FROM led")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduping.summary(fx.alignments(spark, sf_dir), deduping.DedupOptions(keys=_PLACE))


_IDS = "ids AS (SELECT {k}, lead, row_number() OVER (ORDER BY {k}, -lead_top, lead_first) - 1 AS unique_id FROM (SELECT {k}, lead, max(n) AS lead_top, min(first) FILTER (n = top) AS lead_first FROM (SELECT *, max(n) OVER (PARTITION BY {k}, lead) AS top FROM led) GROUP BY ALL))"


@query("group_directional", f"{_with(_groups_sql('directional', _AL_READS, _PLACE_KEYS))}, {_IDS.format(k='tid, start, is_reverse')} SELECT r.qname AS read_id, r.contig, r.pos AS position, 'NA' AS gene, r.umi, led.n AS umi_count, led.lead AS final_umi, led.lead_n AS final_umi_count, ids.unique_id FROM reads r JOIN led USING (tid, start, is_reverse, umi) JOIN ids ON ids.tid = r.tid AND ids.start = r.start AND ids.is_reverse = r.is_reverse AND ids.lead = led.lead")
def group_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_table(grouping.group(fx.alignments(spark, sf_dir), grouping.GroupOptions(keys=_PLACE)))


@query("group_unmapped_output", f"WITH {fx.DUCK_ALIGNMENTS} SELECT ordinal, (flag & 4) = 0 AS grouped FROM al")
def group_unmapped_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = grouping.group(fx.alignments(spark, sf_dir), grouping.GroupOptions("unique", keys=_PLACE, output_unmapped=True))
    return grouped.select("ordinal", F.col("unique_id").isNotNull().alias("grouped"))


_RUNS = "runs AS (SELECT *, sum(cut) OVER (ORDER BY ordinal) - 1 AS run FROM (SELECT *, CASE WHEN tid = lag(tid) OVER (ORDER BY ordinal) THEN 0 ELSE 1 END AS cut FROM al WHERE (flag & 4) = 0 AND {where}))"
_SKIPPED, _NOT_ERROR = "gene <> '__skip'", "contig <> 'error'"


@query("group_per_gene", f"WITH {fx.DUCK_ALIGNMENTS}, {_RUNS.format(where=_SKIPPED)} SELECT ordinal, umi, gene, count(*) OVER (PARTITION BY run, gene, umi) AS umi_count FROM runs")
def group_per_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = grouping.group(fx.alignments(spark, sf_dir), grouping.GroupOptions("unique", keys=_GENES))
    return grouped.select("ordinal", "umi", "gene", "umi_count")


@query("group_per_contig", f"WITH {fx.DUCK_ALIGNMENTS}, {_RUNS.format(where=_NOT_ERROR)} SELECT ordinal, umi, contig AS gene, count(*) OVER (PARTITION BY run, contig, umi) AS umi_count FROM runs")
def group_per_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contig is the gene: tags differ from it here or are missing, and don't count."""
    tags = F.when(F.col("ordinal") % 3 == 0, F.map_filter("tags", lambda k, _: k != "XF")).otherwise(F.map_concat(F.map_filter("tags", lambda k, _: k != "XF"), F.create_map(F.lit("XF"), F.struct(F.lit("Z").alias("type"), F.lit("other").alias("value")))))
    al = fx.alignments(spark, sf_dir).withColumn("tags", tags)
    grouped = grouping.group(al, grouping.GroupOptions("unique", keys=KeyOptions(umi_from="umis", per_gene=True, skip_tags="^error$"), per_contig=True))
    return grouped.select("ordinal", "umi", "gene", "umi_count")


# ------------------------------------------------------------------ counts

_CELL_COUNT = "SELECT gene, cell, count(*) AS count FROM led WHERE umi = lead GROUP BY gene, cell"


@query("count_gene", f"{_with(_groups_sql('directional', _GENE_READS, ['gene']))} SELECT gene, count(*) AS count FROM led WHERE umi = lead GROUP BY gene")
def count_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count(fx.alignments(spark, sf_dir), _GENES)


@query("count_cells_long", f"{_with(_groups_sql('directional', _GENE_READS, ['gene', 'cell']))} {_CELL_COUNT}")
def count_cells_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count(fx.alignments(spark, sf_dir), _GENES, per_cell=True)


_CELLS = [f"C{k}" for k in range(10)]


@query("count_cells_wide", f"{_with(_groups_sql('directional', _GENE_READS, ['gene', 'cell']))} SELECT gene, {', '.join(f'''count(*) FILTER (cell = '{c}') AS {c}''' for c in _CELLS)} FROM led WHERE umi = lead GROUP BY gene")
def count_cells_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.wide(fx.alignments(spark, sf_dir), _GENES)


_TAB = f"rows AS (SELECT event_id AS ordinal, event_type AS gene, 'C' || (user_id % 10) AS cell, {fx.duck_sql(fx.UMI)} AS umi FROM events), reads AS (SELECT *, (sum(cut) OVER (ORDER BY ordinal) - 1)::BIGINT AS run FROM (SELECT *, CASE WHEN gene = lag(gene) OVER (ORDER BY ordinal) THEN 0 ELSE 1 END AS cut FROM rows))"


@query("count_tab_runs", f"{_with(_groups_sql('directional', _TAB, ['run', 'gene']))} SELECT run, gene, count(*) AS count FROM led WHERE umi = lead GROUP BY run, gene")
def count_tab_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tab(fx.tab_lines(spark, sf_dir))


@query("count_tab_cells", f"{_with(_groups_sql('directional', _TAB, ['run', 'gene', 'cell']))} SELECT run, gene, cell, count(*) AS count FROM led WHERE umi = lead GROUP BY run, gene, cell")
def count_tab_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tab(fx.tab_lines(spark, sf_dir), per_cell=True).select("run", "gene", "cell", "count")


# --------------------------------------------------------------- whitelists

_BARCODES = f"WITH {fx.DUCK_BARCODES}"
_BC = "CCCCCCCC"
_FIXED = "chosen AS (SELECT cell, n, first FROM counts WHERE n > (SELECT n FROM counts ORDER BY n DESC LIMIT 1 OFFSET 29))"
_CORRECTED = "near AS (SELECT c.cell AS variant, c.n, w.cell AS barcode, count(*) OVER (PARTITION BY c.cell) AS k FROM counts c JOIN chosen w ON hamming(c.cell, w.cell) <= 1 WHERE c.cell NOT IN (SELECT cell FROM chosen)), fix AS (SELECT barcode, variant, n FROM near WHERE k = 1)"


@query("barcode_counts", f"{_BARCODES} SELECT cell, n FROM counts")
def barcode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.barcode_counts(fx.barcode_reads(spark, sf_dir), listing.WhitelistOptions(_BC)).select("cell", "n")


@query("whitelist_fixed_n", f"{_BARCODES}, {_FIXED} SELECT cell, n FROM chosen")
def whitelist_fixed_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = listing.WhitelistOptions(_BC, cell_number=30)
    return listing.choose(listing.barcode_counts(fx.barcode_reads(spark, sf_dir), options), options).select("cell", "n")


def _knee_sql(steps: int = 12) -> str:
    """The knee's search unrolled; ``chosen`` has the barcodes above it."""
    far = "abs((x - 0) * (ly - fy) - (y - fy) * lx) / sqrt(lx * lx + (ly - fy) * (ly - fy))"
    one = lambda k, end: f"k{k} AS (SELECT x AS knee FROM (SELECT x, {far} AS d FROM (SELECT x, y, max(x) OVER () AS lx, first_value(y) OVER (ORDER BY x) AS fy, max(y) OVER () AS ly FROM curve WHERE x < {end}) WHERE lx > 0) ORDER BY round(d, 6) DESC, x LIMIT 1)"
    chain = ["curve AS (SELECT cell, n, first, (row_number() OVER w) - 1 AS x, sum(n) OVER w::DOUBLE AS y FROM counts WINDOW w AS (ORDER BY n DESC, first, cell ROWS UNBOUNDED PRECEDING))".replace("sum(n) OVER w::DOUBLE", "(sum(n) OVER w)::DOUBLE"), one(0, "1e18")]
    chain += [one(k, f"least(3 * (SELECT knee FROM k{k - 1}), (SELECT count(*) FROM curve))") for k in range(1, steps)]
    return ", ".join(chain) + f", chosen AS (SELECT cell, n, first FROM curve WHERE x <= (SELECT knee FROM k{steps - 1}))"


@query("whitelist_distance", f"{_BARCODES}, {_knee_sql()} SELECT count(*) AS cells, min(n) AS least, sum(n)::BIGINT AS reads FROM chosen")
def whitelist_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = listing.WhitelistOptions(_BC)
    chosen = listing.choose(listing.barcode_counts(fx.barcode_reads(spark, sf_dir), options), options)
    return chosen.agg(F.count("*").alias("cells"), F.min("n").alias("least"), F.sum("n").alias("reads"))


@query("whitelist_corrections", f"{_BARCODES}, {_FIXED}, {_CORRECTED} SELECT barcode, variant, n FROM fix")
def whitelist_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = listing.WhitelistOptions(_BC, cell_number=30)
    counts = listing.barcode_counts(fx.barcode_reads(spark, sf_dir), options)
    return listing.corrections(counts, listing.choose(counts, options))


@query("whitelist_table", f"{_BARCODES}, {_FIXED}, {_CORRECTED} SELECT c.cell AS barcode, coalesce(string_agg(f.variant, ',' ORDER BY f.variant), '') AS variants, c.n, coalesce(string_agg(f.n::VARCHAR, ',' ORDER BY f.variant), '') AS variant_counts FROM chosen c LEFT JOIN fix f ON f.barcode = c.cell GROUP BY c.cell, c.n")
def whitelist_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.whitelist_table(listing.whitelist(fx.barcode_reads(spark, sf_dir), listing.WhitelistOptions(_BC, cell_number=30)))


_ALL = "chosen AS (SELECT * FROM counts)"
_MISSES = "missed AS (SELECT a.cell, a.n, count(*) AS misses, min(b.cell) AS one FROM chosen a JOIN chosen b ON (b.n > a.n OR (b.n = a.n AND b.first > a.first)) AND list_min(list_transform(range(0, 9), lambda k: levenshtein(a.cell, b.cell[1:k]))) <= 1 GROUP BY a.cell, a.n)"


@query("whitelist_near_misses", f"{_BARCODES}, {_ALL}, {_MISSES} SELECT cell, n, misses, one FROM missed")
def whitelist_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.near_misses(listing.barcode_counts(fx.barcode_reads(spark, sf_dir), listing.WhitelistOptions(_BC)))


# -------------------------------------------------------------- statistics

_STATS = _with(_groups_sql("directional", fx.DUCK_READS, KEYS)) + ", post AS (SELECT contig, pos, is_reverse, umi, lead_n AS n FROM led WHERE umi = lead)"


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = _obs(fx.umi_reads(spark, sf_dir), KEYS)
    return obs, stats.totals(umi_groups(obs, KEYS))


@query("stats_per_umi_per_position", f"{_STATS} SELECT counts, coalesce(a, 0) AS instances_pre, coalesce(b, 0) AS instances_post FROM (SELECT n AS counts, count(*) AS a FROM obs GROUP BY n) FULL JOIN (SELECT n AS counts, count(*) AS b FROM post GROUP BY n) USING (counts)")
def stats_per_umi_per_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_umi_per_position(*_observed(spark, sf_dir))


_TALLY = "SELECT umi, trunc(median(n))::BIGINT AS median_counts_{w}, count(*) AS times_observed_{w}, sum(n)::BIGINT AS total_counts_{w} FROM {t} GROUP BY umi"


@query("stats_per_umi", f"{_STATS} SELECT umi, {', '.join(f'coalesce({c}_{w}, 0) AS {c}_{w}' for w in ('pre', 'post') for c in ('median_counts', 'times_observed', 'total_counts'))} FROM ({_TALLY.format(w='pre', t='obs')}) FULL JOIN ({_TALLY.format(w='post', t='post')}) USING (umi)")
def stats_per_umi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_umi(*_observed(spark, sf_dir))


_ADJACENT = _with(_groups_sql("adjacency", fx.DUCK_READS, KEYS)) + """, tops AS (SELECT * FROM led WHERE umi = lead),
moved AS (SELECT a.contig, a.pos, a.is_reverse, a.umi, a.n, arg_min(b.umi, row(-b.n, b.umi)) AS into_umi FROM tops a JOIN tops b ON a.contig = b.contig AND a.pos = b.pos AND a.is_reverse = b.is_reverse AND a.umi <> b.umi
    AND hamming(a.umi, b.umi) <= 1 AND (b.n > a.n OR (b.n = a.n AND b.umi < a.umi)) GROUP BY ALL),
extra AS (SELECT contig, pos, is_reverse, into_umi AS umi, sum(n) AS more FROM moved GROUP BY ALL)"""


@query("stats_totals_adjacency", f"{_ADJACENT} SELECT contig, pos, is_reverse, umi, (lead_n + coalesce(more, 0))::BIGINT AS n FROM tops LEFT JOIN extra USING (contig, pos, is_reverse, umi)")
def stats_totals_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = umi_groups(_obs(fx.umi_reads(spark, sf_dir), KEYS), KEYS, "adjacency")
    return stats.totals(led, KEYS, "adjacency").select(*KEYS, "umi", "n")


_MEAN = "SELECT a.contig, a.pos, a.is_reverse, coalesce(avg(hamming(a.umi, b.umi)), -1) AS d FROM {t} a LEFT JOIN {t} b ON a.contig = b.contig AND a.pos = b.pos AND a.is_reverse = b.is_reverse AND a.umi < b.umi GROUP BY ALL"
_BIN = "SELECT CASE WHEN d <= -1 THEN 0 ELSE ceil(d)::BIGINT + 1 END AS bin, count(*) AS {c} FROM (" + _MEAN + ") GROUP BY 1"


@query("stats_edit_distance", f"{_STATS}, a AS ({_BIN.format(c='u', t='obs')}), b AS ({_BIN.format(c='v', t='post')}), bins AS (SELECT unnest(range(0, (SELECT max(bin) FROM (SELECT bin FROM a UNION ALL SELECT bin FROM b)) + 2)) AS bin) SELECT bins.bin, CASE WHEN bins.bin = 0 THEN 'Single_UMI' ELSE (bins.bin - 1)::VARCHAR END AS edit_distance, coalesce(u, 0) AS \"unique\", coalesce(v, 0) AS deduplicated FROM bins LEFT JOIN a ON a.bin = bins.bin LEFT JOIN b ON b.bin = bins.bin")
def stats_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edit_distance(*_observed(spark, sf_dir), KEYS)


@query("null_model_distances")
def null_model_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fx.umi_reads(spark, sf_dir)
    sizes = _obs(reads, KEYS).groupBy(*KEYS).agg(F.count("*").alias("size")).withColumn("group_id", F.xxhash64(*KEYS))
    return null_model.null_distances(sizes, null_model.umi_frequencies(reads))


@query("umi_frequencies", f"WITH {fx.DUCK_READS} SELECT umi, count(*) AS n, min(ordinal) AS first FROM reads GROUP BY umi")
def umi_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_model.umi_frequencies(fx.umi_reads(spark, sf_dir))


@query("patterns_agree", f"{_FASTQ} SELECT count(*) AS reads, count(*) AS agree FROM reads WHERE length(seq) >= 9")
def patterns_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string pattern and an expression for the same positions, the latter through the matcher."""
    text = compile_pattern("NNNXXXXNN")
    same = compile_pattern("^(?P<umi_1>[ACGT]{3}).{4}(?P<umi_2>.{2})", "regex")
    reads = fx.fastq_reads(spark, sf_dir).select(text.extract(F.col("seq"), F.col("qual")).alias("a"), same.extract(F.col("seq"), F.col("qual")).alias("b"))
    return reads.where("a IS NOT NULL").agg(F.count("*").alias("reads"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("agree"))
