"""Projections of the driver's tables that stand in for sequencing data.

The same expressions run in Spark and in DuckDB; where the two differ in spelling
there are two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, ACG = "0123456789abcdef", "ACGTACGTACGTACGT"
TYPES = ("click", "error", "purchase", "signup", "view")
CIGARS = ("10M", "5S10M", "10M5S", "3S10M2D5M4S", "2H3S10M", "5M100N5M", "4S6M1I3M2H")


def _acgt(text: str, at: int, n: int) -> str:
    return f"translate(substr(md5({text}), {at}, {n}), '{HEX}', '{ACG}')"


_H = "((event_id * event_id) % 101)"
_U0 = _acgt(f"'u' || cast({_H} % 40 as {{text}})", 1, 4)
UMI = f"CASE WHEN event_id * 31 % 11 = 0 THEN substr('ACGT', cast({_H} % 4 as int) + 1, 1) || substr({_U0}, 2) WHEN event_id * 31 % 11 = 1 THEN substr({_U0}, 1, 3) || substr('ACGT', cast({_H} % 4 as int) + 1, 1) ELSE {_U0} END"
_U1 = _acgt("'p' || cast(l_partkey % 16 as {text})", 1, 6)
DEEP_UMI = f"CASE WHEN (l_orderkey * 7 + l_partkey) % 1999 = 0 THEN 'A' || substr({_U1}, 2) ELSE {_U1} END"
_CELL = _acgt("'b' || cast((l_partkey * l_partkey) % 300 as {text})", 1, 8)
BARCODE = f"CASE WHEN (l_orderkey * 7 + l_partkey) % 97 = 0 THEN substr({_CELL}, 1, 7) || substr('ACGT', cast(l_orderkey % 4 as int) + 1, 1) ELSE {_CELL} END"
TID = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(TYPES)) + " ELSE 5 END"
CIGAR = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CIGARS)) + " END"
FLAG = "(CASE WHEN event_id % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN event_id % 17 = 0 THEN 4 ELSE 0 END)"
SEQ = f"CASE WHEN event_id % 50 = 0 THEN substr({{s}}, 1, 6) ELSE {{s}} END"
_QUAL = "#$%&+05:?ABCDEFG"


def spark_sql(text: str) -> str:
    return text.replace("{text}", "string")


def duck_sql(text: str) -> str:
    return text.replace("{text}", "varchar")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def umi_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, contig, pos, is_reverse, umi."""
    return _read(spark, sf_dir, "events").selectExpr("event_id AS ordinal", "event_type AS contig", "user_id % 10 AS pos", "event_id % 2 = 0 AS is_reverse", f"{spark_sql(UMI)} AS umi")


DUCK_READS = f"reads AS (SELECT event_id AS ordinal, event_type AS contig, user_id % 10 AS pos, event_id % 2 = 0 AS is_reverse, {duck_sql(UMI)} AS umi FROM events)"


def deep_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ordinal", "l_returnflag AS contig", "l_linestatus AS pos", f"{spark_sql(DEEP_UMI)} AS umi")


DUCK_DEEP = f"reads AS (SELECT l_orderkey AS ordinal, l_returnflag AS contig, l_linestatus AS pos, {duck_sql(DEEP_UMI)} AS umi FROM lineitem)"


def _fastq(engine, seed: str) -> tuple[str, str]:
    s = f"translate(md5('{seed}' || cast(event_id as {{text}})) || md5('{seed}' || cast(user_id as {{text}})), '{HEX}', '{ACG}')"
    q = f"translate(md5('q{seed}' || cast(event_id as {{text}})) || md5('q{seed}' || cast(user_id as {{text}})), '{HEX}', '{_QUAL}')"
    return engine(SEQ.format(s=s, text="{text}")), engine(SEQ.format(s=q, text="{text}"))


def fastq_reads(spark: SparkSession, sf_dir: str, seed: str = "a", keep: str = "true") -> DataFrame:
    """ordinal, id, seq, qual."""
    seq, qual = _fastq(spark_sql, seed)
    return _read(spark, sf_dir, "events").where(keep).selectExpr("event_id AS ordinal", "'r' || event_id || ' ' || event_type AS id", f"{seq} AS seq", f"{qual} AS qual")


def duck_fastq(name: str, seed: str = "a") -> str:
    seq, qual = _fastq(duck_sql, seed)
    return f"{name} AS (SELECT event_id AS ordinal, 'r' || event_id || ' ' || event_type AS id, {seq} AS seq, {qual} AS qual FROM events)"


def barcode_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that begin with an 8-base barcode; the ordinal is no key, so nothing may depend on it."""
    return _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ordinal", "'r' AS id", f"{spark_sql(BARCODE)} || 'ACGTACGT' AS seq", "'IIIIIIIIIIIIIIII' AS qual")


DUCK_BARCODES = f"counts AS (SELECT cell, count(*) AS n, min(ordinal) AS first FROM (SELECT l_orderkey AS ordinal, {duck_sql(BARCODE)} AS cell FROM lineitem) GROUP BY cell)"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per event; mapping qualities are distinct, so the best read is too."""
    events = _read(spark, sf_dir, "events").selectExpr("*", f"{spark_sql(UMI)} AS umi")
    tags = "map('XF', struct('Z' AS type, CASE WHEN event_id % 13 = 0 THEN '__skip' ELSE event_type END AS value), 'RX', struct('Z' AS type, umi AS value), 'NM', struct('i' AS type, '1' AS value)) AS tags"
    return events.selectExpr(
        "event_id AS ordinal", "'x' || event_id || ':CELL_C' || (user_id % 10) || ':UMI_' || umi AS qname", f"{FLAG} AS flag", f"cast({TID} as int) AS tid", "event_type AS contig",
        "user_id % 10 * 40 AS pos", "cast(event_id as int) AS mapq", f"{CIGAR} AS cigar", "-1 AS mtid", "cast(-1 as bigint) AS mpos", "cast(0 as bigint) AS tlen", "'*' AS seq", "'*' AS qual", tags,
    )


_FIRST, _LAST = "try_cast(nullif(regexp_extract(cigar, '^([0-9]+)S', 1), '') as bigint)", "try_cast(nullif(regexp_extract(cigar, '([0-9]+)S$', 1), '') as bigint)"
DUCK_ALIGNMENTS = f"""base AS (SELECT event_id AS ordinal, {duck_sql(UMI)} AS umi, {FLAG} AS flag, cast({TID} as int) AS tid, event_type AS contig, user_id % 10 * 40 AS pos, event_id AS mapq,
    {CIGAR} AS cigar, 'C' || (user_id % 10) AS cell, CASE WHEN event_id % 13 = 0 THEN '__skip' ELSE event_type END AS gene FROM events),
al AS (SELECT *, 'x' || ordinal || ':CELL_' || cell || ':UMI_' || umi AS qname, (flag & 16) <> 0 AS is_reverse,
    CASE WHEN (flag & 16) <> 0 THEN pos + list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: x::bigint)) + coalesce({_LAST}, 0) ELSE pos - coalesce({_FIRST}, 0) END AS start
    FROM base)"""


def paired_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reads as in ``alignments``, each with a second read; every third has its mate unmapped."""
    first = alignments(spark, sf_dir)
    gone = "ordinal % 3 = 0"
    one = first.withColumn("flag", F.expr(f"flag | 1 | 64 | CASE WHEN {gone} THEN 8 ELSE 0 END")).withColumn("mtid", F.col("tid")).withColumn("mpos", F.col("pos") + 100).withColumn("tlen", F.lit(110).cast("long")).withColumn("ordinal", F.col("ordinal") * 2)
    two = first.withColumn("flag", F.expr(f"1 | 128 | CASE WHEN {gone} THEN 4 ELSE 0 END | CASE WHEN flag & 4 <> 0 THEN 8 ELSE 0 END")).withColumn("mtid", F.col("tid")).withColumn("mpos", F.col("pos")).withColumn("pos", F.col("pos") + 100).withColumn("tlen", F.lit(-110).cast("long")).withColumn("ordinal", F.col("ordinal") * 2 + 1)
    return one.unionByName(two)


def tab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_name<TAB>gene lines in order of events, so genes come in many runs."""
    return _read(spark, sf_dir, "events").selectExpr("event_id AS ordinal", f"'r' || event_id || '_C' || (user_id % 10) || '_' || {spark_sql(UMI)} || '\t' || event_type AS value")
