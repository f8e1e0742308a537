"""URL filters by hashed expressions.

A URL is expanded into every pair of a host suffix and a path prefix that some rule
could have: suffixes at dots, at most as many labels as the longest rule host has,
and prefixes of the lengths that rule paths have.  Rules and expressions are
equi-joined on a short prefix of their SHA-256, then the full digests are compared,
and the longest rule wins.  No URL is compared with a rule that doesn't share its
short hash.

Scale: up to ``BROADCAST_RULES`` rules (counted first) are one constant, a table of
buckets by the first bits of their digests, with about one rule in each.  Every row joins its
expressions with their buckets by index and takes the best rule itself, so no row of the
input is exchanged, whatever hosts or pages are common.  Beyond, expressions and rules are
equi-joined by exchange on the short hash, the best rule of each row is found by an
aggregation that combines in the task, and rows get it back by a number of their own;
short hashes that many expressions share are spread by AQE's skew join.

Defined results: null URL or one without ``://``: empty host and path, no rule, the
default verdict; ports and user names stay part of the host; an empty path starts
with no rule's path; ties in length go to the rule first in order of host, path and
verdict; repeated rows keep one result row each; URLs of any length are used whole;
an empty rule table matches nothing; rules with a null host or path match nothing;
the caller's columns come back in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, row_of, table

#: Hex digits of the short hash.
PREFIX = 8
BROADCAST_RULES = 100_000
FOUND = "struct<order:int,r_host:string,r_path:string,verdict:string>"
HELD = f"array<struct<digest:string,found:{FOUND}>>"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column, bits: int) -> Column:
    """The first bits of a digest, as a number."""
    return F.shiftright(F.conv(F.substring(digest, 1, PREFIX), 16, 10).cast("long"), 4 * PREFIX - bits).cast("int")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """rules: verdict, host, path (starting with ``/``).  Gives ``row``, host, path, rule, verdict."""
    rules = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path")).where("r_host IS NOT NULL AND r_path IS NOT NULL")
    shape = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    order = F.struct((-F.length("r_host") - F.length("r_path")).alias("order"), "r_host", "r_path", "verdict")
    hashed = rules.select(_digest(F.col("r_host"), F.col("r_path")).alias("digest"), order.alias("found"))
    host, path = host_path(F.col(f"`{url_col}`"))
    parts = pages.select(row_of(pages).alias("row"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    depth = F.when(F.col("host") == "", F.lit(0)).otherwise(F.least(F.size(labels), F.lit(shape["labels"] or 0)))
    suffix = lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
    reach = F.filter(F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>"), lambda n: n <= F.length("path"))
    suffixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), suffix)).otherwise(F.array().cast("array<string>"))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(reach, lambda n: _digest(s, F.substring(F.col("path"), F.lit(1), n)))))
    if not shape["n"]:
        judged = parts.withColumn("best", F.lit(None).cast(FOUND))
    elif shape["n"] <= BROADCAST_RULES:
        bits = min(4 * PREFIX - 1, max(1, shape["n"].bit_length()))
        none = F.array().cast(HELD)
        # Buckets in order of their number; a row's expressions look theirs up by index.
        held = hashed.groupBy(_short(F.col("digest"), bits).alias("bucket")).agg(F.collect_list(F.struct("digest", "found")).alias("rules"))
        buckets = hashed.sparkSession.range(2**bits).select(F.col("id").cast("int").alias("bucket")).join(held, "bucket", "left")
        index = buckets.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "rules"))), lambda b: F.coalesce(b.rules, none))).alias("index")).first()["index"]
        # Folded into a constant of the plan, which tasks get once.
        constant = F.from_json(F.lit(index), f"array<{HELD}>")
        near = lambda d: F.filter(F.get(constant, _short(d, bits)), lambda r: r.digest == d)
        judged = parts.withColumn("best", F.array_min(F.flatten(F.transform(digests, lambda d: F.transform(near(d), lambda r: r.found)))))
    else:
        numbered = parts.withColumn("id", F.monotonically_increasing_id())
        probes = numbered.select("id", F.explode(digests).alias("asked")).withColumn("short", F.substring("asked", 1, PREFIX))
        met = probes.join(hashed.withColumn("short", F.substring("digest", 1, PREFIX)), "short").where("asked = digest")
        judged = numbered.join(met.groupBy("id").agg(F.min("found").alias("best")), "id", "left")
    return judged.select("row", "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


_R = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP8_SQL = rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, k, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {_R}) AS v(verdict, rh, rp)),
m AS (SELECT k, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(verdict, length(rh) + length(rp)) AS verdict
      FROM h, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (k)
"""
