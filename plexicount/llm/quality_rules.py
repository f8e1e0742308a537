"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger holds the
measurements and one 64-bit mask with a bit for each failed rule.  Policies are
named, versioned sets of rules; applying one, or working out what each of its
rules costs, is bitwise work on the ledger and never looks at a text again.

Everything is built from DataFrame expressions: no rows are exchanged until
``ablations`` counts masks (at most 2**rules groups, combined map-side).

Defined results: null text counts as empty; an empty text has no words and fails
``few_words``; texts of any length are measured whole; repeated rows and ties are
independent rows; extra columns of any name are carried unchanged by
``annotate`` and ``apply_policy``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, row_of, table

WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A predicate in SQL over the measurements; true means failed."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: ledgers written by one version stay readable by the next.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "shouting", "2 * n_upper > word_chars"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base/1": BASE,
    "web/1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "web/2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "shouting"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def mask_of(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in set(POLICIES[policy]))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _heads(words: Column, n: Column) -> Column:
    """The first word of each three-word window."""
    return F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that stand at two or more places.

    Windows are sorted by hash, then by their words, so equal ones are neighbours
    whatever the hashes do; their starts, sorted again, give the covered words.
    """

    def from_sorted(s: Column) -> Column:
        same = lambda x, y: F.coalesce((x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)))
        starts = F.sort_array(F.transform(twice, lambda x: x.i))
        return _let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x))

    def key(w: Column) -> Column:
        part = lambda x, i: (x, F.get(w, i + 1), F.get(w, i + 2))
        return F.transform(_heads(w, F.size(w)), lambda x, i: F.struct(F.xxhash64(*part(x, i)).alias("h"), *[c.alias(k) for k, c in zip("abc", part(x, i))], i.alias("i")))

    return _let(words, lambda w: _let(F.sort_array(key(w)), from_sorted))


def annotate(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (the input row as a struct), the measurements and ``failed`` (long bitmask)."""
    n = F.size("words")
    lines = lambda c: F.filter(c, lambda x: F.trim(x, F.lit(WHITE)) != "")
    split = docs.select(row_of(docs).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).select(
        "row", "text", F.trim("text", F.lit(WHITE)).alias("inner")
    ).select("row", "text", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", WS)).alias("words"), lines(F.split("text", "\n")).alias("lines"))
    hashes = _let(F.col("words"), lambda w: F.transform(_heads(w, F.size(w)), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    hashed = split.select("*", hashes.alias("hashes"))
    measured = hashed.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _removed(F.col("text"), r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0)).otherwise(_repeated(F.col("words"))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _removed(F.col("text"), r"[A-Z]+").alias("n_upper"),
    )
    bits = [F.when(F.coalesce(F.expr(r.fails), F.lit(False)), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.select("*", failed.alias("failed"))


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask_of(policy))) == 0


def apply_policy(docs: DataFrame, policy: str = "web/2", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return annotate(docs, text_col).where(passes(policy)).select("row.*")


def ablations(ledger: DataFrame, policy: str = "web/2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects."""
    mask = mask_of(policy, rules)
    masks = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).count()
    chosen = [r for r in rules if r.name in POLICIES[policy]]
    kinds = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    return (
        masks.select("failed", "count", kinds.alias("k"))
        .groupBy(F.col("k.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("k.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("failed") == F.col("k.bit"), F.col("count")).otherwise(0)).alias("n_only_this"),
        )
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ledger.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base/1")).alias("base_failed"), passes("web/2").alias("kept"), "failed",
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) AS n_upper
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM b
"""
