"""License scans as an exact set-similarity join.

A run of consecutive words, wherever lines break, of at most ``RUN`` times a template's
words meets the template when it contains at least ``threshold`` of its distinct words
(containment), all those that tell its license from others (``required``) and none that
tells another (``barred``).  Blocks are windows of twice the longest run that overlap
by half: every run lies within one.  The join finds every block and template that can
meet, exactly, and looks for the runs in those pairs alone:

* words are ordered by their frequency over all blocks, rarest first.  Only the
  templates' own vocabulary can take part, so the counts come from one map-side
  combined aggregation with at most as many groups as the templates have words;
* prefix filter: of a template with n words of which a must be met, the a-th last
  and all rarer ones form the prefix; a block that meets it has one of them.  Blocks
  and templates are equi-joined on prefix words;
* length filter: a text or block with fewer than a words of every template is dropped
  before;
* positional filter: a shared word at position p of the template and j of the block
  leaves min(n - p, m - j) words to share, which must reach a;
* a pair is verified once, at its rarest shared word.

A text is looked at by words only if it holds, anywhere, what some template can't do
without: its required words and one of any n - a + 1 of its words.  The templates'
prefixes are broadcast up to ``BROADCAST_ROWS`` of them; beyond, the join is shuffled.
Base phrases are found with one regular expression over the words joined by single spaces.

Defined results: null text counts as empty; an empty text has no words, null
first_word and last_word, empty labels and score 0; repeated rows
keep their own result rows; ids may be null; the caller's columns come back inside
``row``, keys of any name as they are; an empty table gives no rows; without templates
no block meets any.

The SQL compares whole lines of any length with the templates' word sets: it has no
notices that are wrapped, and has labels where words of one line are far apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, row_of, staged, table

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    """A notice in lower-case words, those a run needs whatever the threshold, and those it may not have."""

    label: str
    words: str
    required: str = ""
    barred: str = ""


# Notices by which licenses are named or granted.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted charge"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "permission sublicense"),
    Template("apache", "licensed under the apache license version 2 0", "apache"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache compliance"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public", "lesser affero"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public redistribute", "lesser affero"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser redistribute"),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero redistribute"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission fee"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    Template("cc-by", "licensed under cc by 4 0", "cc by", "nc sa nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", "nc nd"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", "sa nd"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution", "noncommercial sharealike noderivatives"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons sharealike", "noncommercial noderivatives"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons noncommercial", "sharealike noderivatives"),
)
THRESHOLD = 0.8
#: A run is at most so many times as long as its template.
RUN = 2
BROADCAST_ROWS = 100_000
#: Separators of words where letters keep their case.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _need(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, BREAKS, " ")), " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def similar_blocks(docs: DataFrame, key_cols: list[str], text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per block and template it meets: the keys, ``label``, ``score`` (containment), ``block`` (its words)."""
    spark = docs.sparkSession
    sets = [(t, sorted(set(t.words.split())), RUN * len(t.words.split())) for t in templates]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})
    strings = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    any_of = lambda conditions: reduce(Column.__or__, conditions, F.lit(False))
    needs = [(ws, _need(len(ws), threshold)) for _, ws, _ in sets]
    least, span = min((need for _, need in needs), default=1), max((run for _, _, run in sets), default=1)

    def hint(text: Column) -> Column:
        """Of n words of which a must be met, any n - a + 1 hold one that is; long ones are rare."""
        told = {}
        for t, ws, _ in sets:
            telling = tuple(sorted(ws, key=lambda w: (-len(w), w))[: len(ws) - _need(len(ws), threshold) + 1])
            told.setdefault((telling, tuple(sorted(t.required.split(), key=len, reverse=True))), None)
        # Arrays of one element: what they hold is computed once.
        has = lambda x, w: F.contains(x, F.lit(w))
        return F.exists(F.array(text), lambda x: any_of([reduce(Column.__and__, [has(x, w) for w in required], any_of([has(x, w) for w in telling])) for telling, required in told]))

    enough = lambda words: F.exists(F.array(F.array_intersect(strings(vocabulary), words)), lambda t: any_of([F.size(F.array_intersect(strings(ws), t)) >= need for ws, need in needs]))
    keys = F.struct(*[F.col(f"`{c}`") for c in key_cols]).alias("keys")
    lowered = docs.select(keys, ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("lowered")).where(hint(F.col("lowered")))
    whole = lowered.select("keys", _words(F.col("lowered")).alias("all")).where(enough(F.col("all")))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(span))
    windows = whole.select("keys", F.explode(F.transform(starts, lambda k: F.slice("all", k + 1, F.lit(2 * span)))).alias("block"))
    met = windows.where(enough(F.col("block"))).select("*", F.array_intersect(strings(vocabulary), "block").alias("tokens"))
    met = staged(met, "license-blocks")
    counts = {r["t"]: r["n"] for r in met.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(ordered)}
    index = []
    for number, (t, ws, run) in enumerate(sets):
        ws = sorted(ws, key=rank.__getitem__)
        need = _need(len(ws), threshold)
        index += [(w, number, t.label, p, len(ws), need, run, ws, t.required.split(), t.barred.split()) for p, w in enumerate(ws[: len(ws) - need + 1])]
    prefixes = spark.createDataFrame(index, "token string, template int, label string, p int, n int, need int, run int, words array<string>, required array<string>, barred array<string>")
    prefixes = F.broadcast(prefixes) if len(index) <= BROADCAST_ROWS else prefixes
    ranked = met.select("keys", "block", F.array_intersect(strings(ordered), F.col("tokens")).alias("tokens"))
    # A block's own prefix: whatever the template, at least `least` words must follow.
    probes = ranked.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - least + 1, F.lit(0)))).alias("j", "token"))
    pairs = probes.join(prefixes, "token").where(F.least(F.col("n") - F.col("p"), F.size("tokens") - F.col("j")) >= F.col("need"))
    shared = F.array_intersect("words", "tokens")
    likely = pairs.where((F.size(shared) >= F.col("need")) & (F.get(shared, F.lit(0)) == F.col("token")))
    runs = F.transform(F.sequence(F.lit(1), F.size("block")), lambda k: F.slice("block", k, F.col("run")))
    runs = F.filter(runs, lambda r: (F.size(F.array_except("required", r)) == 0) & ~F.arrays_overlap("barred", r))
    verified = likely.withColumn("both", F.array_max(F.transform(runs, lambda r: F.size(F.array_intersect("words", r))))).where("both >= need")
    return verified.select(*[F.col(f"keys.`{c}`").alias(c) for c in key_cols], "label", (F.col("both") / F.col("n")).alias("score"), "block")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (id and text's digest aside, all columns but the text), n_words, n_base,
    first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.select(row_of(docs.select(*[f"`{c}`" for c in rest])).alias("row"), F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    found = similar_blocks(keyed.select("id", "sha", "text"), ["id", "sha"], "text", templates, threshold)
    # Rows with the same id and text have the same result, so the keys needn't tell them apart.
    found = found.groupBy(F.col("id").alias("f_id"), F.col("sha").alias("f_sha")).agg(F.collect_set("label").alias("own"), F.max("score").alias("score"))
    inner = F.trim(F.regexp_replace("text", BREAKS, " "))
    spaced = keyed.select("row", "id", "sha", F.concat(F.lit(" "), inner, F.lit(" ")).alias("s"))
    any_of = "(?:" + "|".join(PHRASES) + ")"
    place = f"(?is) (?={any_of} )"
    hit = F.col("s").rlike(place)
    labels = F.array(*[F.when(F.col("s").rlike(f"(?i) {p} "), F.lit(k)) for p, k in PHRASES.items()])
    none = F.array().cast("array<string>")
    counted = spaced.select(
        "row", "id", "sha",
        F.when(F.col("s") == "  ", F.lit(0)).otherwise(_spaces(F.col("s")) - 1).cast("long").alias("n_words"),
        F.when(hit, F.regexp_count("s", F.lit(place))).otherwise(F.lit(0)).cast("long").alias("n_base"),
        F.when(hit, _spaces(F.regexp_extract("s", f"(?is)^(.*?) (?={any_of} )", 1))).alias("first_word"),
        F.when(hit, _spaces(F.regexp_extract("s", f"(?is)^(.*) (?={any_of} )", 1))).alias("last_word"),
        F.when(hit, F.array_compact(labels)).otherwise(none).alias("base"),
    )
    joined = counted.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("sha") == F.col("f_sha")), "left")
    text_of = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "row", "n_words", "n_base", "first_word", "last_word", text_of(F.col("base")).alias("base_labels"),
        text_of(F.concat("base", F.coalesce("own", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_T = ", ".join(f"('{t.label}', {sorted(set(t.words.split()))}, {t.required.split()}, {t.barred.split()}::VARCHAR[])" for t in TEMPLATES)
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT doc_id, i - 1 AS pos, CASE WHEN ws[i] = 'mit' AND ws[i+1] = 'license' THEN 'mit' WHEN ws[i] = 'apache' AND ws[i+1] = 'license' THEN 'apache'
        WHEN ws[i] = 'general' AND ws[i+1] = 'public' AND ws[i+2] = 'license' THEN 'gpl' END AS label FROM u),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS ls FROM p WHERE label IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(regexp_split_to_array(unnest(string_split(t, chr(10))), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS bs FROM d),
t AS (SELECT * FROM (VALUES {_T}) AS v(label, ts, required, barred)),
m AS (SELECT doc_id, label, len(list_intersect(ts, bs)) / len(ts) AS c FROM l, t WHERE 10 * len(list_intersect(ts, bs)) >= 8 * len(ts) AND list_has_all(bs, required) AND NOT list_has_any(bs, barred)),
o AS (SELECT doc_id, list(DISTINCT label) AS ls, max(c) AS score FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(o.ls, [])))), ','), '') AS labels, coalesce(o.score, 0)::DOUBLE AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN o ON w.doc_id = o.doc_id
"""
