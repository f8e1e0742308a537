"""What operators once left out: cases that lie across lines, windows, ids and orders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexicount.llm import license_scan, near_dup, packing, pii

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["row"]["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs).collect()}


def test_wrapped_notices(spark):
    gpl = "This work is licensed under the GNU General\nPublic License, version 3"
    far = "released\n" + "x y z\n" * 8 + "under the mit\nlicense"
    # Behind any number of words, so at any place of a window.
    moved = [f"{'w ' * k}\n{MIT}\n{'v ' * 99}" for k in range(0, 90, 7)]
    got = scanned(spark, [MIT, gpl, far, MIT.replace("\n", " "), *moved])
    assert got[0] == got[3] == ("mit", 1.0) and got[1] == ("gpl", 1.0) and got[2] == ("mit", 0.8)
    assert {got[4 + k] for k in range(len(moved))} == {("mit", 1.0)}


def test_labels_of_other_licenses(spark):
    scattered = "released " + "word " * 40 + "under " + "word " * 40 + "the mit " + "word " * 40 + "license"
    others = ["Released under the BSD License.", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-ND 4.0", scattered, "This work is licensed under the GNU Free Documentation License version 3", "mit " * 8000 + "license"]
    named = {"Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-SA 4.0": "cc-by-sa", "Released under the Apache License.": "apache"}
    got = scanned(spark, [*others, *named, "Released under an MIT License"])
    assert [got[k] for k in range(len(others) - 1)] == [("", 0.0)] * (len(others) - 1) and got[len(others) - 1] == ("mit", 0.0)
    assert [got[len(others) + k][0] for k in range(len(named))] == list(named.values())
    assert got[len(others) + len(named)][1] == 0.8


# Beginnings of license texts, wrapped as they are published.
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either"""


def test_published_notices(spark):
    long = " ".join(f"word{k}" for k in range(15_000))
    texts = [APACHE, BSD, LGPL, f"{long} {MIT} {long}".replace("\n", " "), "x\n\n" + BSD.replace("\n", "\n# ") + "\n\ny", BSD[:70]]
    assert scanned(spark, texts) == {0: ("apache", 1.0), 1: ("bsd", 1.0), 2: ("gpl,lgpl", 1.0), 3: ("mit", 1.0), 4: ("bsd", 1.0), 5: ("", 0.0)}


def test_similar_blocks_keeps_keys_of_any_name(spark):
    names = ["block", "token", "tokens", "p", "n", "words", "keys", "a.b"]
    docs = spark.createDataFrame([(*range(8), "Released under the MIT License"), (*[None] * 8, None)], ", ".join(f"`{c}` int" for c in names) + ", text string")
    rows = license_scan.similar_blocks(docs.withColumn("own", F.lit(1)), names).collect()
    assert [tuple(r)[:9] for r in rows] == [(*range(8), "mit")]
    assert license_scan.similar_blocks(docs, ["p"], templates=()).count() == 0


def test_license_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 0)
    assert scanned(spark, [MIT, BSD]) == {0: ("mit", 1.0), 1: ("bsd", 1.0)}


class Tagger:
    """In the network's place: tags one string as a span of one kind."""

    def __init__(self, span, kind):
        self.codes, self.kind = pii.signs([span], len(span))[0], kind

    def decode(self, codes):
        path, n = np.zeros(codes.shape, np.int64), len(self.codes)
        for row, out in zip(codes, path):
            for k in range(len(row) - n + 1):
                if (row[k : k + n] == self.codes).all():
                    out[k : k + n] = 2 * self.kind + 2
                    out[k] = 2 * self.kind + 1
        return path, (path > 0).astype(np.float32)


@pytest.mark.parametrize(("kind", "span"), [(0, "a" * 45 + "(at)example.org"), (0, "b" * 50 + "[at]example.cz"), (1, "1.2.3.4"), (3, "555" + " " * 40 + "123 4567 89")])
def test_spans_inside_windows(kind, span):
    assert pii.valid(kind, span, 0, len(span)) and len(span) <= pii.LONGEST
    model, rng = Tagger(span, kind), random.Random(5)
    lead = "300." if kind == 1 else ""
    for before in [0, 1, *range(20, 200, 3)]:
        for after in (0, 1, 200):
            text = "".join(rng.choice("xyz ") for _ in range(before)) + (" " if before else "") + lead
            found = pii.find_all([text + span + (" " + "w " * after if after else "")], model)[0]
            assert (len(text), kind, len(text) + len(span), False) in found


def near_copies(seed, n=2):
    """A text and copies of it with one other word each."""
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
    return [" ".join(words)] + [" ".join([*words[: 30 * k + 9], f"n{k}", *words[30 * k + 10 :]]) for k in range(1, n)]


def test_near_copies_of_each_text_of_an_id(spark):
    rows = []
    for k in range(6):
        (a, a2), (b, b2) = near_copies(2 * k), near_copies(2 * k + 1)
        rows += [(10 * k, a), (10 * k, b), (10 * k + 1, a2), (10 * k + 2, b2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.find_near_duplicates(docs).collect()}
    assert got == {(i, i // 10 * 10) for i, _ in rows}


def test_pipeline_keeps_one_row_of_a_group(spark):
    (a, a2), (b, b2), (c, _) = (near_copies(20 + k) for k in range(3))
    rows = [(2, a), (2, a), (None, a2), (1, a2), (None, b), (None, b), (None, b2), (5, c), (5, ""), (6, "x y"), (6, a), (None, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, k int").coalesce(1)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(kept) == 4 and (1, a2) in kept and (None, None) in kept and sum(t in (b, b2) for _, t in kept) == 1 and sum(i == 5 for i, _ in kept) == 1
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_bins_stay_open_for_later_pieces(spark, monkeypatch):
    """More pieces than a task holds: long ones first, then those that fit behind them."""
    monkeypatch.setattr(packing, "HELD", 100)
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        texts = [(k, "word " * (599 if k < 300 else 399)) for k in range(600)]
        docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
        rows = packing.pack(docs, path, capacity=1024).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(rows) == 600 and len(bins) <= 303
