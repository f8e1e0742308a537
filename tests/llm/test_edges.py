"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from plexicount.llm import chat_format, decontaminate, license_scan, lm_scoring, near_dup, packing, pii, quality_rules, token_counts, url_filter

TOKENS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
LONG = "word " * 30_000


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.fixture(scope="module")
def docs(spark):
    """Names that operators use inside, as the caller's columns."""
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "mail me@x.org now"), (5, LONG), (6, "É́ \U0001f600 ß\n\nx\ty")]
    schema = "doc_id bigint, text string, row string, words string, own string, label string, n_words string"
    return spark.createDataFrame([(i, t, "r", "w", "o", "l", "n") for i, t in rows], schema)


def by_id(rows, *columns):
    return sorted([tuple(r[c] for c in columns) for r in rows], key=str)


def test_packing(docs):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path(TOKENS))
    rows = packing.pack(docs, path(TOKENS)).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], k, 2048 * k, min(2048, len(ids) - 2048 * k), zlib.crc32(ids[2048 * k : 2048 * k + 2048].tobytes())) for k in range(-(-len(ids) // 2048))]
    assert by_id(rows, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), path(TOKENS)).count() == 0


def test_best_fit():
    assert packing.best_fit([5, 5, 3, 2, 7, 10], 10) == [[5], [4, 2], [0, 1], [3]]
    assert packing.best_fit([], 10) == []


def test_packing_over_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(100 + pmod(id * 37, 900) as int))").alias("text")).repartition(8)
    rows = packing.pack(docs, path(TOKENS), capacity=1024).cache()
    got = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("a"))
    whole = len(packing.best_fit([r["length"] for r in rows.collect()], 1024))
    assert rows.count() == 3000 and got.agg(F.max("n")).first()[0] <= 1024 and got.agg(F.max("a")).first()[0] == 0
    # Partitions of 375 documents; thousands come closer to packing all at once.
    assert got.count() <= 1.03 * whole


def test_token_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path(PIECES))
    rows = token_counts.count_tokens(docs, path(PIECES)).collect()
    assert [r["row"]["label"] for r in rows] == ["l"] * 7
    assert {(r["row"]["text"], r["n_tokens"], r["n_bytes"]) for r in rows} == {(r["text"], len(model.encode(r["text"] or "")), len((r["text"] or "").encode())) for r in docs.collect()}
    assert [r["over_limit"] for r in rows if r["row"]["doc_id"] == 5] == [True]
    assert token_counts.count_tokens(docs.limit(0), path(PIECES)).count() == 0


@pytest.mark.parametrize("text", [" ", "  a", "a  b ", "\n", "\n\na", " \n b", "a\n b\n", "▁a b", "<s> </s> <unk>", "x\x00y", "日本 語", "a" * 500, "\t a\r\nb"])
def test_piece_counter(text):
    counter = token_counts.PieceCounter(path(PIECES), {"a": 1})
    assert counter.exact and counter.count(text) == len(counter.model.encode(text))


@pytest.mark.parametrize("text", ["It's\nA", "<|endoftext|>x <|ENDOFTEXT|>", "K İ ſ ﬁ éÉ", "H̱ ẖ", " a b\u0085c", "½ ª ²", "don't WE'LL 'S", "Σας ΣΑΣ", "\x1c x\x1fy", "한국 日本"])
def test_word_tokens(text):
    words = packing.WordTokens(path(TOKENS))
    assert words.split and words.ids(text) == words.encoded(text)


def test_quality(docs):
    rows = quality_rules.annotate(docs).collect()
    got = {(r["row"]["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"], r["failed"] & 3) for r in rows}
    assert {(1, 0, 0, 0, 1), (2, 0, 0, 0, 1), (3, 3, 3, 0, 1), (5, 30_000, 120_000, 30_000, 2)} <= got
    assert quality_rules.apply_policy(docs, "base/1").columns == docs.columns
    assert quality_rules.annotate(docs.limit(0)).count() == 0
    table = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality_rules.ablations(quality_rules.annotate(docs), "base/1").collect()}
    assert table == {"few_words": (6, 6), "repeated_windows": (1, 1)}


def test_license(docs, spark):
    rows = license_scan.scan(docs).collect()
    assert len(rows) == 7 and {r["labels"] for r in rows} == {""} and rows[0]["row"]["label"] == "l"
    text = "x\nReleased under the MIT License.\nmit LICENSE mit license\nlicensed under cc by nc 4.0"
    many = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    got = license_scan.scan(many).collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in got] == [(17, 3, 4, 8, "mit", "cc-by-nc,mit", 1.0)] * 3
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://example.net/fr", "ftp://notexample.net", "http://b.org/fr/", "https://example.com:80/de/", "http://x.example.com/de/a#b", "http://net/", "http://" + "a." * 500 + "net/" + "p" * 5000]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls * 2)], "page_id bigint, url string, host string, verdict string")
    rules = spark.createDataFrame(list(url_filter.RULES), "verdict string, host string, path string")
    rows = url_filter.judge(pages, rules).collect()
    assert len(rows) == 22
    got = {r["row"]["url"]: (r["rule"], r["verdict"]) for r in rows}
    want = [(None, "allow")] * 3 + [("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), ("example.com/de/", "block"), ("net/", "block"), ("net/", "block")]
    assert [got[u] for u in urls] == want
    assert "Exchange" not in url_filter.judge(pages, rules)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(url_filter, "BROADCAST_RULES", 0)
        again = url_filter.judge(pages, rules).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    many = rules.unionByName(spark.range(3000).selectExpr("'block' AS verdict", "concat('h', id, '.org') AS host", "concat('/', repeat('x', id % 9)) AS path")).unionByName(spark.createDataFrame([("block", None, "/"), ("block", "org", None)], rules.schema))
    assert {r["row"]["url"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, many).collect()} == got
    deep = spark.createDataFrame([(1, "http://a.h17.org/xxxxxxxxxx"), (2, "http://h17.org/xxxxxxx")], "page_id bigint, url string")
    assert [r["rule"] for r in url_filter.judge(deep, many).orderBy("row.page_id").collect()] == ["h17.org/xxxxxxxx", None]
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "", None, "a\\\\#<:\n</turn>\n### x: y", "\\"]
    roles = ["user", "assistant", None, "a:b\\c\n#<", "assistant"]
    rows = [(1, k, r, t, "x") for k, (r, t) in enumerate(zip(roles, said))] + [(None, 0, "assistant", "null id", "x"), (2, 0, "user", "same", "x"), (2, 0, "user", "same", "x")]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, leaf string")
    got = {r["conv"]: r for r in chat_format.read_back(chat_format.format_chats(chat_format.linear_tree(m))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t or "") for r, t in zip(roles, said)]
    assert got[1]["learned"] == ["", "\\"] and got[None]["learned"] == ["null id"] and len(got[2]["turns"]) == 2
    assert chat_format.format_chats(chat_format.linear_tree(m.limit(0))).count() == 0


def test_chat_branches(spark):
    rows = [(1, 0, None, "u", "root", 0.0), (1, 1, 0, "a", "bad", 1.0), (1, 2, 0, "a", "good", 3.0), (1, 3, 2, "u", "deep", 3.0), (1, 4, 99, "u", "orphan", 0.7), (2, 0, 1, "u", "cycle", 1.0), (2, 1, 0, "u", "cycle", 1.0)]
    tree = spark.createDataFrame(rows, "conv bigint, node bigint, parent bigint, role string, text string, score double")
    got = chat_format.read_back(chat_format.format_chats(tree, top=2)).collect()
    assert sorted([t["text"] for t in r["turns"]] for r in got) == [["orphan"], ["root", "good", "deep"]]


def test_decontamination(docs, spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (2, "short item"), (5, "Six seven eight nine ten eleven twelve a b c d")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    text = "Start, ONE two three-four five six seven eight nine ten eleven twelve a b c d short ITEM short. end"
    more = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.lit(text)))
    rows = {r["row"]["doc_id"]: r for r in decontaminate.find_leaks(more, bench).collect()}
    assert rows[9]["hits"] == [1, 19] and rows[9]["items"] == ["1", "2", "5"] and rows[9]["n_words"] == 21
    assert rows[1]["hits"] == [] and rows[5]["n_words"] == 30_000
    clean = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(more, bench, max_coverage=0.95).collect()}
    assert clean[9] == "Start,  short. end" and clean[3] == "a b c" and clean[1] is None
    assert 9 not in {r["doc_id"] for r in decontaminate.decontaminate(more, bench).collect()}
    assert decontaminate.decontaminate(more, bench).columns == more.columns
    nothing = {r["row"]["doc_id"]: r for r in decontaminate.find_leaks(more, bench.limit(0)).collect()}
    assert not any(r["hits"] or r["items"] for r in nothing.values()) and nothing[9]["n_words"] == 21
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_decontamination_in_shards(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c"), (2, "word word word word"), (3, "b c")], "item_id bigint, text string")
    whole = by_id(decontaminate.find_leaks(docs, bench, window=3).collect(), "n_words", "hits", "items")
    clean = by_id(decontaminate.decontaminate(docs, bench, window=3).collect(), *docs.columns)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 3)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 12)
    assert len(decontaminate.shards(bench, "item_id", "text", 3)) > 1
    assert by_id(decontaminate.find_leaks(docs, bench, window=3).collect(), "n_words", "hits", "items") == whole
    assert by_id(decontaminate.decontaminate(docs, bench, window=3).collect(), *docs.columns) == clean


def test_spans_that_cutting_brings_together(spark, monkeypatch):
    """The items lie in different shards; what is left of one is cut in a later round."""
    items = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "k l m n o")], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "p q r s t u v w a b x y z c d p q r s"), (2, "k l x y z m n o"), (3, None), (4, "a b c d, then much more that is no item of any kind")], "doc_id bigint, text string")
    want = by_id(decontaminate.decontaminate(rows, items, window=3).collect(), "doc_id", "text")
    assert [t.split() if t else t for _, t in want] == ["p q r s t u v w p q r s".split(), None, ", then much more that is no item of any kind".split()]
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 6)
    assert len(decontaminate.shards(items, "item_id", "text", 3)) == 3
    assert by_id(decontaminate.decontaminate(rows, items, window=3).collect(), "doc_id", "text") == want


def test_memory_of_an_automaton():
    """What a worker holds, by the word: bounded for a shard, whatever the benchmark's size."""
    import pickle
    import random
    import tracemalloc

    rng = random.Random(4)
    items = [(str(k), [b"w%d" % int(rng.paretovariate(0.6)) for _ in range(100)]) for k in range(500)]
    data = pickle.dumps(decontaminate.Automaton(items, 10).packed())
    assert len(data) < 80 * 50_000
    tracemalloc.start()
    held = decontaminate.Matcher(pickle.loads(data))
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 200 * 50_000 and held.scan(items[7][1])[0] == [(0, 100)]


def test_automaton_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(300):
        items = [(k, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))]) for k in range(rng.randint(0, 5))]
        words, window = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)], rng.randint(1, 5)
        hit, own = set(), set()
        for item, ws in items:
            m = min(window, len(ws))
            for i in range(len(ws) - m + 1) if ws else ():
                for j in range(len(words) - m + 1):
                    if words[j : j + m] == ws[i : i + m]:
                        hit |= set(range(j, j + m))
                        own.add(item)
        ranges, found = decontaminate.Matcher(decontaminate.Automaton(items, window).packed()).scan(words)
        assert {k for a, z in ranges for k in range(a, z)} == hit and found == own


def test_pii(docs):
    rows = pii.annotate(docs).collect()
    spans = {r["row"]["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in rows}
    assert spans[None] == [("email", 5, 13)] and all(not v for k, v in spans.items() if k)
    assert {r["text"] for r in pii.redact(docs).where("doc_id IS NULL").collect()} == {"mail <EMAIL> now"}
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0


def test_near_duplicates(docs, spark):
    rows = near_dup.find_near_duplicates(docs).collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == 7 and {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (None, 1, None, True), (5, 1, 5, True)} <= got
    assert near_dup.drop_near_duplicates(docs).count() == 7 and near_dup.drop_near_duplicates(docs).columns == docs.columns
    assert near_dup.find_near_duplicates(docs.limit(0)).count() == 0
    # Rows that share an id make their texts one document.
    both = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "A b c d e f"), (7, "g h i j k l")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dup.find_near_duplicates(both).collect()} == {(1, 1), (2, 1), (7, 1)}


def test_lm(docs, tmp_path):
    marked = docs.withColumn("held_out", F.lit(False))
    figures = lm_scoring.train(docs)
    rows = lm_scoring.score(marked, figures).collect()
    assert len(rows) == 7 and {r["train_tokens"] for r in rows} == {30_000 + 3 + 3 + 3 + 5 + 7}
    assert {(r["doc_id"], r["n_tokens"], r["n_known"]) for r in rows} >= {(1, 1, 1), (2, 1, 1), (3, 4, 4), (5, 30_001, 30_001)}
    nothing = lm_scoring.train(docs.limit(0))
    assert {(r["n_known"], r["train_tokens"]) for r in lm_scoring.score(marked, nothing).collect()} == {(0, 0)}
    assert lm_scoring.score(marked.limit(0), figures).count() == 0
    json.dumps(figures)
