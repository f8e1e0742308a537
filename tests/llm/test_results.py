"""Queries against SQL, or against brute force where SQL can't express them."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from plexicount.llm import decontaminate, lm_scoring, near_dup, packing, pii, quality_rules, registry
from plexicount.llm.common import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, DATA, "documents").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(same, name):
    same(registry.queries()[name], registry.oracle_sql()[name])


# The patterns of the base spans.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) for c in digits[::-1]]
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(doubled)) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def test_pii_query(spark, texts):
    rows = pii.op2_pii(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r["doc_id"]])
        told = ",".join(f"{list(BASE)[k]}:{a}:{z}" for a, k, z in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(b[1] == n for b in base) for n in range(4)]
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


def test_base_spans_on_random_text():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789.@+- ()ab%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)


def whole_spans(tags):
    """Labelled spans that end before the text does."""
    out, start = set(), None
    for k, t in enumerate(tags):
        if start is not None and not t.startswith("I"):
            out.add((start, pii.KINDS.index(tags[start][2:]), k))
            start = None
        start = k if t.startswith("B") else start
    return out


@pytest.fixture(scope="module")
def held_out():
    rng = random.Random(99)
    rows = [pii.labelled(rng) for _ in range(900)]
    return [t for t, _ in rows], [whole_spans(tags) for _, tags in rows]


def share(gold, found, kind):
    """Recall and precision of whole spans of a kind."""
    of = lambda spans: {(k, s) for k, some in enumerate(spans) for s in some if s[1] == kind}
    a, b = of(gold), of([{s for s in some if s[2] < pii.LENGTH} for some in found])
    return len(a & b) / len(a), len(a & b) / max(1, len(b))


def test_spans_of_held_out_rows(held_out):
    texts, gold = held_out
    found = [{s[:3] for s in some} for some in pii.find_all(texts, pii.trained())]
    for kind in range(len(pii.KINDS)):
        recall, precision = share(gold, found, kind)
        # Random digits pass Luhn one time in ten, so some cards of the base are none.
        assert recall >= 0.9 and precision >= (0.85 if kind == 2 else 0.9), (pii.KINDS[kind], recall, precision)


def test_the_network_alone_on_held_out_rows(held_out):
    """Without the patterns, and on spans that no pattern has."""
    texts, gold = held_out
    own = [{s[:3] for s in pii.reconciled(some, [])} for some in pii.read_spans(texts, pii.trained())]
    base = [{b[:3] for b in pii.base_spans(t)} for t in texts]
    for kind in range(len(pii.KINDS)):
        recall, precision = share(gold, own, kind)
        assert recall >= 0.85 and precision >= 0.9, (pii.KINDS[kind], recall, precision)
        new = [g - b for g, b in zip(gold, base)]
        assert sum(s[1] == kind for some in new for s in some) > 20 and share(new, own, kind)[0] >= 0.85, pii.KINDS[kind]


@pytest.mark.parametrize(("text", "want"), [
    ('thoren token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" From', "secret:16:56"), ("see commit 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde of then", ""),
    ("call 555.123.4567 or then", "phone:5:17"), ("on 02 44 55 66 77 there", "phone:3:17"), ("write bobar AT sitede DOT com now", "email:6:29"),
    ("her ssn 123-45-6789 then", "ssn:8:19"), ("by 4539.1488.0343.6467 there", "card:3:22"), ("at 97[.]51[.]17[.]173 there", "ip:3:21"), ("versions 1.2 and 3.14, in 2024", ""),
])
def test_spellings_the_patterns_miss(text, want):
    assert not pii.base_spans(text)
    assert ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z, _ in pii.find_all([text], pii.trained())[0]) == want


def test_secrets_of_the_table(spark):
    """Every token that the documents hold is a span of the network."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").where("text IS NOT NULL").collect()
    some = {k: r["text"] for k, r in enumerate(rows) if re.search(r'(?i)token = "[0-9a-f]{40}"', r["text"])}
    assert some
    for text, found in zip(some.values(), pii.find_all(list(some.values()), pii.trained())):
        for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text):
            assert (m.start(1), pii.KINDS.index("secret"), m.end(1), False) in found


def test_gradients():
    rng, model = random.Random(3), pii.BiLstmCrf()
    rows = [pii.labelled(rng) for _ in range(3)]
    codes, gold = pii.signs([r[0] for r in rows], pii.LENGTH), np.array([[pii.TAGS.index(t) for t in r[1]] for r in rows])
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, grads = model.gradients(codes, gold)
    for name in ("trans", "out", "xf", "hb", "cf"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept, step = model.w[name][at], 1e-2
        losses = []
        for d in (step, -step):
            model.w[name][at] = kept + d
            losses.append(model.gradients(codes, gold)[0])
        model.w[name][at] = kept
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(grads[name][at], rel=0.05, abs=1e-2)


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_packing_query(spark, texts):
    """All pieces of the table as the library makes them, gapless, in about as few sequences as one best fit over all of them."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {}
    for i, text in texts.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            some = ids[2048 * k : 2048 * (k + 1)]
            want[i, k] = (2048 * k, len(some), zlib.crc32(some.tobytes()))
    rows = packing.op1_best_fit_packing(spark, DATA).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(pieces[-1]) <= 2048
    assert len(held) <= 1 + len(packing.best_fit([n for _, n, _ in want.values()], 2048))


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_sequences_of_many_partitions(spark, parts):
    """However the table is dealt, the bins that meet in the tree leave few more than one best fit."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(parts)
    rows = packing.pack(docs, path("word_bpe_49k.json")).select("sequence_id", "length").collect()
    fewest = max(len(packing.best_fit([r["length"] for r in rows], 2048)), -(-sum(r["length"] for r in rows) // 2048))
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * fewest + 1


def test_token_count_query(spark, texts):
    """Each document's count is the library's, over the whole table."""
    import sentencepiece

    from plexicount.llm import token_counts

    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    rows = token_counts.op9_token_counts(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(model.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 4096)


def test_lm_query(spark, texts):
    uni, bi, tri = collections.Counter(), collections.Counter(), collections.Counter()
    words = {i: [lm_scoring.END, *t.encode().lower().split(), lm_scoring.END] for i, t in texts.items()}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
            tri.update(zip(w, w[1:], w[2:]))
    kinds, n, v = collections.Counter(a for a, _ in bi), sum(uni.values()), len(uni)
    kinds2, totals2 = collections.Counter((a, b) for a, b, _ in tri), collections.Counter()
    for (a, b, _), k in tri.items():
        totals2[a, b] += k
    p = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, b: ((bi[a, b] - 0.75) / uni[a] if bi[a, b] else 0) + (0.75 * kinds[a] / uni[a] if uni[a] else 1) * p(b)

    def p3(a, b, c):
        total = totals2[a, b] if b != lm_scoring.END else 0
        return ((tri[a, b, c] - 0.75) / total if tri[a, b, c] else 0) + 0.75 * kinds2[a, b] / total * p2(b, c) if total else p2(b, c)

    for r in lm_scoring.op4_lm_scoring(spark, DATA).collect():
        w = words[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["n_tokens"] == len(w) - 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(uni[x] > 0 for x in w[1:]) and r["base_score"] == pytest.approx(sum(math.log10(p(x)) for x in w[1:]))
        exact = math.log10(p2(w[0], w[1])) + sum(math.log10(p3(*x) if lm_scoring.ORDER > 2 else p2(*x[1:])) for x in zip(w, w[1:], w[2:]))
        assert r["score"] == pytest.approx(exact, abs=2e-3 * len(w))


@pytest.mark.parametrize("order", [2, 3])
def test_lm_orders_and_ids(spark, monkeypatch, order):
    """Ids of any type; words after each other once in training are likelier the longer the context; shards are read again where few may be held."""
    monkeypatch.setattr(lm_scoring, "HELD_BYTES", 1000)
    rng = random.Random(2)
    train = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(60)) for _ in range(300)] + ["the cat sat on the mat", "a dog sat on a log"] * 20
    docs = spark.createDataFrame([(f"d{k}", False, t) for k, t in enumerate(train)] + [(None, False, None)], "doc_id string, held_out boolean, text string").repartition(3)
    asked = spark.createDataFrame([("x", True, "the cat sat on the mat"), ("y", True, "mat the on sat cat the"), ("z", True, "the dog sat on a mat")], docs.schema)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(asked, lm_scoring.train(docs, order=order)).collect()}
    assert got["x"] > got["z"] > got["y"]
    with pytest.raises(ValueError, match="order"):
        lm_scoring.train(docs, order=4)


@pytest.mark.parametrize(("n", "bound"), [(0, 10), (1, 1), (700, 2**64 - 1), (900, 1000), (3000, 10**9), (3, 2**40)])
def test_elias_fano(n, bound):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, bound, n, dtype=np.uint64))
    coded = lm_scoring.EliasFano.of(lm_scoring.EliasFano.arrays(values, bound))
    assert n == 0 or (coded.get(np.arange(n)) == values).all()
    asked = np.concatenate([values, rng.integers(0, bound, 300, dtype=np.uint64)])
    known = set(values.tolist())
    for x, at in zip(asked.tolist(), coded.find(asked).tolist()):
        assert values[at] == x if at >= 0 else x not in known


def components_of(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    holders = collections.defaultdict(set)
    for i in ids:
        for s in sets[i]:
            holders[s].add(i)
    for i in ids:
        for j in {j for s in sets[i] for j in holders[s] if j > i}:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_query(spark, texts):
    want, sizes = components_of(texts)
    rows = near_dup.op6_near_duplicates(spark, DATA).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in rows} == {i: (c, sizes[i], c == i) for i, c in want.items()}


def test_hot_classes_are_dealt_over_tasks(spark, monkeypatch):
    """A third of the rows link to one class; what joins on it is dealt, with the same result."""
    monkeypatch.setattr(near_dup, "HOT", 10)
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    texts = {str(k): " ".join([*base[: k + 20], f"n{k}", *base[k + 21 :]]) for k in range(80)} | {f"x{k}": " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for k in range(100)}
    docs = spark.createDataFrame([*texts.items(), ("5", texts["x3"]), *[("same", t) for k, t in texts.items() if k.startswith("x9")]], "doc_id string, text string")
    want = components_of(texts)[0]
    merged = {"5": "0", "x3": "0", "same": "same", **{k: "same" for k in texts if k.startswith("x9")}}
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.find_near_duplicates(docs).collect()}
    assert got == {(k, merged.get(k, c)) for k, c in (want | {"same": "same"}).items()}
    pairs, one = spark.range(100).selectExpr("id % 2 AS a", "id AS b"), spark.range(2).selectExpr("id AS a", "id + 7 AS x")
    hot = near_dup.hot_keys(pairs, "a")
    joined = near_dup.spread_join(pairs, one, "a", "b", hot)
    assert {(r["hot"], r["copies"]) for r in hot.collect()} == {(0, 5), (1, 5)}
    assert sorted(map(tuple, joined.select("a", "b", "x").collect())) == sorted((k % 2, k, k % 2 + 7) for k in range(100))


def test_torn_buckets(spark, monkeypatch):
    """A chain of edits: neighbours are linked, the ends aren't; blocks of a few members."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = {}
    for k in range(40):
        at = 3 * k % 110
        base = base[:at] + [f"n{k}"] + base[at + 1 :]
        texts[k] = " ".join(base)
    for k in range(40, 60):
        texts[k] = " ".join(w if rng.random() > 0.045 else f"e{k}{j}" for j, w in enumerate(base))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.find_near_duplicates(docs).collect()} == components_of(texts)[0]


def test_sequential_pruning():
    least = near_dup.least_matches(0.75, 1e-6)
    assert least == sorted(least) and least[-1] > 60
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (200, near_dup.HASHES), dtype=np.uint32)
    same = rng.random(a.shape) < np.where(np.arange(200) < 100, 0.8, 0.3)[:, None]
    kept = near_dup.surviving(a, np.where(same, a, a + 1), least)
    assert set(range(100)) <= set(kept.tolist()) and len(kept) < 110


def test_pipeline(spark, texts):
    """Each stage's effect on the documents, recomputed without Spark; the result read back against them."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    keeps = {r["doc_id"] for r in quality_rules.op10_quality_rules(spark, DATA).where("kept").collect()}
    left = {i: texts[i] for i in keeps}
    component, _ = components_of(left)
    left = {i: t for i, t in left.items() if component[i] == i}
    items = [(str(r["item_id"]), decontaminate.words_of(r["text"] or "")) for r in table(spark, DATA, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for _, w in items for k in range(len(w) - 9)} | {tuple(w) for _, w in items if 0 < len(w) < 10}
    sizes = {len(w) for w in windows}

    def hits(words):
        return {j for m in sizes for k in range(len(words) - m + 1) if tuple(words[k : k + m]) in windows for j in range(k, k + m)}

    clean = {}
    for i, text in left.items():
        share = 0.0
        while hit := hits(decontaminate.words_of(text)):
            share = share or len(hit) / len(decontaminate.words_of(text))
            flat = [x for r in decontaminate.merged([(j, j + 1) for j in hit]) for x in r]
            text = decontaminate.cut(text, flat)
        if share <= 0.5:
            clean[i] = text
    model = pii.trained()
    words = packing.WordTokens(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    want = set()
    for i, text in clean.items():
        out, at = "", 0
        for a, k, z, _ in pii.find_all([text], model)[0]:
            if a >= at:
                out += text[at:a] + f"<{pii.KINDS[k].upper()}>"
            at = max(at, z)
        ids = words.encoded(out + text[at:]) + bytes(4)
        want |= {(i, k, zlib.crc32(ids[8192 * k : 8192 * (k + 1)])) for k in range(-(-len(ids) // 8192))}
        assert not brute_spans(out + text[at:])
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
