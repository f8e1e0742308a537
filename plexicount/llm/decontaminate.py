"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of consecutive words of every normalised benchmark item.  A
document's words stream through it; at each word it knows the longest run that ends
there and stands in some item.  Where that run reaches ``window`` words, the last
``window`` words are hit; an item of fewer words is hit where it stands whole.

Benchmarks are small next to corpora.  The item table is dealt into shards of at most
``SHARD_WORDS`` words and ``SHARD_BYTES`` bytes.  Tasks build an automaton for each and
write it to the shared folder as flat arrays, about 70 bytes a word.  A pass over the
rows goes with one automaton, which is all of the benchmark that a worker ever holds;
several shards take as many staged passes.  Nothing of the benchmark is broadcast or
sent to the driver but the files' names.  Documents are never exchanged: everything
happens in the partition that read them.

Defined results: null text has no words and no hits; items without words match
nothing; repeated items and ids count once; texts of any length stream whole;
repeated rows are judged each by itself; the caller's columns come back inside
``row``; an empty benchmark hits nothing; empty tables give no rows.
"""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_dir, gives_back, read_whole, row_of, staged, table, worker_cache, write_whole

#: Of lower-cased UTF-8: what isn't a digit, a-z or part of a character beyond ASCII.
BREAKS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
TO_SPACE = bytes(32 if c in BREAKS else c for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SHARD_WORDS, SHARD_BYTES = 250_000, 4_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(TO_SPACE).split()


class Automaton:
    """Suffix automaton of several word sequences; none is matched across its ends."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids[w] for w in ws]) for item, ws in items if ws]
        ends = [(item, ws, self._add(ws)) for item, ws in coded]
        #: Of each state: the ancestor that stands for runs of exactly `window` words, or -1.
        self.at_window = [-1] * len(self.link)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        for s in order[1:]:
            if self.length[s] >= window:
                up = self.link[s]
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
        #: Items by the state of one of their windows, and short items (length, item) by the state they end in.
        self.items: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for item, ws, end in ends:
            if len(ws) < window:
                self.short.setdefault(end, set()).add((len(ws), item))
            for _, state in self._windows(ws):
                self.items.setdefault(state, set()).add(item)

    def _add(self, ws: list[int]) -> int:
        last, nxt, link, length = 0, self.next, self.link, self.length

        def state(n: int, edges: dict, up: int) -> int:
            nxt.append(edges)
            link.append(up)
            length.append(n)
            return len(link) - 1

        def split(p: int, q: int, w: int) -> int:
            if length[q] == length[p] + 1:
                return q
            clone = state(length[p] + 1, dict(nxt[q]), link[q])
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = clone
            return clone

        for w in ws:
            if w in nxt[last]:
                last = split(last, nxt[last][w], w)
                continue
            cur, p = state(length[last] + 1, {}, 0), last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                link[cur] = split(p, nxt[p][w], w)
            last = cur
        return last

    def _windows(self, ws: list[int]) -> Iterator[tuple[int, int]]:
        """The last position and the state of each run of `window` words."""
        s = n = 0
        for k, w in enumerate(ws):
            s, n = self.step(s, n, w)
            if n >= self.window:
                yield k, self.at_window[s]

    def step(self, s: int, n: int, w: int) -> tuple[int, int]:
        nxt, link, length = self.next, self.link, self.length
        while w not in nxt[s]:
            s = link[s]
            if s < 0:
                return 0, 0
            n = length[s]
        return nxt[s][w], n + 1

    def packed(self) -> dict:
        """Flat arrays: about 70 bytes a word, against a dict for each state while it is built."""
        flat = lambda rows: array("i", [x for row in rows for x in row])
        ends = lambda rows: array("i", accumulate(map(len, rows), initial=0))
        edges = [sorted(e.items()) for e in self.next]
        names = sorted({i for held in (*self.items.values(), *([i for _, i in s] for s in self.short.values())) for i in held})
        number = {n: k for k, n in enumerate(names)}
        windowed, ended = sorted(self.items), sorted(self.short)
        own = set(ended)
        # Of each state the nearest one at or above it in which a short item ends.
        above = array("i", [-1]) * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above[s] = s if s in own else above[self.link[s]]
        return {
            "window": self.window, "words": b"\n".join(self.ids), "names": names,
            "link": array("i", self.link), "length": array("i", self.length), "at_window": array("i", self.at_window), "above": above,
            "root": array("i", [self.next[0].get(w, 0) for w in range(len(self.ids))]),
            "starts": ends(edges), "letters": flat([w for w, _ in e] for e in edges), "targets": flat([t for _, t in e] for e in edges),
            "windowed": array("i", windowed), "item_starts": ends([self.items[s] for s in windowed]), "items": flat([number[i] for i in self.items[s]] for s in windowed),
            "ended": array("i", ended), "short_starts": ends([self.short[s] for s in ended]), "short": flat([x for m, i in self.short[s] for x in (m, number[i])] for s in ended),
        }


class Matcher:
    """Streams words through a packed automaton."""

    def __init__(self, packed: dict):
        self.__dict__.update(packed)
        self.ids = {w: k for k, w in enumerate(packed["words"].split(b"\n"))} if packed["words"] else {}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit words as sorted, disjoint half-open ranges, and the items that hit them."""
        link, length, root, above, window = self.link, self.length, self.root, self.above, self.window
        starts, letters, targets = self.starts, self.letters, self.targets
        found, states, own = [], set(), set()
        s = n = 0
        for k, w in enumerate(map(self.ids.get, words)):
            if w is None:
                s = n = 0
                continue
            while s:
                a, z = starts[s], starts[s + 1]
                if z - a > 1:
                    a = bisect_left(letters, w, a, z)
                if a < z and letters[a] == w:
                    s = targets[a]
                    break
                s = link[s]
                n = length[s]
            else:
                # Every word of an item leaves the root.
                s, n = root[w], 0
            n += 1
            if n >= window:
                states.add(self.at_window[s])
                found.append((k - window + 1, k + 1))
            t = above[s]
            while t > 0:
                at = bisect_left(self.ended, t)
                for x in range(self.short_starts[at], self.short_starts[at + 1]):
                    m = self.short[2 * x]
                    if n >= m:
                        own.add(self.names[self.short[2 * x + 1]])
                        found.append((k - m + 1, k + 1))
                t = above[link[t]]
        for state in states:
            at = bisect_left(self.windowed, state)
            own.update(self.names[i] for i in self.items[self.item_starts[at] : self.item_starts[at + 1]])
        return merged(found), own


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def shards(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[str]:
    """Files of the shared folder, one for each automaton: over at most ``SHARD_WORDS`` words
    of at most ``SHARD_BYTES``, unless one item has more.  Tasks build and write them; none passes
    the driver, and a task holds one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // SHARD_BYTES
    folder = fresh_dir(spark, "automata")

    def build(key, group):
        number, made, held, size, bulk = key[0].as_py(), [], [], 0, 0

        def write() -> None:
            path = f"{folder}/{number}-{len(made)}"
            data = pickle.dumps(Automaton(held, window).packed(), pickle.HIGHEST_PROTOCOL)
            write_whole(path, [data])
            made.append((path, len(data)))
            held.clear()

        for item, text in zip(group.column("item").to_pylist(), group.column("text").to_pylist()):
            ws = words_of(text)
            if held and (size + len(ws) > SHARD_WORDS or bulk + len(text) > SHARD_BYTES):
                write()
                size = bulk = 0
            held.append((str(item), ws))
            size, bulk = size + len(ws), bulk + len(text)
        write()
        return pa.table({"path": pa.array([p for p, _ in made]), "bytes": pa.array([n for _, n in made], pa.int64())})

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    paths = sorted(r["path"] for r in sharded.groupBy("shard").applyInArrow(build, "path string, bytes bigint").collect())
    if not paths:
        # An automaton of nothing still counts words.
        write_whole(empty := f"{folder}/empty", [pickle.dumps(Automaton([], window).packed())])
        return [empty]
    return paths


def _matcher(path: str) -> Matcher:
    """Of a worker one at a time."""
    held = worker_cache("decontamination")
    if path not in held:
        held.clear()
        held[path] = Matcher(pickle.loads(read_whole(path)))
    return held[path]


def _finder(path: str):
    """One pass over the rows, with one automaton."""

    @F.arrow_udf("struct<n_words:bigint,hits:array<int>,items:array<string>>")
    @gives_back
    def leaks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = _matcher(path).scan
        for batch in texts:
            ns, hits, items = [], [], []
            for text in batch.to_pylist():
                ws = words_of(text)
                ranges, own = scan(ws)
                ns.append(len(ws))
                hits.append([x for r in ranges for x in r])
                items.append(sorted(own))
            yield pa.StructArray.from_arrays([pa.array(ns, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["n_words", "hits", "items"])

    return leaks


def _union():
    @F.arrow_udf("array<int>")
    def union(flat: pa.Array) -> pa.Array:
        return pa.array([[x for r in merged(list(zip(f[::2], f[1::2]))) for x in r] for f in flat.to_pylist()], pa.list_(pa.int32()))

    return union


def _passes(rows: DataFrame, paths: list[str]) -> DataFrame:
    """rows: row, text (and more).  Adds n_words, hits and items, by a pass for each automaton; each pass but the last is staged."""
    out, before = rows.withColumn("hits", F.array().cast("array<int>")).withColumn("items", F.array().cast("array<string>")), None
    for k, path in enumerate(paths):
        found = out.drop("n_words").withColumn("found", _finder(path)("text"))
        items = F.array_sort(F.array_distinct(F.concat("items", F.col("found.items")))) if k else F.col("found.items")
        hits = _union()(F.concat("hits", F.col("found.hits"))) if k else F.col("found.hits")
        out = found.withColumn("items", items).withColumn("hits", hits).withColumn("n_words", F.col("found.n_words")).drop("found")
        if k + 1 < len(paths):
            out = staged(out, "leaks")
            if before is not None:
                discard(before)
            before = out
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``row``, text, n_words, ``hits`` (start and end of hit word ranges, flat) and ``items`` (ids as strings, sorted)."""
    rows = docs.select(row_of(docs).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return _passes(rows, shards(benchmark, item_col, item_text_col, window)).select("row", "text", "n_words", "hits", "items")


def cut(text: str, hits: list[int]) -> str:
    """The text without its hit words and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, z in zip(hits[::2], hits[1::2]):
        kept.append(text[at : places[a][0]])
        at = places[z - 1][1]
    return "".join(kept) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without leaked spans, and without documents of which a share of more
    than ``max_coverage`` of the words is hit.  Cutting can bring the two sides of a
    span together; what then matches is cut as well, until nothing does.

    With one automaton that is one pass.  With several, all pass over what is left before
    it is cut, and only rows that were cut go round again."""
    paths = shards(benchmark, item_col, "text", window)
    rows = docs.select(row_of(docs).alias("row"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("double").alias("share"))
    back = lambda done: done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    if len(paths) == 1:
        path = paths[0]

        @F.arrow_udf("struct<text:string,share:double>")
        @gives_back
        def cleaned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scan = _matcher(path).scan
            for batch in texts:
                out, shares = [], []
                for text in batch.to_pylist():
                    share = 0.0
                    while text:
                        ws = words_of(text)
                        hits = scan(ws)[0]
                        if not hits:
                            break
                        share = share or sum(z - a for a, z in hits) / len(ws)
                        text = cut(text, [x for r in hits for x in r])
                    out.append(text)
                    shares.append(share)
                yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(shares, pa.float64())], ["text", "share"])

        # Else the filter gets a pass of its own, with workers of its own.
        cleaned = cleaned.asNondeterministic()
        done = rows.select("row", cleaned("text").alias("own")).select("row", "own.*")
        return back(done.where(F.col("share") <= max_coverage))

    @F.arrow_udf("string")
    def without(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([cut(t, h) for t, h in zip(texts.to_pylist(), hits.to_pylist())], pa.string())

    pairs = F.transform(F.sequence(F.lit(0), F.size("hits") - 1, F.lit(2)), lambda k: F.get("hits", k + 1) - F.get("hits", k))
    finished = []
    while True:
        found = staged(_passes(rows.withColumn("own", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))), paths), "leaks")
        finished.append(found.where("size(hits) = 0").select("row", F.col("own").alias("text"), "share"))
        hit = found.where("size(hits) > 0").withColumn("share", F.coalesce("share", F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / F.col("n_words")))
        hit = hit.where(F.col("share") <= max_coverage)
        if hit.isEmpty():
            return back(reduce(DataFrame.unionByName, finished))
        rows = hit.select("row", without("text", "hits").alias("text"), "share")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("hits") - 1, F.lit(1)), lambda k: F.when(k % 2 == 0, -F.get("hits", k)).otherwise(F.get("hits", k)))
    n_hit = F.when(F.size("hits") == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda a, x: a + x)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH lower_docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM lower_docs),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item_id, ws, least(len(ws), 10) AS m FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i+m-1], ' ') AS g FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM n)),
sizes AS (SELECT DISTINCT m FROM g),
w AS (SELECT doc_id, i, m, array_to_string(ws[i:i+m-1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, greatest(len(ws) - m + 2, 1))) AS i FROM d, sizes)),
h AS (SELECT doc_id, i, w.m, item_id FROM w JOIN g ON w.g = g.g AND w.m = g.m),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(k.n, 0)::BIGINT AS n_items, sha256(coalesce(k.items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
