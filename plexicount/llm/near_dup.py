"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents are sets of distinct five-word shingles; two are linked when their Jaccard
similarity is at least ``PERCENT`` / 100, and components of links are duplicates.

1.  One pass makes, for each document, the digest of its shingle set and a signature
    of ``HASHES`` minima.  Equal sets become one class with a number of its own (an id may
    have several sets) and its smallest id, so thousands of copies cost one
    signature from here on.
2.  Signatures are cut into bands; classes with a band in common are candidates.  A
    bucket is compared with its smallest member first (a star: as many pairs as
    members).  Only where members of a bucket still lie in different components are
    the pairs between those components compared, in tasks that hold two blocks of at
    most about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles with signatures and
    sets.  No pair of a bucket is left out; a task gives out a spanning forest of
    the links it verified, so its rows are bounded by its members, not by its pairs.
3.  Verification is sequential: ``BATCH`` hashes at a time are compared, and a pair
    is dropped as soon as the posterior probability that it is similar enough, under
    a uniform prior, falls below ``MISS``.
4.  Survivors are verified exactly on the full shingle sets, made again from the
    texts of just those documents.
5.  Components come from label propagation with pointer jumping over the links of
    classes; each round is written to the shared folder.  A component is named by
    the smallest id of its classes.

A class that many link to, or a label that many have, is one key of the joins above.
The ``MOST`` most frequent keys are counted first; where they have more than ``HOT`` rows,
these are dealt over up to ``SPREAD`` copies of what they join with (``spread_join``), so no
task gets a third of all rows.

A pair at exactly 0.75 shares no band with probability (1 - 0.75**4)**32, 5 in a
million; pruning adds ``MISS``.  There is no cap on buckets, partners or candidates.

Defined results: null and empty texts have no shingles and are linked with nothing;
a text of fewer than five words is one shingle, the whole sequence; ties go to the
smallest id, in the order of the ids' own type; repeated rows keep their rows, and rows that share an id are one
document for linking; rows with a null id are linked with nothing and kept; other
columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, gives_back, row_of, staged, table, worker_cache

WORDS, PERCENT = 5, 75
BANDS, ROWS, BATCH, MISS = 32, 4, 16, 1e-6
HASHES = BANDS * ROWS
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Rows from which on a join key is dealt, how many such keys (a task gets less than one in MOST of
#: all rows by any other), and over how many tasks at most.
HOT, MOST, SPREAD = 256, 10_000, 1000
#: Links for each file of labels.
FILE_ROWS = 200_000
#: Entries of the 0/1 matrices by which many pairs are verified at once.
CELLS = 8_000_000
CACHE_LIMIT, CACHED_BYTES = 100_000, 64
#: Odd multipliers of the rolling combination of word hashes, by position, and of sequences shorter than a shingle.
MIX = np.random.default_rng(20).integers(1, 2**63, 2 * WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.random.default_rng(21)
SLOPES = _R.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _R.integers(0, 2**32, HASHES, dtype=np.uint32)


def _word_hashes() -> dict:
    held = worker_cache("near_dup")
    if "words" not in held:
        import xxhash

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                h = xxhash.xxh3_64_intdigest(word)
                if len(word) <= CACHED_BYTES:
                    if len(self) >= CACHE_LIMIT:
                        self.clear()
                    self[word] = h
                return h

        held["words"] = Words()
    return held["words"]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, n)
    if n < WORDS:
        mixed = np.array([(h * MIX[WORDS : WORDS + n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)
    else:
        mixed = h[: n - WORDS + 1] * MIX[0]
        for k in range(1, WORDS):
            mixed += h[k : n - WORDS + 1 + k] * MIX[k]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed)


def digest(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def signature(found: np.ndarray) -> np.ndarray:
    folded = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(folded), 2048):
        np.minimum(out, (folded[k : k + 2048, None] * SLOPES + SHIFTS).min(axis=0), out=out)
    return out


def least_matches(share: float, miss: float) -> list[int]:
    """For each number of compared hashes, in batches: the fewest matches at which
    P(similarity >= share | matches) >= miss.  With a uniform prior that
    probability is the chance of at most so many successes in n + 1 trials."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indexes of the pairs (rows of a and b) that no batch rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, cut] == b[alive, cut]).sum(axis=1, dtype=np.int32)
        on = matches >= need
        alive, matches = alive[on], matches[on]
    return alive


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


@gives_back
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        ns, digests, signatures = [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text)
            ns.append(len(found))
            digests.append(digest(found) if len(found) else None)
            signatures.append(signature(found).tobytes() if len(found) else None)
        yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])
    _word_hashes().clear()  # an idle worker keeps no words


@gives_back
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of doc, text, digest: the shingle sets of the rows whose set has that digest."""
    for batch in _few(batches):
        docs, sets = [], []
        for doc, text, known in zip(*[c.to_pylist() for c in batch.columns]):
            found = shingles(text)
            if digest(found) == known:
                docs.append(doc)
                sets.append(found.tobytes())
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])
    _word_hashes().clear()


def _kept_pairs(least: list[int]):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
                yield pa.record_batch([batch.column(k).take(pa.array(on)) for k in (0, 1)], ["a", "b"])

    return run


@gives_back
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        on = []
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                on.append(k)
        yield pa.record_batch([batch.column(k).take(pa.array(on, pa.int64())) for k in (0, 1)], ["a", "b"])


class Forest:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices, over some columns at a time."""
    n = len(sets)
    columns, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total, step = np.zeros((n, n)), max(256, CELLS // n)
    for at in range(0, len(columns), step):
        lo, hi = np.searchsorted(place, (at, at + step))
        held = np.zeros((n, min(step, len(columns) - at)), np.float32)
        held[row[lo:hi], place[lo:hi] - at] = 1
        total += held @ held.T
    return total


def _between(least: list[int]):
    """Within a pair of blocks of one bucket: a forest of the links between different components."""

    def run(key, group):
        band, first, second = (key[k].as_py() for k in (1, 2, 3))
        block, node, label = (group.column(c).to_numpy() for c in ("block", "node", "label"))
        rows, sets = _matrix(group.column("signature")), [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
        x, y = (np.flatnonzero(block == b) for b in (first, second))
        likely, near = [], Forest(len(node))
        for i in x:
            others = y[(label[y] != label[i]) & ((node[y] > node[i]) | (first != second))]
            if not len(others):
                continue
            others = others[surviving(np.broadcast_to(rows[i], (len(others), HASHES)), rows[others], least)]
            # A pair belongs to the first band it shares.
            shared = (rows[others, : band * ROWS] == rows[i, : band * ROWS]).reshape(len(others), band, ROWS).all(axis=2).any(axis=1)
            for j in others[~shared].tolist():
                likely.append((int(i), j))
                near.join(int(i), j)
        pieces: dict[int, list] = {}
        for pair in likely:
            pieces.setdefault(near.root(pair[0]), []).append(pair)
        linked, found = Forest(len(node)), []
        for pairs in pieces.values():
            members = sorted({k for pair in pairs for k in pair})
            at = {m: k for k, m in enumerate(members)}
            both = intersections([sets[m] for m in members])
            for i, j in pairs:
                n = both[at[i], at[j]]
                if 100 * n >= PERCENT * (len(sets[i]) + len(sets[j]) - n) and linked.join(i, j):
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """hot, copies: of the ``MOST`` most frequent keys those of more rows than a task should get,
    and over how many tasks they are dealt; None where there are none."""
    counted = rows.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    top = counted.orderBy(F.col("n").desc()).limit(MOST).select("hot", F.least(F.ceil(F.col("n") / HOT), F.lit(SPREAD)).cast("int").alias("copies")).collect()
    return rows.sparkSession.createDataFrame(top, f"hot {rows.schema[key].dataType.simpleString()}, copies int") if top else None


def spread_join(rows: DataFrame, found: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of ``found`` for each ``key``.  Rows of a hot key are dealt
    by a hash of ``by`` over copies of what is found; ``hot`` has at most ``MOST`` rows."""
    if hot is None:
        return rows.join(found, key, how)
    held = F.broadcast(hot)
    dealt = rows.join(held, F.col(key) == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("copies", F.lit(1))).cast("int")).drop("hot", "copies")
    names = [c for c in found.columns if c != key]
    copied = found.select(F.col(key).alias("found_key"), *names).join(held, F.col("found_key") == F.col("hot"), "left")
    copied = copied.withColumn("found_part", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("hot", "copies")
    return dealt.join(copied, (F.col(key) == F.col("found_key")) & (F.col("part") == F.col("found_part")), how).drop("part", "found_key", "found_part")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for the nodes of ``links`` (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "near-links")
    # Files of a size, whatever the number of shuffle partitions.
    files = 1 + both.count() // FILE_ROWS
    before = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")).coalesce(files), "near-labels")
    labels, hot = before, hot_keys(both, "b")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("b"), "label"), "b", "a", hot).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("l2"))
        # Labels only merge, so those that were frequent are the ones that are.
        jumped = spread_join(stepped, above, "label", "node", hot_keys(labels, "label"), "left").select("node", "old", F.least("label", F.coalesce("l2", "label")).alias("label"))
        done = staged(jumped.coalesce(files), "near-labels")
        discard(before)
        labels, before = done.select("node", "label"), done
        if done.where("label <> old").isEmpty():
            discard(both)
            return labels


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    least = least_matches(PERCENT / 100, miss)
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = staged(source.mapInArrow(_signed, f"doc_id {kind}, n_shingles bigint, digest binary, signature binary"), "near-signed")
    known = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    # Written once, so that the numbers stay.
    classes = staged(known.groupBy("digest").agg(F.min("doc_id").alias("name")).withColumn("node", F.monotonically_increasing_id()), "near-classes")
    own = known.join(classes, (known.digest == classes.digest) & (known.doc_id == classes.name)).select("node", "name", classes.digest, "n_shingles", "signature").dropDuplicates(["node"])
    own = staged(own, "near-own")
    # Rows that share an id but not a set make their classes one component.
    several = known.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("z")).where("x < z").select("doc_id", F.col("x").alias("digest"))
    shared = None
    if not several.isEmpty():
        firsts = several.join(classes, "digest").select("doc_id", F.col("node").alias("a"))
        held = staged(known.join(classes, "digest").select("doc_id", F.col("node").alias("b")).distinct(), "near-held")
        shared = spread_join(held, firsts, "doc_id", "b", hot_keys(held, "doc_id")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(BANDS)])
    bands = own.select("node", F.posexplode(keys).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = staged(bands.join(buckets, "key").select("key", "band", "node", "pivot"), "near-members")
    stars = staged(members.where("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")
    centres = hot_keys(stars, "a")

    def signatures(end: str) -> DataFrame:
        return own.select(F.col("node").alias(end), F.col("signature").alias(f"signature_{end}"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """node, shingles, made again from the texts of the wanted nodes."""
        texts = source.join(wanted.join(own.select("node", "name", "digest"), "node"), F.col("doc_id") == F.col("name")).select("node", "text", "digest")
        return staged(texts.mapInArrow(_sets, "node bigint, shingles binary"), "near-sets").dropDuplicates(["node"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "near-survivors")
        sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return spread_join(pairs.join(right, "b"), left, "a", "b", centres).select("a", "b", "x", "y").mapInArrow(_linked, "a bigint, b bigint")

    likely = spread_join(stars.join(signatures("b"), "b"), signatures("a"), "a", "b", centres).select("a", "b", "signature_a", "signature_b").mapInArrow(_kept_pairs(least), "a bigint, b bigint")
    links = verified(likely)
    links = staged(links if shared is None else links.unionByName(shared), "near-star-links")
    discard(stars)
    labels = components(links)
    # Buckets whose members the stars have not all joined.
    placed = members.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
    torn = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high AND size > 2").select("key")
    rest = staged(placed.join(torn, "key"), "near-torn")
    if not rest.isEmpty():
        slim = own.select("node", "n_shingles", "signature")
        sizes = rest.join(slim.select("node", "n_shingles"), "node").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        dealt = rest.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        pairs_of = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
        spread = dealt.select("key", "band", "block", "node", "label", F.explode(pairs_of).alias("p"))
        spread = spread.join(slim.select("node", "signature"), "node").join(sets_of(rest.select("node").distinct()), "node")
        found = spread.select("key", "band", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "node", "label", "signature", "shingles").groupBy("key", "band", "i", "j").applyInArrow(_between(least), "a bigint, b bigint")
        more = staged(found.distinct(), "near-more-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    linked = staged(labels.join(classes, "node").select("digest", "label", "name"), "near-linked")
    discard(members, own, rest, links)
    named = linked.join(linked.groupBy("label").agg(F.min("name").alias("least")), "label").select(F.col("digest").alias("d"), "least")
    placed = classes.join(named, F.col("digest") == F.col("d"), "left").select("digest", F.coalesce("least", "name").alias("component_id"))
    ids = signed.select("doc_id", "n_shingles", "digest")
    out = ids.join(placed, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def single_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each group of near-duplicates, with all columns: of the smallest
    id, null ids last, the first such row.  Rows that share an id are of one group,
    empty texts included; rows with a null id are linked by their texts."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("at"), row_of(docs).alias("row")), "near-rows")
    slim = rows.select("at", F.col(f"row.`{id_col}`").alias("own"))
    found = find_near_duplicates(rows.select("at", F.col(f"row.`{text_col}`").alias("text")), "at", "text")
    placed = staged(slim.join(found.select("doc_id", "component_id"), slim.at == F.col("doc_id")).select("at", "own", F.col("component_id").alias("grp")), "near-placed")
    # Groups that share an id are one; ids of one group link nothing more.
    several = placed.where("own IS NOT NULL").groupBy("own").agg(F.min("grp").alias("a"), F.max("grp").alias("z")).where("a < z").select("own", "a")
    links = staged(placed.join(several, "own").where("a < grp").select("a", F.col("grp").alias("b")).distinct(), "near-id-links")
    if not links.isEmpty():
        merged = components(links)
        placed = placed.join(merged, F.col("grp") == F.col("node"), "left").select("at", "own", F.coalesce("label", "grp").alias("grp"))
    first = placed.groupBy("grp").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "at")).alias("m")).select(F.col("m.at").alias("at"))
    gone = placed.join(first, "at", "left_anti").select("at")
    return rows.join(gone, "at", "left_anti").select("row.*")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each group of near-duplicates keeps the smallest id, with all columns.
    All rows of that id stay, and rows with a null id; ``single_near_duplicates`` keeps one row of a group."""
    found = find_near_duplicates(docs, id_col, text_col)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(row_of(docs).alias("row"))
    return rows.join(gone, F.col(f"row.`{id_col}`") == F.col("gone"), "left_anti").select("row.*")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(table(spark, sf_dir, "documents"))
