"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated n-gram model over all training documents, of order 2 or 3:
level 1 of the trie holds words, level 2 their successors, level 3 the successors of
pairs.  Levels are sharded files in the shared folder, which workers map into memory;
nothing of the model passes the driver but one small row of figures per shard, and
nothing of it is broadcast.

Level 1 (shards by range of the words' 64-bit hashes): the sorted hashes, the
cumulative counts (both Elias-Fano coded) and the quantised back-off weight of each
word; a word's rank over all shards is its id.  Level 2 (shards by hash of the pair,
so that the successors of a frequent word spread over all of them): the contexts,
monotone pointers to where the successors of each begin, the successors, coded
relative to their context as one monotone sequence, and their quantised discounted
probabilities.  Level 3 lies in the shard of its context, the pair: a pointer for each
pair of that shard, successors relative to the pair's place, probabilities, and the pair's
back-off weight.  A query finds its context, then searches for the successor of its
word between the context's pointers.  One pass over the texts counts for levels 2 and 3: each
pair goes with the word that follows it.

p(w | u v) = max(n(u v w) - D, 0) / n(u v) + D t(u v) / n(u v) p(w | v), t: distinct
successors; p(w | v) likewise, down to p(w) = (n(w) + 0.1) / (N + 0.1 (V + 1)).  An end
stands after each text and before the next, as context of its first word; a context of
two words doesn't reach across it.  Probabilities are kept in 65,536 steps of log10.

Counting combines in the task: only sorted distinct keys with their counts travel,
delta-coded.  Shards grow in number with the input's partitions, so neither a task's
memory nor a file grows with the corpus.  Where the shared folder can't be mapped, a
worker holds at most ``HELD_BYTES`` of shards and reads the others again.

Defined results: null text counts as empty (one token, the end); a null id counts as
the empty text, whose remainder is 0, so the row is held out; ids may be of any type; texts
are whole whatever their length; repeated rows count and score each; with no training
document all words are unknown; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, filesystem, fresh_dir, read_whole, staged, table, worker_cache, write_whole

END = b" end"  # no word has a space
DISCOUNT, ADDED = 0.75, 0.1
STEPS, LOWEST = 65535, -16.0
#: Bytes of text that are worked on together, pairs after which a task sends on its counts, words of a worker's cache.
TOGETHER, FLUSH, CACHED = 2_000_000, 3_000_000, 400_000
ORDER = 3
#: Bytes of shards that a worker keeps where it can't map them.
HELD_BYTES = 256 << 20
U = np.uint64


#: Ones in each byte, the top bit of each, and the place of the k-th set bit of a byte, at 256 k + byte.
BYTES, TOPS = U(0x0101010101010101), U(0x8080808080808080)
IN_BYTE = np.array([next((p for p in range(8) if b >> p & 1 and bin(b & ((1 << p) - 1)).count("1") == k), 0) for k in range(8) for b in range(256)], U)


class EliasFano:
    """A monotone sequence of n integers under a bound, in about 2 + log2(bound / n) bits each."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, n: int, width: int):
        self.low, self.high, self.ones, self.zeros, self.n, self.width = low, high, ones, zeros, n, width

    @staticmethod
    def arrays(values: np.ndarray, bound: int) -> dict:
        values = np.asarray(values, U)
        n = len(values)
        width = max(0, (max(bound, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, U)
        if n and width:
            part = values & U((1 << width) - 1)
            at = np.arange(n, dtype=U) * U(width)
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift + U(width) > U(64))
            low[word[over] + 1] |= part[over] >> (U(64) - shift[over])  # at most one for each word
        place = (values >> U(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(((bound >> width) + n) // 64 + 2, U)
        if n:
            word = place >> 6
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            high[word[first]] = np.bitwise_or.reduceat(U(1) << (place & 63).astype(U), first)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        zeros = 64 * np.arange(len(ones)) - ones
        kind = np.uint32 if 64 * len(high) < 2**32 else np.uint64
        return {"low": low, "high": high, "ones": ones.astype(kind), "zeros": zeros.astype(kind), "meta": np.array([n, width], np.int64)}

    @classmethod
    def of(cls, arrays: dict) -> EliasFano:
        return cls(arrays["low"], arrays["high"], arrays["ones"], arrays["zeros"], *map(int, arrays["meta"]))

    @staticmethod
    def _bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit (from 0) of each word: the byte by counts that add up from the left, then a table."""
        x = words - ((words >> U(1)) & U(0x5555555555555555))
        x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
        upto = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * BYTES
        k = k.astype(U)
        # Bytes up to whose end there are at most k bits.
        at = U(8) * np.bitwise_count((((k * BYTES) | TOPS) - upto) & TOPS).astype(U)
        before = (upto << U(8)) >> at & U(255)
        return at + IN_BYTE[(k - before) * U(256) + (words >> at & U(255))]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        back = np.where(shift == 0, U(0), self.low[word + 1] << ((U(64) - shift) & U(63)))
        return ((self.low[word] >> shift) | back) & U((1 << self.width) - 1)

    def _one(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the i-th set bit: its word and its place there."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        return word, self._bit(self.high[word], i - self.ones[word].astype(np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        word, at = self._one(i)
        return (((word * 64).astype(U) + at - i.astype(U)) << U(self.width)) | self._low(i)

    def span(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i + 1; the next set bit mostly is in the same word."""
        word, at = self._one(i)
        first = (((word * 64).astype(U) + at - i.astype(U)) << U(self.width)) | self._low(i)
        rest = (self.high[word] >> at) >> U(1)
        gap = np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(U)
        second = (((word * 64).astype(U) + at + gap - i.astype(U)) << U(self.width)) | self._low(i + 1)
        far = np.flatnonzero(rest == 0)
        second[far] = self.get(i[far] + 1)
        return first.astype(np.int64), second.astype(np.int64)

    def _bucket(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to where values have these high bits: between two zeros, which mostly are in the same word."""
        word, at = self._zero(np.maximum(bucket - 1, 0))
        low = np.where(bucket > 0, word * 64 + at.astype(np.int64) - bucket + 1, 0)
        rest = (~self.high[word] >> at) >> U(1)
        gap = np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)
        high = low + gap
        far = np.flatnonzero((rest == 0) | (bucket == 0))
        word, at = self._zero(bucket[far])
        high[far] = word * 64 + at.astype(np.int64) - bucket[far]
        return low, high

    def _zero(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the k-th unset bit: its word and its place there."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        return word, self._bit(~self.high[word], k - self.zeros[word].astype(np.int64))

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, or -1: the successor search of its bucket's values, between ``begin`` and ``end`` if given."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(U)
        top = U(len(self.high) * 64 - self.n - 1)
        inside = np.flatnonzero((x >> U(self.width)) < top)
        bucket = (x[inside] >> U(self.width)).astype(np.int64)
        lo, hi = self._bucket(bucket)
        if begin is not None:
            lo, hi = np.maximum(lo, begin[inside]), np.minimum(hi, end[inside])
        wanted = x[inside] & U((1 << self.width) - 1)
        while len(inside):
            on = np.flatnonzero(lo < hi)
            inside, wanted, lo, hi = inside[on], wanted[on], lo[on], hi[on]
            mid = (lo + hi) >> 1
            value = self._low(mid)
            hit = value == wanted
            out[inside[hit]] = mid[hit]
            up = value < wanted
            lo, hi = np.where(up, mid + 1, lo), np.where(up, hi, mid)
            hi[hit] = lo[hit]
        return out


def write_level(path: str, parts: dict[str, np.ndarray]) -> None:
    """Arrays in one file: header, then each, aligned."""
    head, at, bodies = {}, 0, []
    for name, array in parts.items():
        array = np.ascontiguousarray(array)
        head[name] = [array.dtype.str, array.size, at]
        bodies.append(array.tobytes() + bytes(-array.nbytes % 64))
        at += len(bodies[-1])
    text = json.dumps(head).encode()
    text = len(text).to_bytes(8, "little") + text
    write_whole(path, (text, bytes(-len(text) % 64), *bodies))


def open_level(path: str) -> tuple[dict[str, np.ndarray], int]:
    """The arrays of a level, mapped into memory where the shared folder is a file system, and the bytes that takes where it isn't."""
    fs, place = filesystem(path)
    mapped = fs.type_name == "local"
    data = np.memmap(place, np.uint8, "r") if mapped else np.frombuffer(read_whole(path), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head, start = json.loads(data[8 : 8 + size].tobytes()), (8 + size + 63) // 64 * 64
    return {k: data[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}, 0 if mapped else len(data)


def _coded(prefix: str, arrays: dict) -> dict:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def _decoded(prefix: str, arrays: dict) -> EliasFano:
    return EliasFano.of({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(prefix + ".")})


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((log10 - LOWEST) / -LOWEST * STEPS), 0, STEPS).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code.astype(np.float64) / STEPS * -LOWEST + LOWEST)


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


class Trie:
    """All levels, by the figures of their shards.  Files are opened when first needed."""

    def __init__(self, figures: dict):
        self.figures, self.files, self.held = figures, {}, 0
        self.vocabulary, self.tokens = figures["vocabulary"], figures["tokens"]
        self.offsets = np.asarray(figures["offsets"], np.int64)
        self.word_bits = (len(self.offsets) - 1).bit_length()

    def _file(self, name: str) -> dict | None:
        level, shard = name.split("-")
        if shard not in self.figures[level]:
            return None
        if name in self.files:
            # The last used come last.
            self.files[name] = made = self.files.pop(name)
            return made[0]
        arrays, size = open_level(f"{self.figures['path']}/{name}")
        self.held += size
        for old in list(self.files):
            if self.held <= HELD_BYTES:
                break
            self.held -= self.files.pop(old)[1]
        made = {k: _decoded(k, arrays) for k in {x.split(".")[0] for x in arrays if "." in x}} | {k: v for k, v in arrays.items() if "." not in k}
        self.files[name] = (made, size)
        return made

    def _by_word_shard(self, ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = np.searchsorted(self.offsets, ranks, "right") - 1
        for s in np.unique(shard):
            yield int(s), np.flatnonzero(shard == s)

    def ranks(self, found: np.ndarray) -> np.ndarray:
        """Word hashes to ranks; -1 for words never seen."""
        out = np.full(len(found), -1, np.int64)
        shard = (found >> U(64 - self.word_bits)).astype(np.int64) if self.word_bits else np.zeros(len(found), np.int64)
        for s in np.unique(shard):
            file, on = self._file(f"words-{s}"), np.flatnonzero(shard == s)
            if file:
                at = file["hashes"].find(found[on])
                out[on] = np.where(at >= 0, at + self.offsets[s], -1)
        return out

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ranks), np.int64)
        for s, on in self._by_word_shard(ranks):
            at, cumulated = ranks[on] - self.offsets[s], self._file(f"words-{s}")["cumulated"]
            out[on] = cumulated.get(at + 1).astype(np.int64) - cumulated.get(at).astype(np.int64)
        return out

    def backoffs(self, ranks: np.ndarray) -> np.ndarray:
        out = np.ones(len(ranks))
        for s, on in self._by_word_shard(ranks):
            out[on] = _value(self._file(f"backoffs-{s}")["codes"][ranks[on] - self.offsets[s]])
        return out

    def pairs(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair its shard, its place there (-1 if it was never seen) and its discounted probability (then 0)."""
        out, place = np.zeros(len(contexts)), np.full(len(contexts), -1, np.int64)
        shard = pair_shard(contexts.astype(U) * U(self.vocabulary) + words.astype(U), self.figures["pair_shards"])
        for s, on in _by_shard(shard):
            file = self._file(f"pairs-{s}")
            if not file:
                continue
            context = file["contexts"].find(contexts[on])
            on, context = on[context >= 0], context[context >= 0]
            begin, end = file["pointers"].span(context)
            at = file["successors"].find(context.astype(U) * U(self.vocabulary) + words[on].astype(U), begin, end)
            place[on] = at
            on, at = on[at >= 0], at[at >= 0]
            out[on] = _value(file["codes"][at])
        return shard, place, out

    def triples(self, shard: np.ndarray, place: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs, by shard and place, each with a word that follows: the discounted probability (0 if never seen) and the pair's back-off weight."""
        out, weight = np.zeros(len(shard)), np.ones(len(shard))
        for s, on in _by_shard(shard):
            on = on[np.argsort(place[on])]  # neighbours in the file one after the other
            file = self._file(f"triples-{s}")
            if not file:
                continue
            weight[on] = _value(file["backoffs"][place[on]])
            on = on[words[on] >= 0]
            begin, end = file["pointers"].span(place[on])
            at = file["successors"].find(place[on].astype(U) * U(self.vocabulary) + words[on].astype(U), begin, end)
            on, at = on[at >= 0], at[at >= 0]
            out[on] = _value(file["codes"][at])
        return out, weight


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    for on in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        yield int(shard[on[0]]), on


def pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = (keys ^ (keys >> U(31))) * U(0x9E3779B97F4A7C15)
    return ((mixed >> U(33)) % U(shards)).astype(np.int64)


def _sent(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys with counts, by shard: first key, steps between keys, counts, each as narrow as it can be."""
    order = np.argsort(shard, kind="stable")
    rows = []
    for on in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        steps = np.diff(keys[on])
        rows.append((int(shard[on[0]]), int(keys[on[0]].astype(np.int64)), len(on), _narrow(steps), _narrow(counts[on])))
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "first", "n", "steps", "counts"])


SENT = "shard bigint, first bigint, n bigint, steps binary, counts binary"


def _received(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sum of what tasks sent to a shard: sorted distinct keys, counts."""
    keys, counts = [], []
    for first, n, steps, count in zip(*[group.column(c).to_pylist() for c in ("first", "n", "steps", "counts")]):
        keys.append(np.cumsum(np.r_[np.array([first], np.int64).view(U), _wide(steps, n - 1)], dtype=U))
        counts.append(_wide(count, n).astype(np.int64))
    return summed(np.concatenate(keys), np.concatenate(counts))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


SENT3 = "shard bigint, first bigint, n bigint, steps binary, spans binary, words binary, counts binary"


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{len(b) // n}").astype(U) if n else np.empty(0, U)


def _summed_triples(pairs: np.ndarray, words: np.ndarray, counts: np.ndarray | None, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, how many successors each has, these, and their counts."""
    distinct, place = np.unique(pairs, return_inverse=True)
    keys = place.astype(U) * U(vocabulary) + words
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
    else:
        keys, counts = summed(keys, counts)
    place = (keys // U(vocabulary)).astype(np.int64)
    return distinct, np.bincount(place, minlength=len(distinct)), keys % U(vocabulary), counts


def _sent_triples(pairs: np.ndarray, spans: np.ndarray, words: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    ends, rows = np.cumsum(spans), []
    for shard, on in _by_shard(pair_shard(pairs, shards)):
        # The successors of the shard's pairs, which lie in stretches.
        starts, sizes = (ends - spans)[on], spans[on]
        inner = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        rows.append((shard, int(pairs[on[0]].astype(np.int64)), len(on), _narrow(np.diff(pairs[on])), _narrow(sizes), _narrow(words[inner]), _narrow(counts[inner])))
    if rows:
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in SENT3.split(", ")])


def _received_triples(group: pa.Table, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pairs, words, counts = [], [], []
    for first, n, steps, spans, word, count in zip(*[group.column(c).to_pylist() for c in ("first", "n", "steps", "spans", "words", "counts")]):
        keys = np.cumsum(np.r_[np.array([first], np.int64).view(U), _wide(steps, n - 1)], dtype=U)
        sizes = _wide(spans, n).astype(np.int64)
        pairs.append(np.repeat(keys, sizes))
        words.append(_wide(word, int(sizes.sum())))
        counts.append(_wide(count, int(sizes.sum())).astype(np.int64))
    return _summed_triples(np.concatenate(pairs), np.concatenate(words), np.concatenate(counts), vocabulary)


class Tokens:
    """The words of some texts: distinct ones, for each token which one it is, and how many each text has."""

    def __init__(self, texts: pa.Array):
        lowered = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lowered)
        self.sizes = np.where(pc.equal(lowered, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = split.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary.cast(pa.binary()).to_pylist()
        if b"" in self.words:  # what an empty text splits into
            self.codes = self.codes[self.codes != self.words.index(b"")]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], Tokens]]:
    """Columns but the last, and the last one's words, about TOGETHER bytes of text at a time."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, z in zip(cuts, cuts[1:]):
            yield [c.slice(a, z - a) for c in batch.columns[:-1]], Tokens(texts.slice(a, z - a))


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(counts: Counter) -> Iterator[pa.RecordBatch]:
            keys, n = summed(hashes(list(counts)), np.fromiter(counts.values(), np.int64, len(counts)))
            yield from _sent((keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64), keys, n)

        counts: Counter = Counter()
        for _, tokens in _pieces(batches):
            found = np.bincount(tokens.codes, minlength=len(tokens.words)).tolist()
            counts.update({w: n for w, n in zip(tokens.words, found) if n})
            counts[END] += len(tokens.sizes)
            if len(counts) > 2 * CACHED:
                yield from send(counts)
                counts = Counter()
        if counts:
            yield from send(counts)

    return run


def _trie_of(figures: dict) -> Trie:
    held = worker_cache("lm_scoring")
    # While a trie is built the same path comes with more and more levels.
    key = (figures["path"], len(figures["pairs"]), len(figures["backoffs"]), len(figures["triples"]))
    if key not in held:
        held.clear()
        held[key] = (Trie(figures), {})
    return held[key]


def _ranked(trie: Trie, known: dict, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all words with an end before the first text and after each; where each text's tokens end."""
    wanted = [*tokens.words, END]
    missing = [w for w in wanted if w not in known]
    if len(known) + len(missing) > CACHED:
        known.clear()
        missing = wanted
    known.update(zip(missing, trie.ranks(hashes(missing)).tolist()))
    ranks = np.fromiter(map(known.__getitem__, wanted), np.int64, len(wanted))
    ends = np.cumsum(tokens.sizes + 1)
    flat = np.full(int(ends[-1]) + 1, ranks[-1])
    words = np.ones(len(flat), bool)
    words[0] = False
    words[ends] = False
    flat[words] = ranks[tokens.codes]
    return flat, ends


def _count_pairs(figures: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _trie_of(figures)
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from _sent(pair_shard(keys, figures["pair_shards"]), keys, counts)

        for _, tokens in _pieces(batches):
            ranks, _ = _ranked(trie, known, tokens)
            held.append(ranks[:-1].astype(U) * U(trie.vocabulary) + ranks[1:].astype(U))
            size += len(held[-1])
            if size >= FLUSH:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    return run


def _inner(ranks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places, in the sequence, of the words whose two predecessors are in their text or the end before it."""
    return np.setdiff1d(np.arange(1, len(ranks)), np.r_[0, ends[:-1]] + 1, assume_unique=True)


def _count_triples(figures: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _trie_of(figures)
        held, size, v = [], 0, U(max(figures["vocabulary"], 1))

        def send() -> Iterator[pa.RecordBatch]:
            pairs, words = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            yield from _sent_triples(*_summed_triples(pairs, words, None, int(v) + 1), figures["pair_shards"])

        for _, tokens in _pieces(batches):
            ranks, ends = _ranked(trie, known, tokens)
            ranks = ranks.astype(U)
            # Every pair is sent once, with the word that follows; one that ends its text with a mark that is no word.
            follow = np.r_[ranks[2:], v]
            follow[ends - 1] = v
            held.append((ranks[:-1] * v + ranks[1:], follow.astype(np.uint32 if v < 2**32 else U)))
            size += len(follow)
            if size >= FLUSH:
                yield from send()
                size = 0
        if size:
            yield from send()

    return run


def _score(figures: dict, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _trie_of(figures)
        total = trie.tokens + ADDED * (trie.vocabulary + 1)
        for columns, tokens in _pieces(batches):
            ranks, ends = _ranked(trie, known, tokens)
            distinct, place = np.unique(ranks, return_inverse=True)
            seen = distinct >= 0
            count, weight = np.zeros(len(distinct), np.int64), np.ones(len(distinct))
            count[seen], weight[seen] = trie.counts(distinct[seen]), trie.backoffs(distinct[seen])
            p, n, alpha = ((count + ADDED) / total)[place[1:]], count[place[1:]], weight[place[:-1]]
            both = np.flatnonzero((ranks[:-1] >= 0) & (ranks[1:] >= 0))
            seen_part, shard, at = np.zeros(len(p)), np.zeros(len(p), np.int64), np.full(len(p), -1, np.int64)
            # Frequent pairs are looked up once.
            keys, back = np.unique(ranks[both] * trie.vocabulary + ranks[both + 1], return_inverse=True)
            found = trie.pairs(keys // max(trie.vocabulary, 1), keys % max(trie.vocabulary, 1))
            shard[both], at[both], seen_part[both] = (f[back] for f in found)
            q = seen_part + alpha * p
            if figures["order"] > 2:
                inner = _inner(ranks, ends) - 1
                # The pair before each word, where it is known; an unknown word is only weighted.
                inner = inner[at[inner - 1] >= 0]
                longer, rest = trie.triples(shard[inner - 1], at[inner - 1], ranks[inner + 1])
                q[inner] = longer + rest * q[inner]
            # A text's first word follows an end, which is what stands before it in the sequence.
            starts = np.r_[0, ends[:-1]]
            sums = lambda x: np.add.reduceat(x, starts)
            yield pa.record_batch([
                columns[0].cast(kind), columns[1], pa.array(np.diff(np.r_[0, ends]), pa.int64()), pa.array(sums((n > 0).astype(np.int64)), pa.int64()),
                pa.array(np.full(len(ends), trie.tokens), pa.int64()), pa.array(sums(np.log10(p))), pa.array(sums(np.log10(q))),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> dict:
    """Builds the levels over all rows of ``docs``; gives the figures that a ``Trie`` opens them by."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    path = fresh_dir(spark, "lm-trie")
    parts = max(2, texts.rdd.getNumPartitions())
    bits = max(1, (parts // 4).bit_length())
    figures = {"path": path, "order": order, "pair_shards": 2 * parts, "words": {}, "pairs": {}, "backoffs": {}, "triples": {}}

    def word_level(key, group):
        keys, counts = _received(group)
        shard = key[0].as_py()
        write_level(f"{path}/words-{shard}", _coded("hashes", EliasFano.arrays(keys, 2**64 - 1)) | _coded("cumulated", EliasFano.arrays(np.r_[0, np.cumsum(counts)], int(counts.sum()))))
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    sent = texts.mapInArrow(_count_words(bits), SENT)
    made = {r["shard"]: r for r in sent.groupBy("shard").applyInArrow(word_level, "shard bigint, n bigint, total bigint").collect()}
    sizes = [made[s]["n"] if s in made else 0 for s in range(2**bits)]
    figures |= {"words": {str(s): 1 for s in made}, "vocabulary": sum(sizes), "tokens": sum(r["total"] for r in made.values()), "offsets": [0, *np.cumsum(sizes)[:-1].tolist()]}

    def _level_two(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        """Writes the shard's pairs; what it sends on: how many successors each context has here."""
        trie, _ = _trie_of(figures)
        v = U(max(trie.vocabulary, 1))
        context, word = (keys // v).astype(np.int64), keys % v
        begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        contexts, spans = context[begin], np.diff(np.r_[begin, len(keys)])
        place = np.repeat(np.arange(len(contexts)), spans)
        p = np.maximum(counts - DISCOUNT, 1e-9) / trie.counts(contexts)[place]
        parts = _coded("contexts", EliasFano.arrays(contexts, trie.vocabulary)) | _coded("pointers", EliasFano.arrays(np.r_[begin, len(keys)], len(keys)))
        parts |= _coded("successors", EliasFano.arrays(place.astype(U) * v + word, len(contexts) * int(v)))
        write_level(f"{path}/pairs-{shard}", parts | {"codes": quantised(np.log10(p))})
        shards = np.searchsorted(trie.offsets, contexts, "right") - 1
        # Empty shards share their offset with the next one, which "right" passes to.
        rows = [b for b in _sent(shards, contexts.astype(U), spans)]
        figure = pa.RecordBatch.from_arrays([pa.array([-1 - shard], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], ["shard", "first", "n", "steps", "counts"])
        return pa.Table.from_batches([figure, *rows])

    def pair_level(key, group):
        return _level_two(key[0].as_py(), *_received(group))

    def both_levels(key, group):
        shard, v = key[0].as_py(), max(figures["vocabulary"], 1)
        pairs, spans, words, counts = _received_triples(group, v + 1)
        sent = _level_two(shard, pairs, np.add.reduceat(counts, np.cumsum(spans) - spans))
        owner, real = np.repeat(np.arange(len(pairs)), spans), words < U(v)
        owner, words, counts = owner[real], words[real], counts[real]
        spans, total = np.bincount(owner, minlength=len(pairs)), np.bincount(owner, counts, len(pairs))
        backoffs = quantised(np.log10(np.where(total > 0, DISCOUNT * spans / np.maximum(total, 1), 1.0)))
        parts = _coded("pointers", EliasFano.arrays(np.r_[0, np.cumsum(spans)], len(words))) | _coded("successors", EliasFano.arrays(owner.astype(U) * U(v) + words, len(pairs) * v))
        write_level(f"{path}/triples-{shard}", parts | {"codes": quantised(np.log10(np.maximum(counts - DISCOUNT, 1e-9) / np.maximum(total, 1)[owner])), "backoffs": backoffs})
        return sent

    def backoff_level(key, group):
        trie, _ = _trie_of(figures)
        shard = key[0].as_py()
        contexts, successors = _received(group)
        contexts = contexts.astype(np.int64)
        codes = np.full(sizes[shard], STEPS, np.uint16)
        codes[contexts - figures["offsets"][shard]] = quantised(np.log10(DISCOUNT * successors / trie.counts(contexts)))
        write_level(f"{path}/backoffs-{shard}", {"codes": codes})
        return pa.table({"shard": pa.array([shard], pa.int64())})

    if made:
        sent = texts.mapInArrow(_count_pairs(figures), SENT) if order == 2 else texts.mapInArrow(_count_triples(figures), SENT3)
        spread = staged(sent.groupBy("shard").applyInArrow(pair_level if order == 2 else both_levels, SENT), "lm-pairs")
        figures["pairs"] = {str(-1 - r["shard"]): 1 for r in spread.where("shard < 0").select("shard").collect()}
        figures["triples"] = dict(figures["pairs"]) if order > 2 else {}
        done = spread.where("shard >= 0").groupBy("shard").applyInArrow(backoff_level, "shard bigint").collect()
        figures["backoffs"] = {str(r["shard"]): 1 for r in done}
        discard(spread)
    return figures


def score(docs: DataFrame, figures: dict) -> DataFrame:
    """docs: doc_id, held_out, text.  One row per document with its counts and log10 probabilities."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(figures, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    return score(docs, train(docs.where("NOT held_out")))
