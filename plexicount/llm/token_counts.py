"""Token counts by a map-side two-tier lookup.

A text falls into pre-tokens that the tokenizer's merges never cross.  Tier one is
a broadcast table of the lengths (in tokens) of frequent pre-tokens; its size is
bounded by ``table_size``.  Tier two is a cache in each Python worker, bounded by
``CACHE_LIMIT``, filled by the tokenizer itself.  Neither changes any result: a
pre-token in no tier is encoded.  No pre-token is ever shuffled; what moves is one
bounded frequency sketch per task, merged by a tree.

Why the split is exact for a piece model (BPE, identity normaliser, dummy prefix):
no piece has the space mark after another character, and none has a newline but
the byte piece, so no merge spans the start of a run of marks or touches a newline.
``PieceCounter`` verifies both properties of the vocabulary it is given and
encodes whole texts where they don't hold.

Defined results: null text counts as empty (0 tokens); texts are never cut, however
long; repeated rows and ties give equal counts; an empty table gives no rows; the
caller's columns come back unchanged inside ``row``, so none can clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, table, worker_cache

#: Entries of a worker's cache; it is emptied when full.
CACHE_LIMIT = 400_000
#: Longer pre-tokens are encoded each time, so the cache's bytes are bounded too.
CACHED_CHARS = 64
MARK = "▁"
SKETCH, TABLE = 4096, 16384


class _Lengths(dict):
    """Pre-token to its number of tokens; what is missing is looked up in tier one, then encoded."""

    def __init__(self, first: dict, encode):
        super().__init__()
        self.first, self.encode = first, encode

    def __missing__(self, key: str) -> int:
        n = self.first.get(key)
        if n is None:
            n = self.encode(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHE_LIMIT:
                self.clear()
            self[key] = n
        return n


class PieceCounter:
    """Counts tokens as a sentencepiece model gives them.

    Keys of the cache: ``" word"`` stands after exactly one space, ``"word"`` at the
    start of a later line; runs of several spaces go to the keys as they are."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.exact = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and self.model.encode("\n", out_type=str) == [MARK, "<0x0A>"] and self.model.encode("  a ", out_type=str)[-1] == MARK
        self.after = _Lengths(frequent, lambda w: self._n(w) if w else 1)
        self.heads = _Lengths({}, lambda w: self._n("\n" + w) - 2 if w else 0)
        self.runs = _Lengths({}, lambda w: self._n(w[1:]) if w[1:] else 1)

    def _n(self, text: str) -> int:
        return len(self.model.encode(text))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.exact or MARK in text:
            return self._n(text)
        total, after, heads = 0, self.after.__getitem__, self.heads.__getitem__
        for k, line in enumerate(text.split("\n")):
            if "  " in line or line[:1] == " " and not k:
                line = line if k else " " + line
                for run in re.findall(" +[^ ]*|[^ ]+", line):
                    total += self.runs[run] if run[0] == " " else heads(run)
            else:
                words = line.split(" ")
                total += (heads if k else after)(words[0]) + sum(map(after, words[1:]))
            total += k > 0
        return total


def _pruned(counts: Counter, most: int) -> Counter:
    return Counter(dict(counts.most_common(most)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(w for w in text.replace("\n", " ").split(" ") if w and len(w) <= CACHED_CHARS)
        if len(counts) > 50 * SKETCH:
            counts = _pruned(counts, 10 * SKETCH)
    yield _as_row(_pruned(counts, SKETCH))


def _as_row(counts: Counter) -> pa.RecordBatch:
    return pa.record_batch({"words": pa.array(["\n".join(counts)], pa.string()), "counts": pa.array([list(counts.values())], pa.list_(pa.int64()))})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if counts:
                total.update(dict(zip(words.split("\n"), counts)))
                if len(total) > 8 * TABLE:
                    total = _pruned(total, 2 * TABLE)
    yield _as_row(_pruned(total, TABLE))


def frequent_pretokens(docs: DataFrame, text_col: str = "text", fan_in: int = 32) -> list[str]:
    """At most ``TABLE`` pre-tokens that are frequent over all documents.  Each task
    sends one sketch of at most ``SKETCH`` words; sketches are merged ``fan_in`` at a time."""
    kind = "words string, counts array<bigint>"
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    sketches, parts = texts.mapInArrow(_sketch, kind), max(1, texts.rdd.getNumPartitions())
    while parts > fan_in:
        parts = -(-parts // fan_in)
        sketches = sketches.repartition(parts).mapInArrow(_merged, kind)
    best = sketches.repartition(1).mapInArrow(_merged, kind).collect()
    return [w for r in best for w in r["words"].split("\n") if w]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), n_bytes, n_tokens, over_limit.

    ``model_path``: a sentencepiece ``.model`` file, at the same place on every machine."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    words = frequent_pretokens(docs, text_col)
    lengths = bytes(min(len(ids), 255) for ids in model.encode(words)) if words else b""
    compact = docs.sparkSession.sparkContext.broadcast(("\n".join(words), lengths))

    @F.arrow_udf("bigint")
    def n_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = None
        held = worker_cache("token_counts")
        names, sizes = compact.value
        key = (model_path, hash(names))
        counter = held.get(key)
        if counter is None:
            held.clear()
            frequent = {w: n for w, n in zip(names.split("\n"), sizes) if n < 255}
            counter = held[key] = PieceCounter(model_path, frequent)
        for batch in texts:
            yield pa.array([counter.count(t) for t in batch.to_pylist()], pa.int64())

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counted = docs.select(row_of(docs).alias("row"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.select("row", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
