"""Best-fit packing of token sequences by hierarchical residual packing.

Level 0: every partition cuts its documents into pieces, packs them best-fit
decreasing and emits the bins that are nearly full.  What is left goes up a tree:
the underfull bins of ``FAN_IN`` neighbours meet as items and are packed again,
until one group remains.

What goes up is bounded.  After best fit at most one bin of a partition is half
full or less (two such would have been one), and only such a bin can move into
another.  A parent therefore merges at most ``FAN_IN`` bins, and needs no more
hosts than that: each child sends its ``FAN_IN + 1`` emptiest bins and closes the
rest.  No merging task ever holds more than about ``FAN_IN ** 2`` bins, at any input size.

A task of level 0 packs whenever it holds ``HELD`` pieces.  Bins that then have room
take pieces it reads later, best fit (``Hosts``); their places are final, so only a
number of each is held.  Pieces that are in one bin by then aren't parted again.

Defined results: null text counts as empty (one token, the end); a text of any
length is tokenised whole and cut into ``capacity`` pieces; repeated rows are
separate documents; null ids are kept; empty tables give no rows; other columns of
the input are not read.  Lost executors: level 0 and each merged level are written
to the shared folder, so no bin is packed twice in different ways.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back, staged, table, worker_cache

FAN_IN = 16
#: Bins with at most so many free tokens are closed at once.
CLOSED = 8
#: Pieces a task holds before it packs them; bins with room then stay open for what it reads later.
HELD = 250_000
#: Entries of a task's caches; full ones take no more, as frequent words come early.
CACHE_LIMIT, CACHED_CHARS = 500_000, 64
#: Chunks of these characters are composed already, and lower-case character by character.
PLAIN = re.compile(r"[\x21-\x7E\xA1-\u012F\u0131-\u024F]+")
#: What the pre-tokenizer makes of lower-case text; letters and digits are Unicode's.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = dict(zip(sorted(set(range(256)) - VISIBLE), range(256, 512))) | {b: b for b in VISIBLE}


class WordTokens(dict):
    """Space-separated chunk to the bytes of its ids (little-endian, 32 bits each).

    The tokenizer drops white space, so chunks are independent of each other; so are
    the parts of a chunk that its pre-tokenizer makes.  Parts go to the library's BPE
    model directly; chunks with unusual characters, or that may hold a special token,
    go through the whole tokenizer.  A tokenizer for which this gives other ids than
    it does itself, on a few telling texts, gets whole texts."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        self.split = True
        cases = ("It's a Test, isn't\nIT? 12ab", "we'll  go-go (x) don'ts", "A\n\n'S e", "\u00c9l\u00e8ve, \u00bd \u00aa\u00d7\u017f \u0130x Stra\u00dfe\u2026", "e\u0301 a<|endoftext|>b \u4e2d\u6587")
        self.split = all(self.encoded(t) == self.ids(t) for t in cases)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.parts.clear()

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(BYTES)
        out = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))
        if len(self.parts) < CACHE_LIMIT and len(part) <= CACHED_CHARS:
            self.parts[part] = out
        return out

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            out = b""
        elif PLAIN.fullmatch(chunk) and "<|" not in chunk:
            parts = self.parts
            out = b"".join(parts[p] if p in parts else self.part(p) for p in PARTS.findall(chunk.lower()))
        else:
            out = self.encoded(chunk)
        if len(chunk) <= CACHED_CHARS and len(self) < CACHE_LIMIT:
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if not self.split:
            return self.encoded(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes.  Items go, largest first, to the fullest bin that has room.
    Free space is at most ``capacity``, so the bins with room are the bits of one integer."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in order:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class Hosts:
    """Bins whose pieces have been given out, by room; more pieces fit behind those."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, sequence: int, room: int) -> None:
        if room > CLOSED:
            self.by_room[room].append(sequence)
            self.rooms |= 1 << room

    def take(self, items: list[tuple[int, int, list[tuple]]]) -> tuple[list[tuple], list[tuple[int, int, list[tuple]]]]:
        """Rows of the items that fit, largest first, each in the fullest bin with room; the other items."""
        rows, others = [], []
        for item in sorted(items, key=lambda x: -x[1]):
            fits = self.rooms >> item[1]
            if not fits:
                others.append(item)
                continue
            room = item[1] + (fits & -fits).bit_length() - 1
            sequence = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms ^= 1 << room
            rows += [(*p[:5], sequence, p[6] + self.capacity - room, None) for p in item[2]]
            self.add(sequence, room - item[1])
        return rows, others

    def keep(self, rows: list[tuple]) -> None:
        """Of closed rows: the bins with room."""
        used: dict[int, int] = {}
        for p in rows:
            used[p[5]] = used.get(p[5], 0) + p[3]
        for sequence, n in used.items():
            self.add(sequence, self.capacity - n)


#: A piece in its sequence.  grp: the group that packs it again; null where its sequence is closed.
SCHEMA = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, grp bigint"
FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "grp")
KINDS = (None, pa.int32(), *[pa.int64()] * 6)


def _rows(rows: list[tuple], id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 50_000):
        columns = zip(*rows[k : k + 50_000])
        yield pa.record_batch([pa.array(c, t or id_kind) for c, t in zip(columns, KINDS)], FIELDS)


def _packed(items: list[tuple[int, int, list[tuple]]], capacity: int, grp: int | None, last: bool) -> tuple[list[tuple], list[tuple[int, int, list[tuple]]]]:
    """items: (sequence id, tokens, pieces).  Closed rows, and the bins that stay open.
    A bin takes the id of its first item; the pieces of the others move behind it."""
    open_bins, closed = [], []
    for members in best_fit([x[1] for x in items], capacity):
        sequence, used, pieces = items[members[0]][0], 0, []
        for m in members:
            pieces += [(*p[:5], sequence, p[6] + used, grp) for p in items[m][2]]
            used += items[m][1]
        if last or capacity - used <= CLOSED:
            closed += [(*p[:7], None) for p in pieces]
        else:
            open_bins.append((sequence, used, pieces))
    open_bins.sort(key=lambda b: b[:2][::-1])
    closed += [(*p[:7], None) for b in open_bins[FAN_IN + 1 :] for p in b[2]]
    return closed, open_bins[: FAN_IN + 1]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = SCHEMA.format(id=source.schema["doc_id"].dataType.simpleString())
    end = end_id.to_bytes(4, "little")

    @gives_back
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = worker_cache("packing")
        if tokenizer_path not in held:
            held[tokenizer_path] = WordTokens(tokenizer_path)
        words, part = held[tokenizer_path], TaskContext.get().partitionId()
        items, made, id_kind, hosts = [], part << 32, pa.int64(), Hosts(capacity)
        for batch in batches:
            id_kind, whole = batch.schema.field(0).type, []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.ids(text or "") + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    piece = (doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), made, 0, None)
                    whole.append(piece) if size == capacity else items.append((made, size, [piece]))
                    made += 1
            yield from _rows(whole, id_kind)
            if len(items) > HELD:
                placed, items = hosts.take(items)
                closed, items = _packed(items, capacity, part, False)
                hosts.keep(closed)
                yield from _rows(placed + closed, id_kind)
        # An idle worker keeps the tokenizer, not the words of its last task.
        words.forget()
        placed, items = hosts.take(items)
        closed, items = _packed(items, capacity, part, False)
        yield from _rows(placed + closed + [p for b in items for p in b[2]], id_kind)

    def merger(groups: int):
        def merge(key, group):
            grp, bins = key[0].as_py(), {}
            for row in zip(*[group.column(f).to_pylist() for f in FIELDS]):
                bins.setdefault(row[5], []).append(row)
            items = [(s, sum(p[3] for p in pieces), sorted(pieces, key=lambda p: p[6])) for s, pieces in sorted(bins.items())]
            closed, left = _packed(items, capacity, grp, groups == 1)
            kind = group.schema.field("doc_id").type
            rows = closed + [p for b in left for p in b[2]]
            return pa.Table.from_batches(list(_rows(rows, kind)), pa.schema([pa.field(f, t or kind) for f, t in zip(FIELDS, KINDS)]))

        return merge

    level = staged(source.mapInArrow(first, schema), "packing")
    done = [level.where("grp IS NULL")]
    groups = (level.agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // FAN_IN)
        going = level.where("grp IS NOT NULL").withColumn("grp", F.expr(f"grp div {FAN_IN}"))
        level = staged(going.groupBy("grp").applyInArrow(merger(groups), schema), "packing")
        done.append(level.where("grp IS NULL"))
        if groups == 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("grp")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
