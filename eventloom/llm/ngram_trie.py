"""Language-model scores from n-gram tries in Elias-Fano form, built and asked shard by shard.

A shard has all n-grams that continue some words: for each such word its successors, the
words that may stand before it, and for each of these pairs its successors again, written as
their places among the successors of the last word alone. All of these lists are non-decreasing
numbers relative to where the list of the context before ended, so that a level is one
increasing sequence in Elias-Fano form: low bits packed, high bits in unary, and the
positions of some of them. Pointers to lists are such sequences, too. Next to the levels lie
quantised probabilities and back-off weights. A shard's levels are one file that is mapped
into memory; a query finds the list of its context by the pointers and in it the successor
that it asks for.

Probabilities are smoothed by a Dirichlet prior of the shorter context: that of a word after
two others mixes its share among what followed these with its probability after the second
one, that one with its share among all words, which is never 0.

How Spark runs it: texts are cut into words once and kept in blocks; blocks' distinct words
meet the vocabulary, part by part; each block sends its distinct n-grams with their training counts to the
shards, a shard adds up, builds its trie, and answers each block with a number an n-gram.
Words that are followed by more than a shard holds are split by the word that comes next.
"""

from __future__ import annotations

import os
import re
import tempfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookups import numbered
from .common import chunks, stash, unsigned_crc32, unstash

#: Training leaves out the documents whose id gives remainder 0.
FOLDS = 10
#: What every word of the vocabulary, and the unknown one, is counted in addition.
ADDED = 0.1
#: How much the shorter context weighs, in counts: after one word, after two.
PRIOR = (1000.0, 4.0)
#: Tokens of a block, and about so many of a shard.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 20
#: What follows words that stand more often than this lies in several shards.
SPLIT_TOKENS = 1 << 21
#: Parts of the vocabulary at most; up to then four for each split of the input.
PARTS = 4096
#: Bytes of a text cut into words at once.
PIECE = 1 << 20
UNKNOWN, BEGIN, END, FIRST_WORD = 0, 1, 2, 3
#: Steps of a quantised probability in a power of ten; 16 bits reach down to 10^-32.
STEPS = 2048
#: Each so many-th number's position among the high bits is kept.
SAMPLED = 512
#: Queries that are looked up at once.
SLICE = 1 << 19

_GAP = re.compile(rb"[\x20\t-\r]")


class EliasFano:
    """Non-decreasing numbers: low bits packed, high bits in unary, the position of every ``SAMPLED``-th one."""

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.size, self.width, self.low, self.high, self.samples = size, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        width = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        at = (values >> width) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        low = []
        for s in range(0, n if width else 0, 1 << 18):  # a multiple of 8, so parts end with whole bytes
            bits = values[s : s + (1 << 18), None] >> np.arange(width) & 1
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        return cls(n, width, np.concatenate([np.zeros(0, np.uint8), *low]), np.packbits(high, bitorder="little"), at[::SAMPLED].astype(np.int64))

    def decode(self, start: int, end: int) -> np.ndarray:
        """The numbers from start to before end."""
        start, end = max(0, start), min(end, self.size)
        if start >= end:
            return np.zeros(0, np.int64)
        first = start // SAMPLED
        last = -(-end // SAMPLED)
        from_byte = int(self.samples[first]) // 8
        to_byte = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[from_byte:to_byte], bitorder="little")) + 8 * from_byte
        ones = ones[np.searchsorted(ones, self.samples[first]) :]
        index = np.arange(start, end)
        values = (ones[start - first * SAMPLED : end - first * SAMPLED] - index) << self.width
        if self.width:
            from_bit = start * self.width
            bits = np.unpackbits(self.low[from_bit // 8 : -(-end * self.width // 8)], bitorder="little")[from_bit % 8 :][: (end - start) * self.width]
            wide = np.zeros((end - start, -(-self.width // 8) * 8), np.uint8)
            wide[:, : self.width] = bits.reshape(-1, self.width)
            for k, byte in enumerate(np.packbits(wide, axis=1, bitorder="little").T):
                values |= byte.astype(np.int64) << 8 * k
        return values

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.size, self.width], np.int64), self.low, self.high, self.samples]


def relative(lists: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """One increasing sequence of ascending targets of lists: each is added to where the list before ended."""
    if not len(targets):
        return np.zeros(0, np.int64)
    last = np.append(lists[1:] != lists[:-1], True)
    ends = np.where(last, targets + 1, 0).astype(np.int64)
    return np.cumsum(ends) - ends + targets + 1


def successors(sequence: EliasFano, pointers: EliasFano, lists: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Where each target lies in its list, -1 where it isn't; ``lists`` ascend."""
    out = np.full(len(lists), -1)
    for s in range(0, len(lists), SLICE):
        c, t = lists[s : s + SLICE], targets[s : s + SLICE]
        bounds = pointers.decode(int(c[0]), int(c[-1]) + 2)
        begin, end = bounds[c - c[0]], bounds[c - c[0] + 1]
        first = max(0, int(bounds[0]) - 1)
        held = sequence.decode(first, int(bounds[-1]))
        if not len(held):
            continue
        base = np.where(begin > 0, held[np.maximum(begin - 1 - first, 0)], 0)
        at = np.searchsorted(held, base + t + 1)
        met = np.minimum(at, len(held) - 1)
        found = (at + first < end) & (held[met] == base + t + 1)
        out[s : s + SLICE] = np.where(found, at + first, -1)
    return out


def packed(*columns: np.ndarray) -> np.ndarray:
    """One number for each row that sorts as its columns do."""
    key, bits = columns[0].astype(np.int64), int(columns[0].max(initial=0)).bit_length()
    for column in columns[1:]:
        more = int(column.max(initial=0)).bit_length()
        if bits + more > 63:
            key = np.unique(key, return_inverse=True)[1]
            bits = int(key.max(initial=0)).bit_length()
        key, bits = key << more | column, bits + more
    return key


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65535).astype(np.uint16)


class Counts:
    """Counts by id. Ids go by falling count, so a count is a step of a short table: of at most as many steps as the root of twice the tokens."""

    def __init__(self, steps: list[tuple[int, int]], trained: int):
        """``steps``: falling counts and how many words have each; ``trained``: documents, each of which has a beginning and an end."""
        self.trained = trained
        self.count = np.array([0, *(c for c, _ in steps), 0], np.int64)
        self.first = np.cumsum([0, FIRST_WORD, *(n for _, n in steps)])
        self.words = int(self.first[-1]) - FIRST_WORD
        self.tokens = sum(c * n for c, n in steps) + trained
        self.distinct = self.words + (trained > 0)

    def of(self, ids: np.ndarray) -> np.ndarray:
        found = self.count[np.searchsorted(self.first, ids, "right") - 1]
        return np.where((ids == BEGIN) | (ids == END), self.trained, found)

    def share(self, ids: np.ndarray) -> np.ndarray:
        """The probability of words without context."""
        return (self.of(np.where(ids == BEGIN, UNKNOWN, ids)) + ADDED) / (self.tokens + ADDED * (self.distinct + 1))

    def splits(self, ids: np.ndarray) -> np.ndarray:
        """Over how many shards what follows a word is spread."""
        return np.maximum(1, -(-self.of(ids) // SPLIT_TOKENS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)).astype(np.int64)


class Trie:
    """The levels of a shard. ``Trie.build`` makes them, ``saved`` maps them from a file."""

    SEQUENCES = ("words", "next_at", "next", "before_at", "before", "third_at", "third")
    CODES = ("next_code", "third_code", "word_weight", "pair_weight")

    def __init__(self, sequences: list[EliasFano], codes: list[np.ndarray]):
        for name, part in zip(self.SEQUENCES + self.CODES, [*sequences, *codes]):
            setattr(self, name, part)

    @classmethod
    def build(cls, counts: Counts, grams: tuple, pairs: tuple, prior: tuple[float, float] = PRIOR) -> Trie:
        """``grams``: last word, the one before, next word, count, ascending. ``pairs``: last word, the one before, how often the two are followed at all; ascending, with all of the grams' pairs."""
        (v, u, w, n), (pv, pu, pn) = grams, pairs
        words = np.unique(pv)
        # Successors of single words.
        keys, first, at = np.unique(packed(v, w), return_index=True, return_inverse=True)
        nv, nw, nn = v[first], w[first], np.bincount(at, n, len(keys))
        owner = np.searchsorted(words, nv)
        p2 = (nn + prior[0] * counts.share(nw)) / (counts.of(nv) + prior[0])
        next_at = np.searchsorted(owner, np.arange(len(words) + 1))
        # Successors of pairs, as places among those of the last word.
        pair = np.searchsorted(_pair_keys(words, pv, pu), _pair_keys(words, v, u))
        p3 = (n + prior[1] * p2[at]) / (pn[pair] + prior[1])
        pair_owner = np.searchsorted(words, pv)
        sequences = [
            words,
            next_at,
            relative(owner, nw),
            np.searchsorted(pair_owner, np.arange(len(words) + 1)),
            relative(pair_owner, pu),
            np.searchsorted(pair, np.arange(len(pv) + 1)),
            relative(pair, at - next_at[owner[at]]),
        ]
        weights = [quantised(m / (c + m)) for m, c in zip(prior, (counts.of(words), pn))]
        return cls([EliasFano.of(s) for s in sequences], [quantised(p2), quantised(p3), *weights])

    def saved(self) -> Trie:
        """The same, mapped from a file that goes when the task ends."""
        parts = [p for name in self.SEQUENCES for p in getattr(self, name).parts()] + [getattr(self, name) for name in self.CODES]
        handle, path = tempfile.mkstemp(prefix="trie-")
        try:
            with os.fdopen(handle, "wb") as f:
                for part in parts:
                    f.write(np.ascontiguousarray(part).tobytes() + bytes(-part.nbytes % 8))
            size = os.path.getsize(path)
            held = np.memmap(path, np.uint8, "r") if size else np.zeros(0, np.uint8)
        finally:
            os.unlink(path)  # what is mapped stays until it is let go
        out, at = [], 0
        for part in parts:
            out.append(held[at : at + part.nbytes].view(part.dtype))
            at += part.nbytes + -part.nbytes % 8
        n = len(self.SEQUENCES)
        return Trie([EliasFano(int(a[0]), int(a[1]), b, c, d) for a, b, c, d in (out[4 * k : 4 * k + 4] for k in range(n))], out[4 * n :])

    def ask(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For next words after two, ascending by the last word, then the one before: twice the quantised log probability, and 1 if the word's own share is still to be added."""
        cost, open_ = np.zeros(len(v), np.int64), np.ones(len(v), bool)
        words = self.words.decode(0, self.words.size)
        if not len(words):
            return cost << 1 | open_
        at = np.minimum(np.searchsorted(words, v), len(words) - 1)
        rows = np.flatnonzero(words[at] == v)
        at = at[rows]
        second = successors(self.next, self.next_at, at, w[rows])
        pair = successors(self.before, self.before_at, at, u[rows])
        third = np.full(len(rows), -1)
        both = np.flatnonzero((second >= 0) & (pair >= 0))
        if len(both):
            begin = self.next_at.decode(0, self.next_at.size)
            third[both] = successors(self.third, self.third_at, pair[both], second[both] - begin[at[both]])

        def code(table: np.ndarray, places: np.ndarray) -> np.ndarray:
            return np.where(places >= 0, table[np.maximum(places, 0)].astype(np.int64), 0) if len(table) else np.zeros(len(places), np.int64)

        shorter = np.where(second >= 0, code(self.next_code, second), code(self.word_weight, at))
        cost[rows] = np.where(third >= 0, code(self.third_code, third), code(self.pair_weight, pair) + shorter)
        open_[rows] = (third < 0) & (second < 0)
        return cost << 1 | open_


def _pair_keys(words: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One number a pair; a word's number among ``words`` and an id have 63 bits together."""
    return np.searchsorted(words, v).astype(np.int64) << 34 | u


class Block:
    """Documents as places in the ascending ids of the block's words."""

    def __init__(self, docs: list, held: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, ids: np.ndarray):
        """``lengths`` without and ``tokens`` without the ends."""
        self.docs, self.held, self.ids = docs, held, ids
        self.ends = np.cumsum(lengths + 1)
        last = self.ends - 1
        self.w = np.full(int(self.ends[-1]) if len(docs) else 0, np.searchsorted(ids, END))
        inner = np.ones(len(self.w), bool)
        inner[last] = False
        self.w[inner] = tokens
        first, begin = np.append(0, self.ends[:-1])[: len(docs)], np.searchsorted(ids, BEGIN)
        self.v = np.append(begin, self.w[:-1])
        self.v[first] = begin
        self.u = np.append(begin, self.v[:-1])
        self.u[first] = begin
        self.trained = np.repeat(~held, lengths + 1)

    def grams(self, counts: Counts, shards: int):
        """For each token after a known word its n-gram; of each n-gram the columns, training count and shard. N-grams ascend in each shard."""
        asked = np.flatnonzero(self.v != np.searchsorted(self.ids, UNKNOWN))
        keys, first, of = np.unique(packed(self.v[asked], self.u[asked], self.w[asked]), return_index=True, return_inverse=True)
        n = np.bincount(of, self.trained[asked], len(keys)).astype(np.int64)
        places = asked[first]
        v, u, w = (self.ids[c[places]] for c in (self.v, self.u, self.w))
        shard = (_mix(v) + _mix(w) % counts.splits(v)) % shards
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return asked, place[of], [c[order] for c in (v, u, w, n)], shard[order]


_CODEC = pa.Codec("zstd", compression_level=7)


def to_bytes(*columns: np.ndarray) -> bytes:
    """Whole numbers byte by byte, compressed: all first bytes of a column, then all second ones, as many as its largest needs. Begins with how many there are."""
    out = []
    for c in columns:
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        out += [bytes([width]), np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    raw = b"".join(out)
    return np.array([len(columns[0]), len(raw)], np.int64).tobytes() + _CODEC.compress(raw, asbytes=True)


def from_bytes(data: bytes, columns: int) -> list[np.ndarray]:
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    raw = _CODEC.decompress(data[16:], size, asbytes=True)
    at, out = 0, []
    for _ in range(columns):
        width = raw[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(wide.view("<i8").ravel())
        at += 1 + n * width
    return out


def _steps_of(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending pairs as differences."""
    dv = np.diff(v, prepend=0)
    return dv, np.where(dv > 0, u, np.diff(u, prepend=0))


def _pairs_of(dv: np.ndarray, du: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v, sums = np.cumsum(dv), np.cumsum(du)
    starts = np.flatnonzero((dv > 0) | (np.arange(len(dv)) == 0))
    before = sums[starts] - du[starts]
    return v, sums - np.repeat(before, np.diff(np.append(starts, len(dv))))


#: What texts are cut into: for each block a row for each part of the vocabulary with the block's words in it, and one (part null) with its documents and tokens.
CUT = "block long, part int, words binary, docs binary, tokens binary, n long, trained long"
_CUT = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("docs", pa.binary()), ("tokens", pa.binary()), ("n", pa.int64()), ("trained", pa.int64())])
_DOCS = pa.schema([("doc", pa.int64()), ("held", pa.bool_()), ("length", pa.int64())])
#: A word's place in its block, and its count in the block's training documents or, later, its id.
_WORDS = pa.schema([("at", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])
_IDS = pa.schema([("at", pa.int32()), ("id", pa.int64())])
#: Entries of a part that are held until they are added up or looked up together.
HELD = 1 << 20


def _packed_table(columns, schema: pa.Schema) -> bytes:
    """Arrow's stream format. Many entries are one row for Spark, which compresses well and costs little to move."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _docs_from_bytes(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    t = _table(data)
    return t["doc"].to_pylist(), t["held"].to_numpy(), t["length"].to_numpy()


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words, A to Z lower-cased, some at a time."""
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > PIECE:
            gap = _GAP.search(data, start + PIECE)
            end = gap.start() if gap else end
        yield data[start:end].lower().split()
        start = end


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _cut(vocabulary_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, _Held()
        for batch in chunks(batches, 64):
            for doc, out, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.add(doc, out, text or b"")
                if held.total >= BLOCK_TOKENS:
                    yield from held.rows(block, vocabulary_parts)
                    block, held = block + 1, _Held()
        if held.docs:
            yield from held.rows(block, vocabulary_parts)

    return run


class _Held:
    """The documents of a block so far."""

    def __init__(self) -> None:
        self.index, self.docs, self.held, self.lengths, self.parts, self.total = _Index(), [], [], [], [], 0

    def add(self, doc: int | None, held: bool, text: bytes) -> None:
        size = 0
        for words in _words(text):
            self.parts.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
            size += len(words)
        self.docs.append(doc), self.held.append(held), self.lengths.append(size)
        self.total += size

    def rows(self, block: int, parts: int) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([np.zeros(0, np.int32), *self.parts])
        words = list(self.index)
        n = np.bincount(tokens[np.repeat(~np.array(self.held), self.lengths)], minlength=len(words))
        part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
        order = np.argsort(part, kind="stable")
        every = pa.array(words, pa.binary()).take(pa.array(order))
        bounds = np.flatnonzero(np.diff(part[order], prepend=-1))
        for s, e in zip(bounds, np.append(bounds[1:], len(order))):
            data = _packed_table((order[s:e].astype(np.int32), every.slice(s, e - s), n[order[s:e]]), _WORDS)
            yield _row(_CUT, block=block, part=int(part[order[s]]), words=data)
        docs = _packed_table((self.docs, self.held, self.lengths), _DOCS)
        yield _row(_CUT, block=block, docs=docs, tokens=to_bytes(tokens), n=len(tokens) + len(self.docs), trained=len(self.held) - sum(self.held))


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part of the vocabulary; its words and their counts in training documents."""

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for _, parts in _by_block(batches, "part", lazily=True):
        held, size = [], 0
        for batch in parts:
            for data in batch.column("words"):
                held.append(_table(data.as_buffer()).select(["word", "n"]))
                size += held[-1].num_rows
                if size > HELD:
                    held = [added(held)]
                    size = 0
        total = added(held)
        yield from total.filter(pa.compute.greater(total["n"], 0)).rename_columns(["word", "c"]).combine_chunks().to_batches(max_chunksize=1 << 16)


#: The ids of a block's words.
PLACED = "block long, ids binary"
_PLACED = pa.schema([("block", pa.int64()), ("ids", pa.binary())])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part: the vocabulary's words and ids, then the blocks' words; gives those that are known."""

    def found(blocks: list[int], tables: list[pa.Table], words: pa.ChunkedArray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        every = pa.concat_tables(tables)
        at = pa.compute.index_in(every["word"], value_set=words)
        known = at.is_valid().to_numpy()
        place, at = every["at"].to_numpy(), pa.compute.fill_null(at, 0).to_numpy()
        start = 0
        for block, table in zip(blocks, tables):
            here = np.flatnonzero(known[start : start + table.num_rows]) + start
            start += table.num_rows
            yield _row(_PLACED, block=block, ids=_packed_table((place[here], ids[at[here]]), _IDS))

    for _, parts in _by_block(batches, "part", lazily=True):
        words, ids, blocks, tables, size, value_set = [], [], [], [], 0, None
        for batch in parts:
            own = batch.filter(pa.compute.is_null(batch.column("block")))
            words.append(own.column("word")), ids.append(own.column("id").to_numpy(zero_copy_only=False))
            rest = batch.filter(pa.compute.is_valid(batch.column("block")))
            for block, data in zip(rest.column("block").to_pylist(), rest.column("words")):
                value_set = value_set or (pa.chunked_array(words, pa.binary()), np.concatenate(ids))
                blocks.append(block), tables.append(_table(data.as_buffer()))
                size += tables[-1].num_rows
                if size > HELD:
                    yield from found(blocks, tables, *value_set)
                    blocks, tables, size = [], [], 0
        if tables:
            yield from found(blocks, tables, *value_set)


#: What blocks send: to each shard its n-grams, and (shard -1) the block itself with the pairs of words whose successors lie in several shards.
SENT = "shard int, block long, grams binary, docs binary, tokens binary, ids binary, pairs array<struct<v:long,u:long,to:int,n:long>>"
_PAIR = pa.struct([("v", pa.int64()), ("u", pa.int64()), ("to", pa.int32()), ("n", pa.int64())])
_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary()), ("tokens", pa.binary()), ("ids", pa.binary()), ("pairs", pa.list_(_PAIR))])


def _by_block(batches: Iterator[pa.RecordBatch], key: str, lazily: bool = False) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The rows of each value of a column, whose rows come together: as a list, or one batch after another."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            column = batch.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
            for s, e in zip(cuts, cuts[1:]):
                if s < e:
                    yield int(column[s]), batch.slice(s, e - s)

    for at, group in groupby(pieces(), key=lambda x: x[0]):
        yield at, ((x[1] for x in group) if lazily else [x[1] for x in group])


def _send(counts, shards: int):
    """Rows come by block: the ids of its words, and the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        for at, parts in _by_block(batches, "block"):
            t = pa.Table.from_batches(parts)
            known_words = pa.concat_tables([_IDS.empty_table(), *(_table(data.as_buffer()) for data in t["ids"].drop_null())])
            place, ids = (known_words[c].to_numpy() for c in ("at", "id"))
            (row,) = t.filter(pa.compute.is_valid(t["docs"])).select(["docs", "tokens"]).to_pylist()
            (tokens,) = from_bytes(row["tokens"], 1)
            every = np.unique(np.append(ids, [UNKNOWN, BEGIN, END]))
            local = np.zeros(int(tokens.max(initial=-1)) + 1, np.int64)
            local[place] = np.searchsorted(every, ids)
            block = Block(*_docs_from_bytes(row["docs"]), local[tokens], every)
            _, _, (v, u, w, n), shard = block.grams(known, shards)
            bounds = np.flatnonzero(np.diff(shard, prepend=-1))
            for s, e in zip(bounds, np.append(bounds[1:], len(shard))):
                one = [[int(shard[s])], [at], [to_bytes(*_steps_of(v[s:e], u[s:e]), w[s:e], n[s:e])], *[[None]] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, _SENT)], schema=_SENT)
            split = np.flatnonzero(known.splits(v) > 1)
            _, first, of = np.unique(packed(shard[split], v[split], u[split]), return_index=True, return_inverse=True)
            places = split[first]
            columns = v[places], u[places], shard[places], np.bincount(of, n[split], len(first)).astype(np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIR)], fields=list(_PAIR))
            one = [[-1], [at], [None], [row["docs"]], [to_bytes(local[tokens])], [to_bytes(np.diff(every, prepend=0))]]
            arrays = [pa.array(c, f.type) for c, f in zip(one, _SENT)] + [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SENT)

    return run


def shard_trie(counts: Counts, sent: list[bytes], whole_pairs: tuple, prior: tuple[float, float] = PRIOR) -> tuple[Trie, tuple, np.ndarray]:
    """The trie of a shard, the distinct n-grams that blocks sent, and for each one of a block, in their order, its number among these.

    ``whole_pairs``: the pairs of words that are split over shards (last word, the one before, count over all shards).
    """
    parts = []
    for data in sent:
        dv, du, w, n = from_bytes(data, 4)
        # Ids fit 32 bits as a rule; what is held of a shard is then half as large.
        parts.append([c.astype(np.int32) if c.max(initial=0) < 1 << 31 else c for c in (*_pairs_of(dv, du), w, n)])
    v, u, w, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
    del parts
    keys, first, of = np.unique(packed(v, u, w), return_index=True, return_inverse=True)
    n = np.bincount(of, n, len(keys)).astype(np.int64)
    v, u, w, of = v[first].astype(np.int64), u[first].astype(np.int64), w[first].astype(np.int64), of.astype(np.int32)
    del keys, first
    real = n > 0
    grams = v[real], u[real], w[real], n[real]
    own = counts.splits(grams[0]) == 1
    pv, pu, pn = (np.append(c[own], more) for c, more in zip((grams[0], grams[1], grams[3]), whole_pairs))
    keys, first, at = np.unique(packed(pv, pu), return_index=True, return_inverse=True)
    pairs = pv[first], pu[first], np.bincount(at, pn, len(keys)).astype(np.int64)
    return Trie.build(counts, grams, pairs, prior), (v, u, w), of


def _answer(counts, prior):
    """Rows come by shard; each block's n-grams are answered in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_block(batches, "shard"):
            t = pa.Table.from_batches(parts)
            sent = t.filter(pa.compute.is_valid(t["grams"]))
            grams = sent["grams"].to_pylist()
            trie, (v, u, w), of = shard_trie(counts.value, grams, tuple(t[c].drop_null().to_numpy() for c in "vun"), prior)
            found = trie.saved().ask(v, u, w)[of]
            at = 0
            for block, data in zip(sent["block"].to_pylist(), grams):
                n = int(np.frombuffer(data, np.int64, 1)[0])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([to_bytes(found[at : at + n])], pa.binary())], names=["shard", "block", "codes"])
                at += n

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(counts, shards: int):
    """Rows come by block: the block, then the answers of its shards."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        for _, parts in _by_block(batches, "block"):
            rows = pa.Table.from_batches(parts).to_pylist()
            (row,) = [r for r in rows if r["shard"] < 0]
            ids = np.cumsum(from_bytes(row["ids"], 1)[0])
            block = Block(*_docs_from_bytes(row["docs"]), from_bytes(row["tokens"], 1)[0], ids)
            asked, place, _, _ = block.grams(known, shards)
            codes = np.concatenate([np.zeros(0, np.int64), *(from_bytes(r["codes"], 1)[0] for r in sorted((r for r in rows if r["shard"] >= 0), key=lambda r: r["shard"]))])
            share = np.log10(known.share(ids))[block.w]
            score = share.copy()
            code = codes[place]
            score[asked] = np.where(code & 1, share[asked], 0.0) - (code >> 1) / STEPS
            first = np.append(0, block.ends[:-1])
            n = len(block.docs)
            columns = [
                pa.array(block.docs, pa.int64()),
                pa.array(block.held),
                pa.array(np.diff(block.ends, prepend=0)),
                pa.array(np.add.reduceat((known.of(ids) > 0)[block.w].astype(np.int64), first)),
                pa.array(np.full(n, known.tokens)),
                pa.array(np.add.reduceat(share, first)),
                pa.array(np.add.reduceat(score, first)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score_documents(docs: DataFrame, *, prior: tuple[float, float] = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT`` of every row of ``docs``: log10 probabilities of its text by the model, and by shares of single words.

    The model learns from the rows whose crc32 of the id as text leaves a remainder but 0 by
    ten; a null id counts as an empty text there and so is held out. Words lie between white
    space, A to Z lower-cased; each text has an end as its last token, so null and empty texts
    are an end alone. Repeated rows count, and are scored, each. Without a row to learn from all
    scores are 0. Further columns are not read; an empty table gives no rows.
    """
    held = (unsigned_crc32(F.col(id_col).cast("string")) % FOLDS == 0).alias("held")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).cast("string").cast("binary").alias("text"))
    parts = min(PARTS, 4 * source.rdd.getNumPartitions())
    cut = stash(source.mapInArrow(_cut(parts), CUT), "cut")
    words, blocks = cut.where("part is not null").select("part", "block", "words"), cut.where("part is null")
    vocabulary = words.select("part", "words").repartition("part").sortWithinPartitions("part").mapInArrow(_count, "word binary, c long")
    known = numbered(vocabulary, F.desc("c"), F.col("word"), name="id")
    ids = known.select("word", "c", (F.col("id") - 1 + FIRST_WORD).alias("id"))
    steps = [(r.c, r.n) for r in ids.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()]  # at most the root of twice the tokens
    total, trained = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    counts = docs.sparkSession.sparkContext.broadcast(Counts(steps, trained))
    shards = max(1, -(-total // SHARD_TOKENS))
    asked = ids.select(F.pmod(F.crc32("word"), F.lit(parts)).cast("int").alias("part"), "word", "id").unionByName(words, allowMissingColumns=True)
    # Of a part the vocabulary comes first, as it belongs to no block.
    placed = asked.repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first()).mapInArrow(_place, PLACED)
    both = placed.unionByName(blocks.select("block", "docs", "tokens"), allowMissingColumns=True).repartition("block").sortWithinPartitions("block")
    sent = stash(both.mapInArrow(_send(counts, shards), SENT), "sent")
    unstash(cut, known)
    asked = sent.where("shard >= 0").select("shard", "block", "grams")
    # What follows a split word lies in several shards: the pairs' counts are added up and go to the shards that ask for them.
    pairs = sent.where("shard < 0").select(F.inline("pairs"))
    totals = pairs.groupBy("v", "u").agg(F.sum("n").alias("n")).where("n > 0")
    needed = pairs.select(F.col("to").alias("shard"), "v", "u").distinct().join(totals, ["v", "u"])
    asked = asked.unionByName(needed, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "block")
    codes = stash(asked.mapInArrow(_answer(counts, prior), "shard int, block long, codes binary"), "codes")
    every = sent.where("shard < 0").select("shard", "block", "docs", "tokens", "ids").unionByName(codes, allowMissingColumns=True)
    out = stash(every.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_score(counts, shards), RESULT), "scores")
    unstash(sent, codes)
    return out
