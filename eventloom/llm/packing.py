"""Harmonic packing of token sequences.

Lengths fall into reciprocal classes: class j takes lengths in (C/(j+1), C/j], and j
pieces of class j always fit into one sequence of capacity C. A sequence of class j is
closed at its j-th piece, so every worker fills its own sequences from what it reads,
without knowing about the others. What no worker could close is dealt once more, by
class, over groups of workers, until one last set of less than one sequence a class
remains.

Documents are cut so that classes fit well: whole runs of C, then the powers of two
down to ``min_cut`` that make up the rest (they fill their classes exactly), then one
tail shorter than ``min_cut``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import vocabulary
from .common import chunks, stash

CAPACITY = 1024
MIN_CUT = 64
#: Workers whose open sequences meet in one group when they are dealt again.
FAN_IN = 64

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("class", T.IntegerType()),
        T.StructField("worker", T.IntegerType()),
        T.StructField("bin", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def cuts(n: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT) -> list[int]:
    """Piece lengths of a document of n tokens, longest first; they add up to n."""
    out, rest = [capacity] * (n // capacity), n % capacity
    size = 1 << (capacity.bit_length() - 1)
    while size >= min_cut and rest:
        if rest >= size:
            out.append(size)
            rest -= size
        size >>= 1
    return out + [rest] * (rest > 0)


def _cut_and_fill(file: str, capacity: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab = vocabulary.load(vocabulary.ByteLevelVocabulary, file)
        worker = TaskContext.get().partitionId()
        still_open: dict[int, list] = {}  # class: pieces of its open sequence, fewer than the class's count
        filled: dict[int, int] = {}
        end = np.zeros(1, "<u4").tobytes()

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(PIECES)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=PIECES.names)

        for batch in chunks(batches, 256):
            doc_ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, packed in zip(doc_ids, vocab.packed([t or "" for t in batch.column(1).to_pylist()])):
                packed += end
                n, start = len(packed) // 4, 0
                for length in cuts(n, capacity, min_cut):
                    j = capacity // length
                    group = still_open.setdefault(j, [])
                    group.append([doc_id, start, length, packed[4 * start : 4 * (start + length)], n, j, worker, None, 0])
                    start += length
                    if len(group) == j:
                        at, number = 0, filled.get(j, 0)
                        for row in group:
                            row[7], row[8] = number, at
                            at += row[2]
                        filled[j] = number + 1
                        rows += still_open.pop(j)
            if rows:
                yield batch_of(rows)
        left = [row for group in still_open.values() for row in group]
        if left:
            yield batch_of(left)

    return run


def _last(capacity: int):
    """Longest first into the open sequence, else into a new one; what comes here is under one sequence a class."""

    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        number, at, bins, offsets = 0, 0, [], []
        for length in pdf["length"]:
            if at + length > capacity:
                number, at = number + 1, 0
            bins.append(number)
            offsets.append(at)
            at += length
        pdf["bin"], pdf["offset"] = np.asarray(bins, "int64"), np.asarray(offsets, "int64")
        return pdf

    return run


def pack_documents(
    docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, min_cut: int = MIN_CUT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    A document's tokens are the ids of its text followed by one id 0, so an empty or null
    text is one token. Each token lies in exactly one piece. Returns doc_id, start, length,
    ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    Null ids are kept as null; repeated rows are packed once each; other columns of
    ``docs`` are not read; an empty table gives no rows. ``capacity`` is a power of two.
    """
    if capacity & (capacity - 1) or min_cut & (min_cut - 1):
        raise ValueError("capacity and min_cut are powers of two")
    file = tokenizer or vocabulary.path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stash(source.mapInArrow(_cut_and_fill(file, capacity, min_cut), PIECES), "pieces")
    level = F.lit(0)
    done = [pieces.where("bin is not null").withColumn("level", level)]
    left = pieces.where("bin is null")
    groups = (left.agg(F.max("worker")).first()[0] or 0) + 1
    for n in range(1, 8):
        groups = -(-groups // FAN_IN)
        # Few rows: under one sequence a class and worker. The order within a class is fixed by the rows themselves.
        w = Window.partitionBy("class", "worker").orderBy("doc_id", "start", "ids")
        whole = Window.partitionBy("class", "worker")
        left = left.withColumn("worker", (F.col("worker") / FAN_IN).cast("int"))
        left = (
            left.withColumn("rn", F.row_number().over(w) - 1)
            .withColumn("n", F.count(F.lit(1)).over(whole))
            .withColumn("bin", F.when(F.floor(F.col("rn") / F.col("class")) < F.floor(F.col("n") / F.col("class")), F.floor(F.col("rn") / F.col("class"))))
        )
        in_bin = Window.partitionBy("class", "worker", "bin").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
        left = left.withColumn("offset", F.when(F.col("bin").isNotNull(), F.coalesce(F.sum("length").over(in_bin), F.lit(0))).otherwise(0))
        left = stash(left.select(*PIECES.names), "open")
        done.append(left.where("bin is not null").withColumn("level", F.lit(n)))
        left = left.where("bin is null")
        if groups == 1:
            break
    # One group on purpose: what remains is less than one sequence a class, however large the input.
    last = left.withColumn("class", F.lit(0)).groupBy("class").applyInPandas(_last(capacity), PIECES)
    done.append(last.withColumn("level", F.lit(9)))
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    # level < 16, class <= capacity < 2^14, worker < 2^21, bin < 2^24 a worker and class
    sequence = (
        F.shiftleft(F.col("level").cast("long"), 59)
        .bitwiseOR(F.shiftleft(F.col("class").cast("long"), 45))
        .bitwiseOR(F.shiftleft(F.col("worker").cast("long"), 24))
        .bitwiseOR(F.col("bin"))
    )
    return placed.select("doc_id", "start", "length", "ids", "doc_tokens", sequence.alias("sequence_id"), "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row a sequence: its pieces in order and its ids as one binary (padding is left to the reader)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return (
        pieces.groupBy("sequence_id")
        .agg(parts.alias("parts"), F.sum("length").alias("length"))
        .withColumn("ids", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))"))
        .withColumn("parts", F.expr("transform(parts, p -> struct(p.offset, p.doc_id, p.start, p.length))"))
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
