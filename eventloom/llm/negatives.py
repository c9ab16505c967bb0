"""Hard negatives by exact whole-number scores, from matrix products over residues.

Components become whole numbers, a score is their inner product. A block of anchors is
multiplied with blocks of rows once for each of a few primes below 1,024: residues are at
most 511 in size, so sums over 64 columns are whole numbers below 2^24, which float32 holds
exactly. Chinese remaindering makes the signed scores of the residues; there are as many
primes as the largest possible score needs.

Anchors and rows are dealt over a grid of blocks. A task holds one block of anchors, reads
the rows of its block one piece after another, and keeps the best few of each anchor: first
its positives, then, in a second pass, the rows within the window of each positive. What
comes out is a few rows an anchor and block, never a pair of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash, unstash
from .whitening import finite

SCALE, ANCHOR_EVERY, MOVED_EVERY, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from 50 to 95 hundredths of the positive's.
LEAST, MOST = 50, 95
#: Columns of float32 products at once.
DEPTH = 64
#: Anchors of a block; rows of a block at most, and at least if there are cores for more blocks.
ANCHORS, ROWS, FEW_ROWS = 8192, 65_536, 4096
#: Anchors and rows of one product.
TILE_ANCHORS, TILE_ROWS = 512, 4096
#: Stands for no row; scores are larger.
NONE = -(1 << 62)


def _primes(below: int, n: int) -> list[int]:
    return [p for p in range(below, 2, -1) if all(p % q for q in range(2, math.isqrt(p) + 1))][:n]


#: The largest primes below 1,024, as many as fit 64 bits together.
PRIMES = _primes(1023, 6)


def primes_for(bound: int) -> list[int]:
    """As many primes as tell all whole numbers from -bound to bound apart."""
    for n in range(1, len(PRIMES) + 1):
        if math.prod(PRIMES[:n]) > 2 * bound:
            return PRIMES[:n]
    raise ValueError("components are too large: scores would not fit 64 bits")


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime as float32, of the least size."""
    out = []
    for p in primes:
        r = x % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def product(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact scores of the rows of two matrices given by their residues."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        r = np.zeros((len(a[k]), len(b[k])), np.int64)
        for at in range(0, a[k].shape[1], DEPTH):
            r += (a[k][:, at : at + DEPTH] @ b[k][:, at : at + DEPTH].T).astype(np.int64)
        # Mixed radix: what the primes before have not told yet.
        for q, digit in zip(primes, digits):
            r = (r - digit) % p * pow(q, -1, p)
        digits.append(r % p)
    value = digits[-1]
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        value = value * p + digit
    whole = math.prod(primes)
    return np.where(value > whole // 2, value - whole, value)


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest allowed scores of each row and their ids; of equal scores the first columns."""
    left = np.where(allowed, scores, NONE)
    top, who = np.full((len(left), k), NONE), np.zeros((len(left), k), np.int64)
    every = np.arange(len(left))
    for j in range(k):
        at = left.argmax(axis=1)
        top[:, j], who[:, j] = left[every, at], ids[at]
        left[every, at] = NONE
    return top, who


def _merged(old, new, k: int):
    """The better k of two lists; the older ones have the smaller ids, so they come first among equals."""
    top, who = (np.concatenate([x, y], axis=1) for x, y in zip(old, new))
    order = np.argsort(-top, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(top, order, 1), np.take_along_axis(who, order, 1)


class _Anchors:
    """A block of anchors and the best of the rows seen so far."""

    def __init__(self, ids, labels, x, positives, primes: list[int]):
        self.ids, self.labels, self.primes = ids, labels, primes
        self.tiles = [(slice(s, s + TILE_ANCHORS), residues(x[s : s + TILE_ANCHORS], primes)) for s in range(0, len(ids), TILE_ANCHORS)]
        self.positives, self.k = positives, POSITIVES if positives is None else NEGATIVES
        wide = (len(ids),) if positives is None else (len(ids), POSITIVES)
        self.top, self.who = np.full((*wide, self.k), NONE), np.zeros((*wide, self.k), np.int64)

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        rows = residues(x, self.primes)
        for part, tile in self.tiles:
            scores = product(tile, rows, self.primes)
            same = self.labels[part, None] == labels[None]
            if self.positives is None:
                new = _best(scores, ids, same & (self.ids[part, None] != ids[None]), self.k)
                self.top[part], self.who[part] = _merged((self.top[part], self.who[part]), new, self.k)
                continue
            held = self.positives[1][part]
            for j in range(POSITIVES):
                p = held[:, j, None]
                fits = ~same & (p != NONE) & (LEAST * p <= 100 * scores) & (100 * scores <= MOST * p)
                some = fits.any(axis=1)
                if some.any():
                    at = np.arange(len(self.ids))[part][some]
                    new = _best(scores[some], ids, fits[some], self.k)
                    self.top[at, j], self.who[at, j] = _merged((self.top[at, j], self.who[at, j]), new, self.k)

    def found(self) -> pa.RecordBatch:
        at = np.nonzero(self.top != NONE)
        columns = [self.ids[at[0]], *([] if self.positives is None else [p[at[0], at[1]] for p in self.positives]), self.who[at], self.top[at]]
        names = ["anchor_id", *([] if self.positives is None else ["positive_id", "positive_score"]), "other_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    widths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size), np.int64)
    out[np.arange(size)[None] < widths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _mine(size: int, primes: list[int]):
    """Rows come by block of the grid, its anchors first, each side by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, anchors = None, [], None

        def anchors_of(parts: list[pa.RecordBatch]) -> _Anchors:
            (t,) = pa.Table.from_batches(parts).combine_chunks().to_batches()
            ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
            positives = None
            if "positives" in t.schema.names:
                pos = np.full((2, len(ids), POSITIVES), NONE)
                for n, found in enumerate(t.column("positives").to_pylist()):
                    for j, p in enumerate(found or []):
                        pos[:, n, j] = p["other_id"], p["score"]
                positives = pos[0], pos[1]
            return _Anchors(ids, labels, _matrix(t.column("x"), size), positives, primes)

        for whole in batches:
            i, j, side = (whole.column(c).to_numpy() for c in ("i", "j", "side"))
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1).tolist(), whole.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if (at := (int(i[start]), int(j[start]))) != key:
                    if anchors is not None:
                        yield anchors.found()
                    key, held, anchors = at, [], None
                if not side[start]:
                    held.append(whole.slice(start, end - start))
                elif held:
                    anchors = anchors or anchors_of(held)
                    for s in range(start, end, TILE_ROWS):
                        part = whole.slice(s, min(TILE_ROWS, end - s))
                        ids, labels = (part.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
                        anchors.meet(ids, labels, _matrix(part.column("x"), size))
        if anchors is not None:
            yield anchors.found()

    return run


def _grid(anchors: DataFrame, rows: DataFrame, down: int, across: int) -> DataFrame:
    """Anchors and rows dealt over the blocks of the grid: an anchor to every block of its row, a row to every block of its column."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    more = [c for c in anchors.columns if c not in rows.columns]
    a = anchors.withColumn("i", one(down)).withColumn("j", every(across)).withColumn("side", F.lit(0))
    b = rows.withColumn("j", one(across)).withColumn("i", every(down)).withColumn("side", F.lit(1))
    for c in more:
        b = b.withColumn(c, F.lit(None).cast(anchors.schema[c].dataType))
    return a.unionByName(b).repartition("i", "j").sortWithinPartitions("i", "j", "side", "id")


def mine(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: up to three negatives of each anchor and positive.

    Anchors are the rows whose id is divisible by 50; a label of an id divisible by 7 is moved
    by one first. Rows without an id, a label or a vector, or with a null or non-finite
    component, take no part; of rows that share an id the one with the least label, then
    vector, does. A shorter vector counts zeros beyond its end. Equal scores, as of repeated
    vectors, go by the smaller id. Components whose scores could pass 59 bits are an error.
    Further columns are not read; an empty table gives no rows.
    """
    moved = F.when(F.col("id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    source = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    whole = source.select("id", moved.alias("label"), F.transform(F.col("v").cast("array<double>"), lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long")).alias("x"))
    rows = stash(whole.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x"), "rows")
    anchors = rows.where(F.col("id") % ANCHOR_EVERY == 0)
    largest = lambda f: F.coalesce(F.max(f(F.transform("x", lambda c: F.abs(c)))), F.lit(0))
    n, size, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), largest(F.array_max)).first()
    m = anchors.count()
    schema = "anchor_id long, other_id long, score long"
    primes = primes_for(max(1, size) * most * most)
    down = max(1, -(-m // ANCHORS))
    cores = embeddings.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-n // ROWS), min(-(-n // FEW_ROWS), -(-cores // down)))

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    met = _grid(anchors, rows, down, across).mapInArrow(_mine(size, primes), schema)
    best = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= POSITIVES)
    positives = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("other_id", "score")).alias("positives"))  # five at most
    ready = stash(anchors.join(positives, "id"), "anchors")

    schema = "anchor_id long, positive_id long, positive_score long, other_id long, score long"
    met = _grid(ready, rows, down, across).mapInArrow(_mine(size, primes), schema)
    each = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    found = met.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= NEGATIVES)
    out = stash(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    unstash(rows, ready)
    return out


ORACLE_SQL = f"""
WITH source AS (
    SELECT vec_id AS id, label::BIGINT AS label, embedding AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), whole AS (
    SELECT id, CASE WHEN id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
        list_transform(v, lambda c: floor({SCALE}.0::DOUBLE * c::DOUBLE)::BIGINT) AS x
    FROM source
), rows AS (
    SELECT id, label, x FROM whole QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, x) = 1
), scored AS (
    SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same,
        coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
    FROM rows a JOIN rows b ON a.id % {ANCHOR_EVERY} = 0 AND a.id <> b.id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND {LEAST} * p.positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
