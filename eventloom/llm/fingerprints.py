"""Document fingerprints from prefix polynomial hashes.

A text of code points c has the prefix array S[i] = sum of c[j] B^j over j < i, modulo
two primes below 2^31. Any two spans are compared in constant time by their differences
of S, shifted to a common power of B, and the longest common extension of two positions
is found by binary search over spans.

A fingerprint keeps the prefix array in two ways. At anchors, positions that the text itself
chooses: where the hash of the next ``WINDOW`` code points is small enough that there are
at most ``ANCHORS`` of them. So equal passages have the same anchors wherever they stand. Of
two fingerprints, an anchor and the next one make a span; where a span of the one equals one of
the other, a binary search over the anchors finds how far the texts go on alike.
And at positions that are multiples of a power of two, from the start and (of the reversed text) from
the end, at most ``SAMPLES`` of each, as texts that repeat themselves may have no anchors:
cells of this grid that agree in place are counted. The better count is the likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, stash

PRIMES = np.array([2147483647, 2147483629], np.uint64)
BASES = np.array([911382323, 972663749], np.uint64)
BLOCK = 1 << 15
SAMPLES = 32
ANCHORS, WINDOW = 64, 16
#: Documents go to ranges of about so many, and to at most so many ranges.
TASK_ROWS, MAX_TASKS = 2_000, 1 << 16

_powers: list[np.ndarray] = []
_inverses: list[np.ndarray] = []


def _power_table(kept: list[np.ndarray] = _powers, sign: int = 1) -> list[np.ndarray]:
    """B^0 .. B^(BLOCK-1) for each prime, by doubling; or their inverses."""
    if not kept:
        for p, b in zip(PRIMES, BASES):
            out = np.ones(1, np.uint64)
            step = np.uint64(pow(int(b), sign, int(p)))
            while len(out) < BLOCK:
                out = np.concatenate([out, out * step % p])
                step = step * step % p
            kept.append(out)
    return kept


def _inverse_powers(k: int, at: np.ndarray) -> np.ndarray:
    """B^-i modulo prime k for each position i."""
    table, prime = _power_table(_inverses, -1)[k], PRIMES[k]
    high = at // BLOCK
    lifts = np.array([power(pow(int(BASES[k]), -1, int(prime)), x * BLOCK, prime) for x in range(int(high.max(initial=0)) + 1)], np.uint64)
    return table[at % BLOCK] * lifts[high] % prime


def power(base: int, n: int, prime: int) -> int:
    return pow(int(base), int(n), int(prime))


def points_of(text: str) -> np.ndarray:
    """The code points, each plus one, so that none is 0."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def prefix_arrays(points: np.ndarray) -> np.ndarray:
    """Row k: S[0..n] modulo prime k."""
    out = np.zeros((2, len(points) + 1), np.uint64)
    for k, (prime, table) in enumerate(zip(PRIMES, _power_table())):
        for start in range(0, len(points), BLOCK):
            part = points[start : start + BLOCK]
            sums = np.cumsum(part * table[: len(part)] % prime)  # under BLOCK * 2^31
            lift = np.uint64(power(BASES[k], start, prime))
            out[k, start + 1 : start + 1 + len(part)] = (out[k, start] + sums % prime * lift) % prime
    return out


def spans_equal(a: np.ndarray, i: int, b: np.ndarray, j: int, length: int) -> bool:
    """Whether ``length`` code points from i and from j agree, by the prefix arrays of both texts."""
    if i < 0 or j < 0 or i + length > a.shape[1] - 1 or j + length > b.shape[1] - 1:
        return False
    for k, prime in enumerate(map(int, PRIMES)):
        x = (int(a[k, i + length]) - int(a[k, i])) % prime * power(BASES[k], max(0, j - i), prime) % prime
        y = (int(b[k, j + length]) - int(b[k, j])) % prime * power(BASES[k], max(0, i - j), prime) % prime
        if x != y:
            return False
    return True


def longest_common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many code points from i and from j agree, by binary search."""
    low, high = 0, min(a.shape[1] - 1 - i, b.shape[1] - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def window_hashes(points: np.ndarray) -> np.ndarray:
    """64 mixed bits of the ``WINDOW`` code points from each position on, by doubling."""
    out, width = points, 1
    while width < WINDOW:
        out = (out[:-width] if width < len(out) else out[:0]) * np.uint64(0x9E3779B97F4A7C15 + 4 * width) + out[width:] * np.uint64(0xD6E8FEB86659FD93)
        out = out ^ (out >> np.uint64(29))
        width *= 2
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _anchors(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions that the text chooses, how many zero bits the hash of the window there begins with, and with how many it is chosen."""
    m = len(mixed)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    zeros = max(0, m.bit_length() - ANCHORS.bit_length() - 1)
    at = np.flatnonzero(mixed < np.uint64(1 << (64 - zeros))) if zeros else np.arange(m)
    level = 64 - np.frexp(mixed[at].astype(float))[1]
    while len(at) > ANCHORS:
        zeros += 1
        at, level = at[level >= zeros], level[level >= zeros]
    return at, level, zeros


class Print:
    """Length, the sampled prefix hashes of the grid from the start and from the end, and the anchors with theirs."""

    __slots__ = ("n", "shift", "head", "tail", "zeros", "at", "level", "sums", "spans")

    def __init__(self, points: np.ndarray, head: np.ndarray | None = None, windows: np.ndarray | None = None):
        self.n = len(points)
        self.shift = max(0, (max(1, self.n) - 1).bit_length() - (SAMPLES.bit_length() - 1))
        grid = np.append(np.arange(1 << self.shift, self.n, 1 << self.shift), self.n) if self.n else np.zeros(0, np.int64)
        arrays = prefix_arrays(points) if head is None else head
        self.head = self._sampled(arrays, grid)
        self.tail = self._sampled(prefix_arrays(points[::-1]), grid)
        self.at, self.level, self.zeros = _anchors(window_hashes(points) if windows is None else windows)
        self.sums = arrays[:, self.at]
        self.spans: dict[int, Spans] = {}

    @staticmethod
    def _sampled(arrays: np.ndarray, grid: np.ndarray) -> list[int]:
        return ((arrays[0, grid] << np.uint64(31)) | arrays[1, grid]).tolist()

    def text(self) -> str:
        anchors = "".join(f"{i:08x}{z:02x}{x:016x}" for i, z, x in zip(self.at.tolist(), self.level.tolist(), ((self.sums[0] << np.uint64(31)) | self.sums[1]).tolist()))
        return ":".join([str(self.n), str(self.shift), str(self.zeros), *("".join(f"{x:016x}" for x in part) for part in (self.head, self.tail)), anchors])

    @classmethod
    def read(cls, text: str) -> Print:
        n, shift, zeros, head, tail, anchors = text.split(":")
        out = cls.__new__(cls)
        out.n, out.shift, out.zeros = int(n), int(shift), int(zeros)
        out.head, out.tail = ([int(x[i : i + 16], 16) for i in range(0, len(x), 16)] for x in (head, tail))
        found = [anchors[i : i + 26] for i in range(0, len(anchors), 26)]
        out.at, out.level = (np.array([int(x[a:b], 16) for x in found], np.int64) for a, b in ((0, 8), (8, 10)))
        sums = np.array([int(x[10:], 16) for x in found], np.uint64)
        out.sums = np.stack([sums >> np.uint64(31), sums & np.uint64((1 << 31) - 1)])
        out.spans = {}
        return out


class Spans:
    """The spans between anchors of at least a level, and the text's ends: any run of them is compared by prefix hashes."""

    def __init__(self, p: Print, level: int):
        keep = p.level >= level
        inner = p.at[keep] > 0
        whole = p.head[-1] if p.head else 0
        self.at = [0, *p.at[keep][inner].tolist(), p.n]
        sums = [np.concatenate([[0], part[keep][inner], [end]]).astype(np.uint64) for part, end in zip(p.sums, (whole >> 31, whole & ((1 << 31) - 1)))]
        at = np.array(self.at)
        back = [_inverse_powers(k, at) for k in range(2)]
        each = ((x[1:] + p - x[:-1]) % p * y[:-1] % p for x, y, p in zip(sums, back, PRIMES))
        #: Of each span from one boundary to the next.
        self.hashes = list(zip(np.diff(at).tolist(), *(x.tolist() for x in each)))
        self.back, self.sums = [x.tolist() for x in back], [x.tolist() for x in sums]

    def hash(self, x: int, y: int) -> tuple[int, int, int]:
        """Of the span from boundary x to boundary y, wherever it stands: its length and both hashes."""
        first, second = ((self.sums[k][y] - self.sums[k][x]) * self.back[k][x] % int(PRIMES[k]) for k in range(2))
        return self.at[y] - self.at[x], first, second


def _alike(p: Print, q: Print) -> int:
    """Code points in spans of the one that follow each other in the same order in the other."""
    level = max(p.zeros, q.zeros)
    for t in (p, q):
        if level not in t.spans:
            t.spans[level] = Spans(t, level)
    a, b = p.spans[level], q.spans[level]
    places: dict[tuple, list[int]] = {}
    for y, h in enumerate(b.hashes):
        places.setdefault(h, []).append(y)
    found = x = y = 0
    while x < len(a.at) - 1:
        start = next((z for z in places.get(a.hashes[x], ()) if z >= y), None)
        if start is None or a.at[x + 1] == a.at[x]:
            x += 1
            continue
        # How far both go on alike, by binary search.
        low, high = 1, min(len(a.at) - 1 - x, len(b.at) - 1 - start)
        while low < high:
            middle = (low + high + 1) // 2
            if a.hash(x, x + middle) == b.hash(start, start + middle):
                low = middle
            else:
                high = middle - 1
        found += a.at[x + low] - a.at[x]
        x, y = x + low, start + low
    return found


def _at(samples: list[int], step: int, cells: int) -> np.ndarray:
    """Row k: the prefix hashes modulo prime k before each cell of the coarser grid and behind the last."""
    # The last sample is the whole text, wherever the grid ends.
    found = np.array([0, *(samples[min(i * step, len(samples)) - 1] for i in range(1, cells + 1))], np.uint64)
    return np.stack([found >> np.uint64(31), found & np.uint64((1 << 31) - 1)])


def _agree(a: list[int], b: list[int], p: Print, q: Print) -> list[tuple[int, int]]:
    """Spans that agree in place from one end, by cells of the coarser grid."""
    shift = max(p.shift, q.shift)
    # Texts of one length have an equal last cell, however short.
    cells = -(-p.n // (1 << shift)) if p.n == q.n else min(p.n, q.n) >> shift
    x, y = _at(a, 1 << (shift - p.shift), cells), _at(b, 1 << (shift - q.shift), cells)
    # Both stand at the same power of B; adding the prime keeps the differences positive.
    same = ((x[:, 1:] + PRIMES[:, None] - x[:, :-1]) % PRIMES[:, None] == (y[:, 1:] + PRIMES[:, None] - y[:, :-1]) % PRIMES[:, None]).all(axis=0)
    return [(i << shift, min((i + 1) << shift, p.n, q.n)) for i in np.flatnonzero(same).tolist()]


def _covered(spans: list[tuple[int, int]]) -> int:
    out = at = 0
    for start, end in sorted(spans):
        out += max(0, end - max(at, start))
        at = max(at, end)
    return out


def likeness(p: Print, q: Print) -> float:
    """Share of the longer text in spans that agree with the other, between anchors or in place from the start or the end; 1 for equal texts."""
    if p.n == q.n and p.head[-1:] == q.head[-1:]:
        return 1.0
    if not min(p.n, q.n):
        return 0.0
    head, tail = _agree(p.head, q.head, p, q), _agree(p.tail, q.tail, p, q)
    # What is covered in the one and in the other, as a span may meet two of the other.
    in_place = min(_covered(head + [(t.n - e, t.n - s) for s, e in tail]) for t in (p, q))
    return max(in_place, _alike(p, q)) / max(p.n, q.n)


PRINTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("edited_from", T.LongType()),
        T.StructField("next_from", T.LongType()),
    ]
)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and order; each meets the next one. A bucket's last row is the first of the next bucket."""
    before = None  # bucket, doc_id, text, points, print, prefix arrays, hashes of windows
    for batch in chunks(batches):
        out = []
        for bucket, last, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            points = points_of(text)
            arrays = prefix_arrays(points)
            windows = window_hashes(points)
            own = Print(points, arrays, windows)
            if before is not None and before[0] == bucket:
                _, id_, text_, points_, print_, arrays_, windows_ = before
                n = len(text_)
                taken = text[: n // 4]
                kept = n - n // 4
                edited = text_[:kept] + taken
                # The prefix array of the edited text goes on from the kept part's.
                more = prefix_arrays(points[: len(taken)])
                edited_arrays = np.concatenate([arrays_[:, : kept + 1], np.zeros((2, len(taken)), np.uint64)], axis=1)
                for k, prime in enumerate(PRIMES):
                    lift = np.uint64(power(BASES[k], kept, prime))
                    edited_arrays[k, kept + 1 :] = (edited_arrays[k, kept] + more[k, 1:] * lift) % prime
                edited_points = np.concatenate([points_[:kept], points[: len(taken)]])
                # Windows within either part are known; those over the seam are not.
                left, right = max(0, kept - WINDOW + 1), max(0, len(taken) - WINDOW + 1)
                seam = window_hashes(edited_points[left : kept + WINDOW - 1])
                edited_print = Print(edited_points, edited_arrays, np.concatenate([windows_[:left], seam, windows[:right]]))
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                # Where the text and the other first differ.
                froms = (longest_common_extension(arrays_, 0, other, 0) for other in (edited_arrays, arrays))
                out.append((id_, n, digest, print_.text(), edited_print.text(), likeness(print_, edited_print), likeness(print_, own), *froms))
            before = None if last else (bucket, doc_id, text, points, own, arrays, windows)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=PRINTS.names)


#: Null ids are before all others.
NO_ID = -(1 << 63)
#: Rows with one id are ordered by so many bits of their text's digest, then by text.
TIE = 1 << 32


def _bucket(bounds: list[tuple[int, int]]):
    """The number of bounds up to a row's (key, tie), by a binary search of so many steps as needed."""
    if not bounds:
        return F.lit(0)
    # A literal of at most MAX_TASKS pairs of numbers.
    keys, ties = (F.lit([int(x[k]) for x in bounds]).cast("array<bigint>") for k in (0, 1))
    steps = len(bounds).bit_length()
    middle = lambda acc: ((acc["low"] + acc["high"]) / 2).cast("int")
    up_to = lambda m: (F.get(keys, m) < F.col("key")) | ((F.get(keys, m) == F.col("key")) & (F.get(ties, m) <= F.col("tie")))
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")),
        lambda acc, _: F.when(acc["low"] < acc["high"], F.when(up_to(middle(acc)), F.struct((middle(acc) + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), middle(acc).alias("high")))).otherwise(acc),
    )
    return found["low"]


def _bounds(source: DataFrame) -> list[tuple[int, int]]:
    """Where ranges begin, but for the first: quantiles of the keys, and parts of keys that more rows than a task's share."""
    rows = source.count()
    tasks = min(MAX_TASKS, max(1, -(-rows // TASK_ROWS)))
    if tasks == 1:
        return []
    share = -(-rows // tasks)
    shares = [i / tasks for i in range(1, tasks)]
    found = source.agg(F.percentile_approx("key", shares, max(10_000, 4 * tasks)).alias("q")).first().q or []
    # At most as many keys as tasks.
    large = source.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).collect()
    parts = [(r.key, TIE * j // -(-r.n // share)) for r in large for j in range(-(-r.n // share))]
    return sorted({*((k, 0) for k in found), *parts, *((r.key + 1, 0) for r in large)})


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document (``PRINTS``): its fingerprint, its edited text's, their likeness, and where it first differs from the edited and the next text.

    The edited text has its last quarter replaced by the start of the next document's text
    in the order of ids; the last document's next is the first. Null texts are empty. Null
    ids come first; rows with one id follow each other in a fixed order of their texts. A single document is its
    own next. Further columns are not read; an empty table gives no rows.

    Documents are dealt by ranges of ids and sorted within; an id, or none, that many rows share has
    several ranges. Each range also gets the first document of the following one, so no
    order over all rows is needed in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key, tie = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), key.alias("key"), tie.alias("tie"))
    placed = source.withColumn("bucket", _bucket(_bounds(source)))
    firsts = stash(placed.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first")).select("bucket", "first.key", "first.tie"), "firsts")
    begun = [r.bucket for r in firsts.select("bucket").orderBy("bucket").collect()]  # some times MAX_TASKS numbers at most
    if not begun:
        return docs.sparkSession.createDataFrame([], PRINTS)
    pairs = docs.sparkSession.createDataFrame([(b, begun[i - 1]) for i, b in enumerate(begun)], "bucket int, before int")
    # One document a range.
    heads = firsts.join(F.broadcast(pairs), "bucket").select("key", "tie", F.col("before").alias("head_before"))
    added = source.join(F.broadcast(heads), ["key", "tie"]).groupBy("head_before", "doc_id", "key", "tie").agg(F.min("text").alias("text"))
    added = added.select(F.col("head_before").alias("bucket"), F.lit(True).alias("last"), "doc_id", "text", "key", "tie")
    every = placed.select("bucket", F.lit(False).alias("last"), "doc_id", "text", "key", "tie").unionByName(added)
    # "bucket" first: a task may hold several ranges.
    dealt = every.repartition(max(1, len(begun)), "bucket").sortWithinPartitions("bucket", "last", "key", "tie", "text").select("bucket", "last", "doc_id", "text")
    return dealt.mapInArrow(_in_order, PRINTS)


def digest(prints: DataFrame) -> DataFrame:
    return prints.select(*PRINTS.names)
