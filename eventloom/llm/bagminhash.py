"""Near-duplicate detection by BagMinHash signatures, banding and exact verification.

A document is the multiset of its five-word shingles. Each shingle carries a Poisson
process over (time, weight): a point at time x and weight y, with one of the signature's
positions, belongs to the document if y is at most the shingle's weight there. A position
keeps the first time of its points, so two documents agree at a position with exactly
their weighted Jaccard similarity as the probability.

Weights are discretised to whole numbers, and the weight axis is laid out as the blocks
(0,1], (1,2], (2,4], (4,8], ...: whole blocks below a weight count as they are, and the
block that holds it is halved level by level, each half going on as a process of its own
that follows from the shingle and the half alone. So a shingle costs in the order of the
logarithm of its weight, and points later than all positions' times are never drawn.

Bands of the signature meet by hash, and every pair that shares a band is verified exactly
on the multisets or shown not to matter. Copies of one text are one member. First each
bucket's members are compared with one of them, that whose buckets are fullest, as it
stands in the middle of its group: one row a member and bucket. Buckets whose members are
then joined are done. Of the others, groups are made: buckets that share members, or single
buckets where those are fewer pairs. In a group each member outside its largest component
is compared with all members of other components. This is done block by block in tasks:
two blocks' multisets become 0/1 matrices over the shingles that both blocks have, whose
product counts what each two texts share. A block gives only the links that join two
components, never a row a pair. Texts whose sizes differ too much for the threshold don't
meet. No pair is left out by chance or by a cap once it shares a band.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, stash, unstash

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 5
SIGNATURE = BANDS * BAND_ROWS
#: Members that are compared with one copy of a leader's text.
FAN_OUT = 1024
#: Shingles that signatures are drawn for at once, and one document more.
BLOCK_SHINGLES = 1 << 16
#: A block of what stands outside a group's largest component holds about so many texts or shingles.
LEFT_TEXTS, LEFT_SHINGLES = 2048, 1 << 20
#: A task reads about so many shingles of the group for one such block.
RIGHT_SHINGLES = 1 << 22
#: Columns of the matrices at once.
SLICE = 4096

_G1, _G2, _G3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MEMO_WORDS = 1 << 17


class _Codes(dict):
    """64 bits for each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = zlib.crc32(word) << 32 | zlib.crc32(word[::-1] + b"|")
        return code


_memo = _Codes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _G2
    h = (h ^ (h >> np.uint64(27))) * _G3
    return h ^ (h >> np.uint64(31))


def _word_codes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > _MEMO_WORDS:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def shingles(text: str, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, ascending, and their counts. Lower-cased words between white space; under ``width`` words make one shingle."""
    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = _word_codes(words)
    n = max(1, len(codes) - width + 1)
    out = np.full(n, min(width, len(codes)), np.uint64)
    for k in range(min(width, len(codes))):
        out = _mix(out * _G1 + codes[k : k + n])
    return np.unique(out, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets; 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1) if len(a[0]) else np.zeros(0, np.int64)
    met = a[0][at] == b[0] if len(at) else np.zeros(len(b[0]), bool)
    common = int(np.minimum(a[1][at[met]], b[1][met]).sum()) if len(at) else 0
    return common / (total - common)


def _uniform(seed: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((_mix(seed) >> np.uint64(11)).astype(float) + 1) / float(1 << 53)


def _node(element: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The seed of a shingle's process on the weights (low, high]."""
    return _mix(_mix(element + _G1 * low.astype(np.uint64)) + _G2 * high.astype(np.uint64))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIGNATURE) -> np.ndarray:
    """One row a bag: at each position the hash of the point that came first; 0 for empty bags."""
    docs = len(bags)
    times, marks = np.full(docs * size, np.inf), np.zeros(docs * size, np.uint64)
    lengths = [len(b[0]) for b in bags]
    if not sum(lengths):
        return marks.reshape(docs, size)
    doc = np.repeat(np.arange(docs), lengths)
    element, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.int64)
    total = np.bincount(doc, weight, docs)
    # A process: document, shingle, its weight, the weights (low, high], the time of its last point, how many points it had.
    blocks, low, high = [], 0, 1
    while (on := weight > low).any():
        n = int(on.sum())
        blocks.append((doc[on], element[on], weight[on], np.full(n, low), np.full(n, high), np.zeros(n), np.zeros(n, np.uint64)))
        low, high = high, 2 * high
    going = tuple(np.concatenate(x) for x in zip(*blocks))

    def hit(d: np.ndarray, at: np.ndarray, point: np.ndarray) -> None:
        place = d * size + (point % np.uint64(size)).astype(np.int64)
        better = at < times[place]
        place, at, point = place[better], at[better], point[better]
        np.minimum.at(times, place, at)
        won = at == times[place]
        marks[place[won]] = point[won] | np.uint64(1)

    # Points are drawn up to a time by which a document's positions are likely all hit; it doubles where some are not.
    horizon = size * (np.log(size) + 1) / np.maximum(total, 1)
    while True:
        parked = []
        while len(going[0]):
            # Units go on as they are, so all their points up to the horizon come at once.
            unit = going[4] - going[3] == 1
            units, going = tuple(y[unit] for y in going), tuple(y[~unit] for y in going)
            while len(units[0]):
                d, e, w, lo, hi, x, k = units
                n = np.maximum(horizon[d] - x, 0).astype(np.int64) + 2
                of, first = np.repeat(np.arange(len(d)), n), np.cumsum(n) - n
                kth = k[of] + (np.arange(len(of)) - first[of]).astype(np.uint64)
                seed = _node(e, lo, hi)[of] + _G3 * kth
                at = np.cumsum(-np.log(_uniform(seed)))
                at += (x - np.r_[0.0, at][first])[of]
                soon = at <= horizon[d][of]
                hit(d[of[soon]], at[soon], _mix(seed[soon] ^ _G2))
                drawn = np.bincount(of[soon], minlength=len(d))
                x = np.where(drawn > 0, at[first + np.maximum(drawn, 1) - 1], x)
                state = (d, e, w, lo, hi, x, k + drawn.astype(np.uint64))
                parked.append(tuple(y[drawn < n] for y in state))
                units = tuple(y[drawn == n] for y in state)
            if not len(going[0]):
                break
            d, e, w, lo, hi, x, k = going
            seed = _node(e, lo, hi) + _G3 * k
            at = x - np.log(_uniform(seed)) / (hi - lo)
            soon = at <= horizon[d]
            if not soon.all():
                parked.append(tuple(y[~soon] for y in going))
                d, e, w, lo, hi, seed, at = (y[soon] for y in (d, e, w, lo, hi, seed, at))
            # A wider interval has one point only: it falls apart around it, half by half.
            point = side = _mix(seed ^ _G2)
            next_up = []
            while len(d):
                mid = (lo + hi) // 2
                side = _mix(side + _G1)
                left = side >> np.uint64(63) == 0
                other_lo, other_hi = np.where(left, mid, lo), np.where(left, hi, mid)
                lo, hi = np.where(left, lo, mid), np.where(left, mid, hi)
                matters = other_lo < w
                next_up.append(tuple(y[matters] for y in (d, e, w, other_lo, other_hi, at, np.zeros(len(d), np.uint64))))
                inside = lo < w  # else the point lies above the weight
                d, e, w, lo, hi, at, point, side = (y[inside] for y in (d, e, w, lo, hi, at, point, side))
                unit = hi - lo == 1
                hit(d[unit], at[unit], point[unit])
                next_up.append(tuple(y[unit] for y in (d, e, w, lo, hi, at, np.zeros(len(d), np.uint64))))
                d, e, w, lo, hi, at, point, side = (y[~unit] for y in (d, e, w, lo, hi, at, point, side))
            going = tuple(np.concatenate(y) for y in zip(*next_up)) if next_up else tuple(y[:0] for y in going)
        # All points up to the horizon are drawn, so a position that is hit is final.
        undone = (total > 0) & (times.reshape(docs, size).max(axis=1) > horizon)
        if not undone.any():
            return marks.reshape(docs, size)
        horizon = np.where(undone, 2 * horizon, horizon)
        going = tuple(np.concatenate(y)[undone[np.concatenate([p[0] for p in parked])]] for y in zip(*parked))


def band_hashes(marks: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(marks), 1))
    for r in range(rows):
        out = _mix(out * _G1 + marks[:, r : bands * rows : rows])
    return out.view(np.int64)


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("copy_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("size", T.LongType()),
    ]
)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands and number of shingles of each text; none for texts without words."""
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
    for batch in chunks(batches, 128):
        doc_ids, keys, texts = (batch.column(k).to_pylist() for k in range(3))
        bands, sizes = [None] * len(texts), [None] * len(texts)
        held: list[int] = []
        bags: list = []
        waiting = 0

        def flush():
            if bags:
                for i, bag, h in zip(held, bags, band_hashes(signatures(bags))):
                    bands[i], sizes[i] = h.tolist(), int(bag[1].sum())
            held.clear(), bags.clear()

        for i, text in enumerate(texts):
            bag = shingles(text or "")
            if not len(bag[0]):
                continue
            held.append(i), bags.append(bag)
            waiting += len(bag[0])
            if waiting > BLOCK_SHINGLES:
                flush()
                waiting = 0
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc_ids, keys, bands, sizes), kinds)], names=SIGNED.names)


def _compare():
    """Rows come by leader, the leader's own text first; yields the pairs and their similarities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, None
        for batch in chunks(batches):
            out = []
            for b, salt, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (b, salt) != at:
                    at, leader = (b, salt), None
                if doc == b:
                    leader = shingles(text or "")
                elif leader is not None:
                    out.append((doc, b, similarity(leader, shingles(text or ""))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return run


class _Block:
    """Texts of one side of a group: ids, components, sizes, and every shingle with its text; a shingle's k-th occurrence counts as one of its own."""

    def __init__(self) -> None:
        self.docs, self.parts, self.bags, self.held = [], [], [], 0

    def add(self, doc: int, part: int, text: str) -> None:
        hashes, counts = shingles(text or "")
        if counts.max(initial=1) > 1:
            first = np.cumsum(counts) - counts
            nth = np.arange(counts.sum()) - np.repeat(first, counts)
            hashes = np.repeat(hashes, counts)
            hashes = np.where(nth > 0, _mix(hashes + _G3 * nth.astype(np.uint64)), hashes)
        self.docs.append(doc), self.parts.append(part), self.bags.append(hashes)
        self.held += len(hashes)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(b) for b in self.bags], np.int64)
        return sizes, np.concatenate([np.zeros(0, np.uint64), *self.bags]), np.repeat(np.arange(len(sizes)), sizes)


class _Union:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


class _Left:
    """A block that others are held against."""

    def __init__(self, block: _Block) -> None:
        self.block, self.union = block, _Union()
        self.sizes, shingle, owner = block.arrays()
        self.vocabulary, code = np.unique(shingle, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.code, self.owner = code[order], owner[order]

    def links(self, other: _Block, threshold: float) -> list[tuple[int, int, int, int]]:
        """Pairs of this block and ``other`` that reach the threshold and join two components, and these."""
        sizes, shingle, owner = other.arrays()
        common = np.zeros((len(self.sizes), len(sizes)))
        if len(self.vocabulary) and len(shingle):
            at = np.minimum(np.searchsorted(self.vocabulary, shingle), len(self.vocabulary) - 1)
            met = self.vocabulary[at] == shingle
            at, owner = at[met], owner[met]
            used = np.zeros(len(self.vocabulary), bool)
            used[at] = True
            column = np.cumsum(used) - 1
            mine = used[self.code]
            my_column, my_owner = column[self.code[mine]], self.owner[mine]
            order = np.argsort(column[at], kind="stable")
            column, owner = column[at[order]], owner[order]
            for start in range(0, int(used.sum()), SLICE):
                sides = []
                for cols, owners, n in ((my_column, my_owner, len(self.sizes)), (column, owner, len(sizes))):
                    low, high = np.searchsorted(cols, [start, start + SLICE])
                    ones = np.zeros((n, SLICE), np.float32)
                    ones[owners[low:high], cols[low:high] - start] = 1
                    sides.append(ones)
                common += sides[0] @ sides[1].T
        alike = common / np.maximum(self.sizes[:, None] + sizes[None] - common, 1)
        mine, theirs = (np.array([self.union.find(p) for p in b.parts]) for b in (self.block, other))
        out = []
        for i, j in np.argwhere((alike >= threshold) & (mine[:, None] != theirs[None])):
            if self.union.join(self.block.parts[i], other.parts[j]):
                out.append((self.block.docs[i], other.docs[j], self.block.parts[i], other.parts[j]))
        return out


def _joining(threshold: float):
    """Rows come by group and block, those of the block first; yields links that join two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, block = None, None, _Block()

        def links() -> list[tuple[int, int, int, int]]:
            # Blocks are dealt by hash, so one of them may have got no text.
            return left.links(block, threshold) if isinstance(left, _Left) and left.block.docs and block.docs else []

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(4)], names=["a", "b", "component_a", "component_b"])

        for batch in chunks(batches):
            found = []
            for *at, right, doc, part, text in zip(*(batch.column(k).to_pylist() for k in range(len(batch.schema)))):
                if at != key:
                    found += links()
                    key, left, block = at, None, _Block()
                if right and left is None:
                    left, block = _Left(block), _Block()
                block.add(doc, part, text)
                if left is not None and (block.held > BLOCK_SHINGLES or len(block.docs) >= 512):
                    found += links()
                    block = _Block()
            if found:
                yield batch_of(found)
        if found := links():
            yield batch_of(found)

    return run


#: Ids of at most so many documents go to all executors to fetch their texts; beyond that texts are joined by exchange.
MAX_BROADCAST = 1_000_000

def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of an undirected graph ``a``, ``b``, by alternating large and small stars until each node but the least has one edge, to the least."""
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Now each u has smaller neighbours only.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now, old = stash(small.where("u <> v").distinct(), "star"), now
        unstash(old)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.stashed_at = now.stashed_at
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").isEmpty()


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` with these ids, written."""
    wanted = stash(ids.distinct(), "wanted")
    near = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    out = stash(texts.join(near, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    unstash(wanted)
    return out


def _linked(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, and its leader ``b``) that reach the threshold.

    A leader's text is sent once for every ``FAN_OUT`` members, each member's once a pair.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FAN_OUT).cast("int").alias("salts"))
    dealt = pairs.join(sizes, "b").select("a", "b", F.pmod(F.hash("a"), F.col("salts")).alias("salt"))
    members = dealt.join(held.withColumnRenamed("doc_id", "a"), "a").select("b", "salt", F.col("a").alias("doc"), "text")
    leaders = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(held.withColumnRenamed("doc_id", "b"), "b").select("b", "salt", F.col("b").alias("doc"), "text")
    rows = members.unionByName(leaders).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("doc") != F.col("b"))
    return rows.mapInArrow(_compare(), "a long, b long, similarity double").where(F.col("similarity") >= threshold).select("a", "b").distinct()


def _groups(now: DataFrame) -> DataFrame:
    """``group``, ``whole`` (its buckets together), doc, component, size: what of the buckets has to meet.

    ``now`` has the buckets whose members are of several components. Buckets that share members make
    one group, as texts mostly share many buckets; where the buckets alone are fewer pairs, each is one.
    """
    least = now.groupBy("bucket").agg(F.min("component").alias("low"), F.count(F.lit(1)).alias("n"))
    tied = components(now.join(least, "bucket").select(F.col("component").alias("a"), F.col("low").alias("b")))
    placed = now.join(tied.select(F.col("node").alias("component"), F.col("component").alias("region")), "component", "left")
    placed = stash(placed.withColumn("region", F.coalesce("region", "component")), "placed")
    members = placed.select("region", "doc", "component", "size").distinct()
    together = members.groupBy("region").agg(F.count(F.lit(1)).cast("double").alias("m"))
    alone = placed.groupBy("region", "bucket").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    whole = together.join(alone, "region").select("region", (F.col("m") * F.col("m") <= F.col("pairs")).alias("whole"))
    by_region = members.join(whole.where("whole"), "region").select(F.col("region").alias("group"), "whole", "doc", "component", "size")
    by_bucket = placed.join(whole.where("not whole"), "region").select(F.col("bucket").alias("group"), "whole", "doc", "component", "size")
    out = stash(by_region.unionByName(by_bucket), "groups")
    unstash(tied, placed)
    return out


def _joining_links(now: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links that join the components of groups, and these: those outside a group's largest component against all members."""
    key = ["group", "whole", "class"]
    groups = _groups(now)
    count = groups.groupBy("group", "whole", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = count.groupBy("group", "whole").agg(F.max(F.struct("n", "component")).alias("top")).select("group", "whole", F.col("top.component").alias("largest"))
    # Texts that reach the threshold are of the same size class or of neighbouring ones.
    size_class = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / threshold) + 1e-9).cast("long") if threshold < 1 else F.col("size")
    groups, unsided = stash(groups.join(largest, ["group", "whole"]).withColumn("class", size_class).withColumn("outside", F.col("component") != F.col("largest")), "sided"), groups
    unstash(unsided)
    blocks = groups.where("outside").groupBy(*key).agg(F.ceil(F.greatest(F.count(F.lit(1)) / LEFT_TEXTS, F.sum("size") / LEFT_SHINGLES)).cast("int").alias("lefts"))
    reach = groups.withColumn("class", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])))
    wide = reach.groupBy(*key).agg(F.ceil(F.sum("size") / RIGHT_SHINGLES).cast("int").alias("rights"))
    grid = stash(blocks.join(wide, key), "grid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    columns = [*key, "i", "j", "side", "doc", "component"]
    left = groups.where("outside").join(grid, key).withColumn("i", one("lefts")).withColumn("j", every("rights")).withColumn("side", F.lit(0)).select(*columns)
    right = reach.join(grid, key).withColumn("j", one("rights")).withColumn("i", every("lefts")).withColumn("side", F.lit(1)).select(*columns)
    rows = left.unionByName(right).join(held.withColumnRenamed("doc_id", "doc"), "doc")
    at = [*key, "i", "j"]
    rows = rows.select(*at, "side", "doc", "component", "text").repartition(*at).sortWithinPartitions(*at, "side")
    out = stash(rows.mapInArrow(_joining(threshold), "a long, b long, component_a long, component_b long"), "joining")
    unstash(groups, grid)
    return out


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and n_links of every row of ``docs``.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles is
    ``threshold`` or more; a class is what links and copies join, named by its least id.
    ``n_links`` counts the verified links of the text that made the class (links inside
    groups that were already joined are not looked for).

    Copies share their class, empty texts too. A null text is alone. Rows that share an id
    count as one document; rows without an id get the class of their copies, or null.
    Further columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stash(source.select("doc_id", F.unhex(F.md5("text")).alias("copy_key"), "text").mapInArrow(_sign, SIGNED), "signed")
    copies = signed.where("copy_key is not null").groupBy("copy_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = F.coalesce(F.col("first"), F.col("doc_id"))
    nodes = signed.join(copies, "copy_key", "left").select("doc_id", whole.alias("rep"), "size", F.when(F.col("doc_id") == whole, F.col("bands")).alias("bands"))
    nodes = stash(nodes, "nodes")

    members = nodes.where("bands is not null").select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("doc"), "size").distinct()
    busy = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stash(members.join(busy, "bucket"), "members")
    unstash(signed)
    middle = members.groupBy("doc").agg(F.sum("n").alias("score"))
    leaders = members.join(middle, "doc").groupBy("bucket").agg(F.max(F.struct("score", -F.col("doc"))).alias("top")).select("bucket", (-F.col("top.col2")).alias("leader"))
    pairs = members.select("bucket", "doc").join(leaders, "bucket").where("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = stash(pairs, "pairs")
    held = _texts_of(pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()), source)
    links = first_links = stash(_linked(pairs, held, threshold), "links")
    joined = first_joined = components(links)

    # Buckets with members of several components, some of which have not been compared.
    now = members.where("n > 2").join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    now = stash(now.join(open_, "bucket").select("bucket", "doc", "component", "size"), "open")
    unstash(members, pairs)
    more = tied = None
    if not now.isEmpty():
        more = _joining_links(now, held, threshold)
        links = links.unionByName(more.select("a", "b"))
        # What the new links join are the components as they were.
        tied = components(more.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
        alone = more.select(F.explode(F.array("component_a", "component_b")).alias("node")).distinct().withColumn("component", F.col("node"))
        before = joined.unionByName(alone.join(joined, "node", "left_anti"))
        joined = before.join(tied.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    out = nodes.select("doc_id", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(ends, "rep", "left")
    out = stash(out.select("doc_id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    unstash(nodes, held, first_links, first_joined, now, more, tied)
    return out


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` a class, with its columns: the one with the least id.

    Rows that repeat an id give one row. Rows without an id stay if no row with an id has
    their text, one for each text; those without a text, too, all stay.
    """
    classes = near_duplicates(docs, threshold=threshold, id_col=id_col, text_col=text_col)
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct()
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti")
    again = stash(classes.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col), "again")
    if not again.isEmpty():
        kept = kept.join(again, id_col, "left_anti").unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]))
    nameless = docs.where(F.col(id_col).isNull())
    if not nameless.isEmpty():
        named = docs.where(F.col(id_col).isNotNull()).select(text_col)
        own = nameless.where(F.col(text_col).isNotNull()).dropDuplicates([text_col]).join(named, text_col, "left_anti")
        kept = kept.unionByName(own.select(*docs.columns)).unionByName(nameless.where(F.col(text_col).isNull()))
    return kept.select(*docs.columns)
