"""Exact and near-duplicate removal by URL and by 64-bit fingerprints.

Pairs within a small Hamming distance k are found without comparing all pairs: the
fingerprint is cut into k + 1 bands, and two fingerprints within k agree on one of them.
Copies of a fingerprint are one member, so a group of copies is never paired.

Where only the first near row of each is asked for (the greedy rule, counts, stores), the
members of a band's bucket meet as blocks in tasks: two blocks' fingerprints make a matrix of
differing bits, and a row each at most comes out. So large groups of near fingerprints make no
pair rows. The greedy rule takes the rows that have a near one in order, a block of them at a
time: what is near a row kept before goes, the rest is settled within the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.tables import stash, unstash
from .lookups import numbered


def simhash64_native(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fingerprint of ``text``: each 4-character shingle's md5 votes on 64 bits; ties are 0."""
    grams = texts.select(key, F.explode(tx.shingles(F.col("text"))).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    h = F.md5("g")
    halves = grams.select(key, "n", *[F.conv(F.substring(h, at, 8), 16, 10).cast("long").alias(name) for at, name in ((17, "hi"), (25, "lo"))])
    votes = [F.sum(F.col("n") * (2 * F.shiftright(F.col(name), bit).bitwiseAND(F.lit(1)) - 1)).alias(f"{name}{bit}") for name in ("hi", "lo") for bit in range(32)]
    counted = halves.groupBy(key).agg(*votes)
    out = F.lit(0).cast("long")
    for name, base in (("hi", 32), ("lo", 0)):
        for bit in range(32):
            out = out.bitwiseOR(F.when(F.col(f"{name}{bit}") > 0, F.lit(-(1 << 63) if base + bit == 63 else 1 << (base + bit)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(key, out.alias("fingerprint"))


def _fingerprint(text: str) -> int | None:
    """The same fingerprint, with the votes summed by numpy."""
    t = "".join(text.split())
    if not t:
        return None
    grams = [t[i : i + 4] for i in range(len(t) - 3)] or [t]
    low = np.frombuffer(b"".join(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[8:] for g in grams), ">u8")
    ones = np.unpackbits(low.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    bits = (2 * ones.astype(np.int64) > len(grams)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


#: Places for remembered shingles, as a power of two; characters of texts that are looked at together.
MEMO_BITS, TOGETHER = 20, 1 << 17
_LANES = np.uint64(0x0101010101010101)


class Shingles:
    """Fingerprints of many texts; the hashes of shingles, which come again and again, are remembered in a table of fixed size."""

    def __init__(self, bits: int | None = None):
        self.shift = np.uint64(64 - (bits or MEMO_BITS))
        # A shingle and its hash lie side by side and are read as one value of 16 bytes.
        self.table = np.zeros((1 << (bits or MEMO_BITS), 2), np.uint64)
        self.keys, self.hashes = self.table[:, 0], self.table[:, 1]
        # No place holds a shingle that has not been hashed: that of 0 begins with one of another place.
        self.keys[self._places(np.zeros(1, np.uint64))] = next(k for k in range(1, 1 << 20) if self._places(np.array([k], np.uint64))[0] != 0)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def _hashed(self, t: str, keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        known = self.table.view(np.complex128).ravel().take(at.view(np.int64)).view(np.uint64).reshape(-1, 2)
        out = known[:, 1].copy()
        new = np.flatnonzero(known[:, 0] != keys)
        if len(new):
            _, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            first = new[first]
            low = b"".join(hashlib.md5(t[i : i + 4].encode("utf-8", "surrogatepass")).digest()[8:] for i in begins[first].tolist())
            hashes = np.frombuffer(low, ">u8").astype(np.uint64)
            out[new] = hashes[back]
            # Of several for one place the one that counts must come with its own hash.
            places, one = np.unique(at[first], return_index=True)
            self.keys[places], self.hashes[places] = keys[first[one]], hashes[one]
        return out

    def fingerprint(self, text: str) -> int | None:
        return self.fingerprints([text])[0]

    def fingerprints(self, texts: list[str]) -> list[int | None]:
        out, some, chars = [], [], 0
        for text in texts:
            some.append("".join(text.split()))
            chars += len(some[-1])
            if chars >= TOGETHER:
                out += self._together(some)
                some, chars = [], 0
        return out + self._together(some)

    def _together(self, texts: list[str]) -> list[int | None]:
        """The fingerprints of texts without white space, by one look at the shingles of all."""
        t, size = "".join(texts), np.array([len(x) for x in texts], np.int64)
        codes, ends = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size)
        # Four characters of 16 bits are a key of 64; texts with others, or of fewer, are looked at alone.
        alone = size < 4
        alone[np.searchsorted(ends, np.flatnonzero(codes > 0xFFFF), "right")] = True
        found: list[int | None] = [_fingerprint(x) if one else None for x, one in zip(texts, alone)]
        rest = np.flatnonzero(~alone)
        if not len(rest):
            return found
        wide = codes.astype(np.uint64)
        pairs = wide[:-1] | (wide[1:] << np.uint64(16))
        n = size[rest] - 3
        before = np.cumsum(n) - n
        begins = np.arange(n.sum()) + np.repeat((ends - size)[rest] - before, n)
        hashes = self._hashed(t, (pairs[:-2] | (pairs[2:] << np.uint64(32)))[begins], begins)
        # Bytes count to 255 without a carry, so votes are summed by blocks, then by texts.
        blocks = -(-n // 255)
        first = np.cumsum(blocks) - blocks
        starts = np.repeat(before - 255 * first, blocks) + 255 * np.arange(blocks.sum())
        ones = np.empty((len(rest), 8, 8), np.int64)  # by text, byte and bit in it
        for bit in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
            ones[:, :, bit] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        bits = np.packbits((2 * ones > n[:, None, None]).reshape(len(rest), 64), axis=1, bitorder="little").view("<i8").ravel()
        for i, value in zip(rest.tolist(), bits.tolist()):
            found[i] = value
        return found


_shingles: list[Shingles] = []


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """Fingerprints of texts, null for those without a character; faster than the native form, with equal results."""
    if not _shingles:  # one a worker
        _shingles.append(Shingles())
    return pd.Series(_shingles[0].fingerprints([t or "" for t in texts]), dtype="Int64")


def unsigned(fingerprint: Column) -> Column:
    """A fingerprint as the decimal text of an unsigned number."""
    wide = fingerprint.cast("decimal(20,0)")
    return F.when(fingerprint < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)").cast("string")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def band_rows(prints: DataFrame, k: int) -> DataFrame:
    """Each fingerprint once a band: the band's number and bits."""
    width = -(-64 // (k + 1))
    bands = []
    for b in range(k + 1):
        size = min(width, 64 - b * width)
        bands.append(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(F.col("fingerprint"), b * width).bitwiseAND(F.lit((1 << size) - 1)).alias("bits")))
    return prints.withColumn("b", F.explode(F.array(*bands))).select("*", "b.band", "b.bits").drop("b")


def near_dup_pairs(prints: DataFrame, k: int = 3, scope: str | None = None) -> DataFrame:
    """seq_a < seq_b of different fingerprints within k bits; ``prints``: seq, fingerprint and perhaps a scope such as the event.

    Of equal fingerprints (in a scope) only the first takes part; ``copies_of`` gives the others.
    """
    keys = [scope] if scope else []
    firsts = prints.groupBy(*keys, "fingerprint").agg(F.min("seq").alias("seq"))
    a = band_rows(firsts, k)
    b = a.select(*keys, "band", "bits", F.col("fingerprint").alias("fingerprint_b"), F.col("seq").alias("seq_b"))
    pairs = a.join(b, [*keys, "band", "bits"]).where((F.col("seq") < F.col("seq_b")) & (F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("fingerprint_b"))) <= k))
    return pairs.select(*keys, F.col("seq").alias("seq_a"), "seq_b", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("fingerprint_b"))).cast("long").alias("distance")).distinct()


def copies_of(prints: DataFrame, scope: str | None = None) -> DataFrame:
    """seq_a, seq_b, distance 0: each row of a fingerprint (in a scope) but the first, with the first."""
    keys = [scope] if scope else []
    firsts = prints.where("fingerprint is not null").groupBy(*keys, "fingerprint").agg(F.min("seq").alias("seq_a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = prints.select(*keys, "fingerprint", F.col("seq").alias("seq_b")).join(firsts, [*keys, "fingerprint"]).where("seq_a <> seq_b")
    return rows.select(*keys, "seq_a", "seq_b", F.lit(0).cast("long").alias("distance"))


#: Rows of one side of a bucket that meet those of the other in one task; rows compared at once; rows that the greedy rule settles at a time.
RIGHT_ROWS, LEFT_ROWS, TILE, SETTLED = 1 << 14, 1 << 16, 512, 1 << 16


def _met(k: int):
    """Rows come by bucket and block, those of the right side first and by seq; yields each left row's first near right one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seqs, prints = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column(c) for c in ("bucket", "i", "j", "side")]
            parts = [c.to_numpy() for c in parts]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in parts], axis=0)) + 1).tolist(), batch.num_rows]
            of, seq, bits = (batch.column(c).to_numpy() for c in ("before", "seq", "fingerprint"))
            found = []
            for start, end in zip(cuts, cuts[1:]):
                at = tuple(int(c[start]) for c in parts[:3])
                if at != key:
                    key, seqs, prints = at, [], []
                if not parts[3][start]:
                    seqs.append(seq[start:end]), prints.append(bits[start:end])
                    continue
                if not seqs:
                    continue
                right, right_bits = np.concatenate(seqs), np.concatenate(prints)
                seqs, prints = [right], [right_bits]
                for s in range(start, end, TILE):
                    e = min(s + TILE, end)
                    near = np.bitwise_count((bits[s:e, None] ^ right_bits[None]).view(np.uint64)) <= k
                    near &= right[None] < of[s:e, None]
                    near &= right[None] != seq[s:e, None]
                    some = np.flatnonzero(near.any(axis=1))
                    found.append((seq[s:e][some], right[near[some].argmax(axis=1)]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["seq", "of"])

    return run


def first_near(left: DataFrame, right: DataFrame, k: int = 3, scope: str | None = None, earlier: bool = True) -> DataFrame:
    """seq, of: for each row of ``left`` the least seq of ``right`` within k bits, and before it if ``earlier``; rows without one are left out.

    Both have seq, fingerprint and perhaps a scope. A row itself doesn't count, nor do null fingerprints.
    """
    keys = [scope] if scope else []

    def side(df: DataFrame, n: int) -> DataFrame:
        rows = band_rows(df.select(*keys, "seq", "fingerprint").where("fingerprint is not null"), k)
        before = F.col("seq") if earlier else F.lit((1 << 63) - 1)
        return rows.select(F.xxhash64(*keys, "band", "bits").alias("bucket"), "seq", "fingerprint", before.alias("before"), F.lit(n).alias("side"), *keys)

    rows = side(right, 0).unionByName(side(left, 1))
    sizes = rows.groupBy("bucket").agg(F.count_if(F.col("side") == 0).alias("rights"), F.count_if(F.col("side") == 1).alias("lefts"))
    large = sizes.where((F.col("rights") > RIGHT_ROWS) | (F.col("lefts") > LEFT_ROWS)).select("bucket", F.ceil(F.col("rights") / RIGHT_ROWS).cast("int").alias("j_n"), F.ceil(F.col("lefts") / LEFT_ROWS).cast("int").alias("i_n"))
    rows = rows.join(large, "bucket", "left").withColumns({"i_n": F.greatest(F.coalesce("i_n", F.lit(1)), F.lit(1)), "j_n": F.greatest(F.coalesce("j_n", F.lit(1)), F.lit(1))})
    own = lambda n: F.pmod(F.xxhash64("fingerprint"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("i", F.explode(F.when(F.col("side") == 0, every("i_n")).otherwise(F.array(own("i_n"))))).withColumn("j", F.explode(F.when(F.col("side") == 1, every("j_n")).otherwise(F.array(own("j_n")))))
    dealt = rows.select("bucket", "i", "j", "side", "seq", "fingerprint", "before")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "seq")
    return dealt.mapInArrow(_met(k), "seq long, of long").groupBy("seq").agg(F.min("of").alias("of"))


def _greedy(k: int):
    """The rule within a block of one scope: a row is kept unless it is near one kept before."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        bits, kept, n = rows["fingerprint"].to_numpy(np.int64).view(np.uint64), np.zeros(len(rows), np.uint64), 0
        gone = np.zeros(len(rows), bool)
        for start in range(0, len(rows), TILE):
            tile = bits[start : start + TILE]
            # Against what was kept before the tile at once, then one after another.
            for at in range(0, n, RIGHT_ROWS):
                gone[start : start + TILE] |= (np.bitwise_count(tile[:, None] ^ kept[None, at : min(n, at + RIGHT_ROWS)]) <= k).any(axis=1)
            first = n
            for x in range(start, min(start + TILE, len(rows))):
                if not gone[x] and not (np.bitwise_count(kept[first:n] ^ bits[x]) <= k).any():
                    kept[n] = bits[x]
                    n += 1
                else:
                    gone[x] = True
        return pd.DataFrame({"seq": rows["seq"].to_numpy(), "kept": ~gone})

    return run


def near_dup_greedy(prints: DataFrame, k: int = 3, scope: str | None = None) -> DataFrame:
    """``prints`` with ``kept``: a row is kept unless it is within k bits of a kept row before it (of its scope).

    Of equal fingerprints the first stands for all; rows without one are kept. Only first rows
    that have a near one are settled, in order and block by block, all scopes side by side.
    """
    keys = [scope] if scope else []
    known = prints.where("fingerprint is not null")
    firsts = stash(known.groupBy(*keys, "fingerprint").agg(F.min("seq").alias("seq")), "firsts")
    undecided = stash(firsts.join(first_near(firsts, firsts, k, scope, earlier=False).select("seq"), "seq"), "undecided")
    placed = dealt = numbered(undecided, *keys, "seq")
    if scope:
        begins = placed.groupBy(F.col(scope).alias("__scope")).agg(F.min("pos").alias("__first"))
        placed = placed.join(begins, F.col(scope).eqNullSafe(F.col("__scope"))).withColumn("pos", F.col("pos") - F.col("__first") + 1)
    placed = stash(placed.select(*keys, "seq", "fingerprint", F.floor((F.col("pos") - 1) / SETTLED).cast("long").alias("block")), "placed")
    unstash(undecided, dealt)
    last = placed.agg(F.max("block")).first()[0]
    settled, kept = [], None
    for block in range(0 if last is None else last + 1):
        now = placed.where(F.col("block") == block)
        if kept is not None:
            gone = stash(first_near(now, kept, k, scope).select("seq"), "gone")
            settled.append(gone.withColumn("kept", F.lit(False)))
            now = now.join(gone, "seq", "left_anti")
        done = stash(now.withColumn("g", F.lit(0)).groupBy(*keys or ["g"]).applyInPandas(_greedy(k), "seq long, kept boolean"), "done")
        settled.append(done)
        stay = placed.join(done.where("kept").select("seq"), "seq", "left_semi").select(*keys, "seq", "fingerprint")
        stay = stash(stay, "stay") if block < last else stay
        kept = stay if kept is None else kept.unionByName(stay)
    dropped = None
    for part in settled:
        part = part.where("not kept").select("seq")
        dropped = part if dropped is None else dropped.unionByName(part)
    first = firsts.select("seq", F.lit(True).alias("__first"))
    # By seq alone, so that the rows' other columns move once.
    marked = prints.join(first if dropped is None else first.join(dropped, "seq", "left_anti"), "seq", "left")
    return marked.withColumn("kept", F.col("fingerprint").isNull() | F.col("__first").isNotNull()).select(*prints.columns, "kept")


def dedup_url(new: DataFrame, stored: DataFrame, url: str = "source_url") -> DataFrame:
    """New rows whose URL isn't stored, the first of each URL by ``seq``."""
    w = Window.partitionBy(url).orderBy("seq")
    fresh = new.join(stored.select(url), url, "left_anti")
    return fresh.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dedup_store(new: DataFrame, stored: DataFrame, k: int = 3) -> DataFrame:
    """New rows that are near no stored fingerprint and no kept new row before them."""
    old = stored.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", F.lit(-(1 << 63)).alias("seq"))
    near = first_near(new, old, k, earlier=False)
    fresh = new.join(near.select("seq"), "seq", "left_anti")
    return near_dup_greedy(fresh, k).where("kept").drop("kept")


def comment_dup_count(comments: DataFrame, k: int = 3) -> DataFrame:
    """Kept comments with ``duplicate_count``: themselves and the later comments near them; a comment near several counts for the first."""
    kept = stash(near_dup_greedy(comments, k), "comments")
    near = first_near(kept.where("not kept"), kept.where("kept"), k)
    counts = near.groupBy(F.col("of").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    return kept.where("kept").join(counts, "seq", "left").withColumn("duplicate_count", F.coalesce("n", F.lit(0)) + 1).drop("kept", "n")
