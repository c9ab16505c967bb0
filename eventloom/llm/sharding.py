"""Sharding by histogram sort.

All documents are put into shards of near equal bytes along a sort key: the hash of the
text, then the hash of the id, so that equal texts lie next to each other. The splitters
come from exact counts: bytes below candidate key boundaries are counted for the whole
table, the interval that holds a splitter is probed again by finer boundaries, and so on
until each splitter meets the tolerance or one key is left. Then rows move once.

Counts are by key prefix, merged before the exchange, so a round sends a few thousand
sums at most, whatever the input. Intervals with many rows (copies of one text, say) are
refined too, by the hash of the id, and keep their rows in many tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash, unsigned_crc32, unstash

SHARDS = 24
#: Bits of the text hash and of the id hash that each probing round looks at.
HI_BITS, HI_LEVELS, LO_BITS, LO_LEVELS = 12, 5, 6, 10
LEVELS = HI_LEVELS + LO_LEVELS
#: An interval with over 1/HEAVY of all rows is refined, unless it has few.
HEAVY, FEW_ROWS = 1024, 256
#: Keys of rows that share id and text: up to so many go to all executors.
MAX_BROADCAST = 100_000


def _hash60(column: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(column, F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(level: int) -> tuple[Column, Column]:
    """A row's interval at a level: the leading bits of both hashes, the others 0."""
    hi, lo = F.col("hi"), F.lit(0).cast("long")
    if level < HI_LEVELS:
        hi = F.shiftleft(F.shiftright(hi, 60 - HI_BITS * level), 60 - HI_BITS * level)
    elif level > HI_LEVELS:
        bits = 60 - LO_BITS * (level - HI_LEVELS)
        lo = F.shiftleft(F.shiftright(F.col("lo"), bits), bits)
    return hi, lo


def _histogram(keyed: DataFrame, level: int, parents: list[dict]) -> list[dict]:
    """Exact bytes and rows of the intervals at a level, below the given ones: a bounded list for the driver."""
    if parents:
        hi, lo = _prefix(level - 1)
        keyed = keyed.where(hi.isin(sorted({p["hi"] for p in parents})) & lo.isin(sorted({p["lo"] for p in parents})))
    a, b = _prefix(level)
    found = keyed.groupBy(a.alias("hi"), b.alias("lo")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    return [{"level": level, "hi": r.hi, "lo": r.lo, "bytes": r.bytes, "rows": r.rows} for r in found]


def _below(node: dict) -> tuple[int, int]:
    """The key just past an interval."""
    level = node["level"]
    if level <= HI_LEVELS:
        return node["hi"] + (1 << (60 - HI_BITS * level)), 0
    return node["hi"], node["lo"] + (1 << (60 - LO_BITS * (level - HI_LEVELS)))


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], list[dict], set[tuple[int, int, int]]]:
    """The shards' lower keys but the first's, the final intervals in key order, and the heavy ones.

    ``tolerance``: bytes that a splitter may be off, as a share of an even shard; 0 goes
    down to single keys.
    """
    nodes = _histogram(keyed, 1, [])
    total, rows = sum(n["bytes"] for n in nodes), sum(n["rows"] for n in nodes)
    allowed = int(tolerance * total / shards)
    heavy_rows = max(FEW_ROWS, -(-rows // HEAVY))
    heavy: set[tuple[int, int, int]] = set()
    while True:
        nodes.sort(key=lambda n: (n["hi"], n["lo"]))
        edges, opened, before, i = [], [], 0, 1
        for n in nodes:
            after, wanted = before + n["bytes"], False
            while i < shards and -(-i * total // shards) <= after:
                target = -(-i * total // shards)
                if after - target <= allowed or n["rows"] == 1 or n["level"] == LEVELS:
                    edges.append(_below(n))
                elif target - before <= allowed:
                    edges.append((n["hi"], n["lo"]))
                else:
                    wanted = True
                i += 1
            if n["rows"] > heavy_rows and n["level"] < LEVELS:
                heavy.add((n["level"], n["hi"], n["lo"]))
                wanted = True
            if wanted:
                opened.append(n)
            before = after
        if not opened:
            return edges, nodes, heavy
        by_level: dict[int, list[dict]] = {}
        for n in opened:
            by_level.setdefault(n["level"], []).append(n)
        gone = {(n["level"], n["hi"], n["lo"]) for n in opened}
        nodes = [n for n in nodes if (n["level"], n["hi"], n["lo"]) not in gone]
        for level, parents in by_level.items():
            spans = {(p["hi"], p["lo"]) for p in parents}
            for child in _histogram(keyed, level + 1, parents):
                if _parent(child) in spans:
                    nodes.append(child)


def _parent(node: dict) -> tuple[int, int]:
    level = node["level"] - 1
    if level < HI_LEVELS:
        bits = 60 - HI_BITS * level
        return node["hi"] >> bits << bits, 0
    if level == HI_LEVELS:
        return node["hi"], 0
    bits = 60 - LO_BITS * (level - HI_LEVELS)
    return node["hi"], node["lo"] >> bits << bits


def _unit(node: dict, heavy: set[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The interval by which a node's rows are numbered: its highest ancestor (or itself) that isn't heavy."""
    line = [(node["level"], node["hi"], node["lo"])]
    at = dict(node)
    while at["level"] > 1:
        hi, lo = _parent(at)
        at = {"level": at["level"] - 1, "hi": hi, "lo": lo}
        line.append((at["level"], hi, lo))
    return next((x for x in reversed(line) if x not in heavy), line[0])


def _told_apart(keyed: DataFrame) -> DataFrame:
    """The written keys; rows that share id and text get keys of their own by the row's number, so that any number of them can be parted."""
    again = stash(keyed.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hi", "lo", F.lit(True).alias("again")), "again")
    n = again.count()
    if not n:
        return keyed
    own = _hash60(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("row").cast("string")))
    marked = keyed.join(F.broadcast(again) if n <= MAX_BROADCAST else again, ["hi", "lo"], "left")
    out = stash(marked.withColumn("lo", F.when(F.col("again"), own).otherwise(F.col("lo"))).drop("again"), "keys")
    unstash(keyed, again)
    return out


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, tolerance: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    Size is the text's UTF-8 bytes (null: none) plus 8. Shards hold consecutive keys of
    near equal bytes; slots number a shard's rows in key order from 0 without gaps. Equal
    texts are neighbours, so that only those at a splitter are parted. Rows equal in id
    and text are told apart by a number, in any order. Null ids hash as the empty text;
    further columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    keyed = stash(
        docs.select(
            doc_id.alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            unsigned_crc32(text).alias("text_crc32"),
            _hash60(text).alias("hi"),
            _hash60(doc_id.cast("string")).alias("lo"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "keys",
    )
    keyed = _told_apart(keyed)
    edges, nodes, heavy = splitters(keyed, shards, tolerance)
    # Where each interval's rows of a shard begin, from the counts.
    begins: dict[tuple, int] = {}
    taken = [0] * shards
    shard = 0
    for n in nodes:
        while shard < len(edges) and edges[shard] <= (n["hi"], n["lo"]):
            shard += 1
        begins.setdefault((*_unit(n, heavy), shard), taken[shard])
        taken[shard] += n["rows"]
    table = json.dumps([{"unit_level": u, "unit_hi": h, "unit_lo": w, "shard": s, "begin": b} for (u, h, w, s), b in begins.items()])
    schema = "array<struct<unit_level:int,unit_hi:bigint,unit_lo:bigint,shard:int,begin:bigint>>"
    # A few thousand rows, and 64 for each of at most HEAVY heavy intervals: bounded whatever the input.
    begin = spark.range(1).select(F.inline(F.from_json(F.lit(table), schema)))

    number = F.lit(0)
    for hi, lo in edges:
        number += ((F.col("hi") > hi) | ((F.col("hi") == hi) & (F.col("lo") >= lo))).cast("int")
    deepest = 1 + max((level for level, _, _ in heavy), default=0)
    a, b = _prefix(deepest)
    unit = F.struct(F.lit(deepest).alias("level"), a.alias("hi"), b.alias("lo"))
    for level in range(deepest - 1, 0, -1):
        a, b = _prefix(level)
        of_level = [x for x in heavy if x[0] == level]
        plain = F.struct(F.lit(level).alias("level"), a.alias("hi"), b.alias("lo"))
        full = F.struct(a.alias("hi"), b.alias("lo")) if level > HI_LEVELS else None
        is_heavy = a.isin([x[1] for x in of_level]) if full is None else full.isin([F.struct(F.lit(x[1]).cast("long").alias("hi"), F.lit(x[2]).cast("long").alias("lo")) for x in of_level])
        unit = F.when(is_heavy, unit).otherwise(plain)
    placed = keyed.withColumn("shard", number).withColumn("unit", unit)
    placed = placed.select("doc_id", "size", "text_crc32", "hi", "lo", "shard", F.col("unit.level").alias("unit_level"), F.col("unit.hi").alias("unit_hi"), F.col("unit.lo").alias("unit_lo"))
    names = ["unit_level", "unit_hi", "unit_lo", "shard"]
    w = Window.partitionBy(*names).orderBy("hi", "lo", "doc_id", "size")
    out = placed.withColumn("rn", F.row_number().over(w)).join(F.broadcast(begin), names)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("rn") - 1).cast("long").alias("slot"))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 is a reduction over the text's bits, as SQL has no function for it.
ORACLE_SQL = f"""
WITH keyed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS hi,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS lo, coalesce(text, '') AS text
  FROM documents
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY hi, lo ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM keyed
), placed AS (
  SELECT *, (({SHARDS} * before) // total)::INTEGER AS shard,
         list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda x: CASE WHEN x = '' THEN NULL ELSE ('0x' || x)::BIGINT END) AS bytes
  FROM summed
), bits AS (
  SELECT *, list_prepend(4294967295::BIGINT, flatten(list_transform(list_filter(bytes, lambda x: x IS NOT NULL), lambda x: [{", ".join(f"(x >> {k}) & 1" for k in range(8))}]))) AS bits FROM placed
)
SELECT doc_id, size, xor(list_reduce(bits, lambda a, b: xor(a >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT) AS text_crc32,
       'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY hi, lo, doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM bits
"""
