"""Many words looked for at once: an automaton over all of them reads each text once.

A lexicon of bounded size is sent to tasks, each of which builds the automaton once. A larger
one is cut into blocks, and texts meet every block, so that no task holds more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a block of words.
BLOCK_CHARS = 20_000_000


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Gives each word's number in the list; empty words are never found."""
    out = ahocorasick.Automaton()
    for k, word in enumerate(words):
        if word:
            out.add_word(word, k)
    out.make_automaton()
    return out


def tokens_with(tokens: Column, words: list[str]) -> Column:
    """How many tokens hold one of the words, by one pass over each text's tokens; null for no tokens array."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(words)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else _count(found, t)).astype("Int64")

    # A line end separates tokens; within one it stands for itself nowhere.
    return F.size(tokens).cast("long") if "" in words else run(F.array_join(F.transform(tokens, lambda t: F.regexp_replace(t, "\n", "\r")), "\n"))


def _count(found: ahocorasick.Automaton, text: str) -> int:
    if not len(found):
        return 0
    n, end = 0, -1
    for at, _ in found.iter(text):
        if at > end:
            n += 1
            end = text.find("\n", at)
            if end < 0:
                break
    return n


def blocks_of(words: DataFrame, chars: int | None = None) -> tuple[DataFrame, int]:
    """``words`` (word) with ``block``, and the number of blocks: each has about so many characters."""
    total = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    n = max(1, -(-total // (chars or BLOCK_CHARS)))
    return words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(n)).cast("int")), n


def _held(word_field: str):
    """Rows come by block and shard, its words first; then each text's words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, words, found = None, [], None
        for frame in frames:
            out = []
            for block, shard, word, key, text in zip(*(frame[c] for c in ("block", "shard", word_field, "key", "text"))):
                if (block, shard) != at:
                    at, words, found = (block, shard), [], None
                if word is not None:
                    words.append(word)
                elif words:
                    found = found or automaton(words)
                    out += [(key, words[k]) for k in sorted({k for _, k in found.iter(text)})]
            if out:
                yield pd.DataFrame(out, columns=["key", "word"])

    return run


def matches(texts: DataFrame, words: DataFrame, chars: int | None = None) -> DataFrame:
    """key, word: each distinct word (``word``) that a text (``key``, ``text``) holds, once."""
    placed, n = blocks_of(words.where("word <> ''").select("word").distinct(), chars)
    schema = f"key {texts.schema['key'].dataType.simpleString()}, word string"
    if n == 1:
        held = [r.word for r in placed.select("word").orderBy("word").collect()]  # of bounded size

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = automaton(held)
            for frame in frames if held else ():
                out = [(key, held[k]) for key, text in zip(frame["key"], frame["text"]) for k in sorted({k for _, k in found.iter(text)})]
                if out:
                    yield pd.DataFrame(out, columns=["key", "word"])

        return texts.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)
    shards = max(1, texts.sparkSession.sparkContext.defaultParallelism // n)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    sides = placed.withColumn("shard", every(shards)), texts.select("key", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.hash("key"), F.lit(shards)).alias("shard")).withColumn("block", every(n))
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True).repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("word").asc_nulls_last())
    return rows.mapInPandas(_held("word"), schema)
