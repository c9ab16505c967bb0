"""Quality rules from tokenizer fertility.

A public vocabulary measures how well a text fits what tokenizers were made for:
characters per token, the share of tokens that are raw bytes (byte fallback) and the
entropy of the token distribution. Each language (or script, where no language is
given) has rejection bands around its own medians; a document is rejected if a measure
leaves its band. As short texts scatter more and repeat their tokens less, the bands of a
language are those of texts about as long: each half octave of word counts has its own.
The medians come from all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary
from .common import chunks, hidden, stash

#: Half widths of the bands: so many scaled median deviations, and at least so much. Labels are no input.
BANDS = {"chars_per_token": (5.0, 0.1), "byte_share": (5.0, 0.02), "entropy_gap": (5.0, 0.03)}
#: Bands of few documents are wider, by a part of so much over the root of their number.
WIDEN = 3.0
#: Classes of length an octave of word counts.
CLASSES = 2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Measures are counted on this grid for exact medians of bounded size.
GRID = 1000
#: Bands of at most so many groups go to all executors.
MAX_BROADCAST = 10_000

MEASURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("group", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("chars_per_token", T.DoubleType()),
        T.StructField("byte_share", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("entropy_gap", T.DoubleType()),
    ]
)

#: Scripts told apart where no language is given: first code point, last code point, name.
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0900, 0x0DFF, "indic"),
    (0x0E00, 0x0E7F, "thai"),
    (0x3040, 0x30FF, "kana"),
    (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]


def script(text: str) -> str:
    """The script of most letters, the earlier listed on a tie; "none" without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = [int(((points >= a) & (points <= b)).sum()) for a, b, _ in SCRIPTS]
    return SCRIPTS[int(np.argmax(counts))][2] if any(counts) else "none"


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(known) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, inverse, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    windows = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= windows
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    seen: set[str] = set()
    found = 0
    for line in lines:
        if line.strip(" \t\n\r\v\f"):
            found += line in seen
            seen.add(line)
    return found


def _measure(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.load(vocabulary.PieceVocabulary, file)
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            split = [t.encode("utf-8", "replace").split() for t in texts]  # bytes split at ASCII white space only
            rows = []
            for doc_id, text, lang, words, packed in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), split, vocab.packed(split)):
                ids = np.frombuffer(packed, "<u4")
                n, chars = len(ids), len(text) - sum(map(text.count, " \t\n\r\v\f"))
                entropy = gap = 0.0
                if n:
                    counts = np.unique(ids, return_counts=True)[1]
                    entropy = max(0.0, float(np.log2(n) - (counts * np.log2(counts)).sum() / n))
                    gap = 1 - entropy / math.log2(n) if n > 1 else 0.0  # 0: all tokens differ, 1: all are the same
                rows.append(
                    (doc_id, lang or script(text), len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words))
                    + (n, chars / n if n else 0.0, float(vocab.is_byte[ids].mean()) if n else 0.0, entropy, gap)
                )
            if rows:
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=MEASURES.names)

    return run


def measure(docs: DataFrame, *, vocabulary_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row of measures a document (``MEASURES``); null texts have no words, null languages go by script."""
    file = vocabulary_file or vocabulary.path("piece_bpe_32k.model")
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return source.mapInArrow(_measure(file), MEASURES)


def bands(measures: DataFrame, rules: dict[str, tuple[float, float]] = BANDS, min_words: int = MIN_WORDS) -> DataFrame:
    """Median and half width of each measure by group and length, over all documents of ``min_words`` words.

    Values are put on a grid first, so that the exact medians keep at most one counter a
    grid value and group, merged before the exchange.
    """
    key = ["group", "length"]

    def middle(m: str) -> Column:
        return F.expr(f"percentile(round({m} * {GRID}) / {GRID}, 0.5)")

    base = measures.where(F.col("n_words") >= min_words)
    medians = small(stash(base.groupBy(*key).agg(*[middle(m).alias(f"mid_{m}") for m in rules]), "medians"))
    away = base.join(medians, key).select(*key, *[F.abs(F.col(m) - F.col(f"mid_{m}")).alias(m) for m in rules], *[f"mid_{m}" for m in rules])
    wider = 1 + WIDEN / F.sqrt(F.count(F.lit(1)))
    return away.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.first(f"mid_{m}").alias(f"mid_{m}") for m in rules],
        *[F.greatest(F.lit(least), F.lit(k * 1.4826) * middle(m) * wider).alias(f"half_{m}") for m, (k, least) in rules.items()],
    )


def small(edges: DataFrame) -> DataFrame:
    """A written table, to be sent to all executors if it has few rows; else it is joined by exchange."""
    return F.broadcast(edges) if edges.count() <= MAX_BROADCAST else edges


def judge(docs: DataFrame, *, rules: dict[str, tuple[float, float]] = BANDS, **options) -> DataFrame:
    """Measures of every document, ``base_failed``, the verdict ``kept`` and ``outside``: the measures that left their bands.

    Base rules reject under 50 words or more than half of the words in repeated windows.
    The others are judged by the bands of their group and length; one without a document of
    50 words has no bands. Empty and null texts fail the base rules. Rows are kept as they
    come: repeated rows give repeated results, null ids stay null, an empty table gives
    no rows, and further columns of ``docs`` are not read.
    """
    length = F.floor(CLASSES * F.log2(F.greatest("n_words", F.lit(1)).cast("double")) + 1e-9).cast("int")
    measures = stash(measure(docs, **options).withColumn("length", length), "fertility")
    edges = small(stash(bands(measures, rules), "bands"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    outside = F.array_compact(F.array(*[F.when(F.abs(F.col(m) - F.col(f"mid_{m}")) > F.col(f"half_{m}"), F.lit(m)) for m in rules]))
    joined = measures.join(edges, ["group", "length"], "left")  # neither is ever null
    judged = joined.withColumn("base_failed", failed).withColumn("outside", outside)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns of ``docs``; rows without an id are judged as well."""
    key = hidden(docs, "row")
    lang = options.get("lang_col", "lang")
    marked = stash(docs.withColumn(key, F.monotonically_increasing_id()), "fertility-docs")
    verdicts = judge(marked.select(F.col(key).alias("doc_id"), F.col(options.get("text_col", "text")).alias("text"), (F.col(lang) if lang else F.lit(None)).alias("lang")))
    kept = verdicts.where("kept").select(F.col("doc_id").alias(key))
    return marked.join(kept, key, "left_semi").drop(key)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", F.array_join("outside", ",").alias("outside"))
