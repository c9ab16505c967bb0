"""Hashed sparse features and logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
#: At most so many labelled rows are fitted on; which ones follows from a hash of their ids.
MAX_ROWS = 20_000
#: Rows are fitted in groups of about so many side by side; the weights are averaged.
SHARD_ROWS = 5_000
MEMO_WORDS = 1 << 17

_WORD = re.compile(r"\w+|[^\w\s]+")
_LETTERS = re.compile(r"\w+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHAPES = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})
_memo: dict[str, int] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def _code(word: str) -> int:
    """Hash of the word in the high half, of its shape (at most four classes of letters in a row) in the low half."""
    shape = re.sub(r"(.)\1+", r"\1\1", word.translate(_SHAPES)) if word.isascii() else ("Éé" if word.istitle() else "É" if word.isupper() else "é")
    return zlib.crc32(word.encode("utf-8", "replace")) << 32 | zlib.crc32(shape.encode("utf-8", "replace"))


def _codes(text: str) -> np.ndarray:
    words = _WORD.findall(text)
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    for w in set(words):
        if w not in _memo:
            _memo[w] = _code(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def ngram_features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length counts of word unigrams and bigrams, their shapes, and repeats of the word before."""
    codes = _codes(text)
    shape, shift = codes & np.uint64(0xFFFFFFFF), np.uint64(64 - bits)
    parts = [mix(codes), mix(shape + _M1)]
    if len(codes) > 1:
        parts += [mix(codes[:-1] * _M1 + codes[1:]), mix(shape[:-1] * _M1 + shape[1:])]
        parts.append(np.full(int((codes[:-1] == codes[1:]).sum()), 12345, np.uint64) * _M1)
    index, counts = np.unique((np.concatenate(parts) >> shift).astype(np.int64), return_counts=True)
    values = counts.astype(float)
    return index, values / max(1e-12, float(np.sqrt((values * values).sum())))


#: Beginnings of words that are features of their own; they carry over to words that were never seen.
STEMS = (4, 5, 6, 7)
_stem_memo: dict[str, int] = {}
_stem_codes = np.zeros((1 << 12, 1 + len(STEMS)), np.uint64)


def _stems(words: list[str]) -> np.ndarray:
    """For each word the codes of itself and of its beginnings (the word's own code where it is shorter)."""
    global _stem_codes
    if len(_stem_memo) > MEMO_WORDS:
        _stem_memo.clear()
    for w in set(words):
        if w not in _stem_memo:
            row = _stem_memo[w] = len(_stem_memo)
            if row >= len(_stem_codes):
                _stem_codes = np.concatenate([_stem_codes, np.zeros_like(_stem_codes)])
            own = zlib.crc32(w.encode("utf-8", "replace"))
            _stem_codes[row] = [own] + [own if len(w) < k else zlib.crc32(w[:k].encode("utf-8", "replace")) | k << 32 for k in STEMS]
    return _stem_codes[np.fromiter(map(_stem_memo.__getitem__, words), np.int64, len(words))]


def word_features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words and their beginnings, each by the logarithm of its count."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    codes = _stems(words)
    longer = codes[:, 1:][codes[:, 1:] != codes[:, :1]]  # a beginning that isn't the whole word
    index, counts = np.unique((mix(np.concatenate([codes[:, 0], longer])) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    return index, np.log2(1.0 + counts)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader logistic regression; the last weight is the bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (sigmoid((w * values).sum()) - label) * values
        grown = self.n[index] + g * g
        self.z[index] += g - (np.sqrt(grown) - np.sqrt(self.n[index])) / self.alpha * w
        self.n[index] = grown


def margin(weights: np.ndarray, index: np.ndarray, values: np.ndarray) -> float:
    """The sparse dot product and the bias."""
    return float((weights[index] * values).sum() + weights[-1])


def bounded_labels(labels: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` of the rows at most, chosen by a hash of the id, each with the group (``shard``) that fits it."""
    n = labels.count()
    shards = max(1, -(-min(n, max_rows) // SHARD_ROWS))
    out = labels.withColumn("shard", F.pmod(F.xxhash64(F.col(id_col), F.lit("shard")), F.lit(shards)).cast("int"))
    if n <= max_rows:
        return out
    share = int(max_rows / n * (1 << 20))
    return out.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) < share)


def packed_models(models: list[np.ndarray], rows: int) -> pd.DataFrame:
    """One row a model: the weights that aren't 0."""
    out = []
    for k, w in enumerate(models):
        at = np.flatnonzero(w)
        out.append((k, rows, at.astype("<i4").tobytes(), w[at].astype("<f8").tobytes()))
    return pd.DataFrame(out, columns=["model", "rows", "at", "weights"])


PACKED = "model int, rows long, at binary, weights binary"


def averaged(packed: DataFrame, count: int, size: int) -> list[np.ndarray]:
    """The models of all shards, averaged by their rows. A few rows of bounded size come to the driver."""
    total, models = np.zeros(count), [np.zeros(size + 1) for _ in range(count)]
    for row in sorted(packed.collect(), key=lambda r: (r.model, bytes(r.at), bytes(r.weights))):
        at = np.frombuffer(row.at, "<i4")
        models[row.model][at] += row.rows * np.frombuffer(row.weights, "<f8")
        total[row.model] += row.rows
    return [m / t if t else m for m, t in zip(models, total)]
