"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each model sees the
words of the text and the probabilities of all earlier categories. While fitting, those
probabilities come from models that were fitted without the row's own fold, so that a
later model does not trust earlier ones more than it may on new texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import stash

FOLDS = 3
EPOCHS = 3
#: Weak categories where only one overall label is given: a toxic text with one of these words.
SEEDS = {
    "insult": ["idiot", "stupid", "moron", "fool", "loser", "clown"],
    "contempt": ["scum", "disgusting", "worthless", "trash", "pathetic", "vermin"],
}


def seeded_categories(label: Column, text: Column, seeds: dict[str, list[str]] = SEEDS) -> dict[str, Column]:
    lowered = F.lower(text)
    return {name: ((label == 1) & lowered.rlike(r"\b(?:" + "|".join(words) + r")\b")).cast("int") for name, words in seeds.items()}


def fold_of(doc_id: int, folds: int = FOLDS) -> int:
    return linear.zlib.crc32(b"fold:%d" % doc_id) % folds


def _chain_features(text: str, models: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Features of the text and the earlier categories' probabilities, each at an index past the hashed ones."""
    index, values = linear.word_features(text, bits)
    found: list[float] = []
    for w in models:
        p = float(linear.sigmoid(linear.margin(w, index, values)))
        index, values = np.append(index, (1 << bits) + len(found)), np.append(values, p)
        found.append(p)
    return index, values, found


def _fit(category: str, earlier, size: int, bits: int, folds: int, epochs: int):
    """Fits the models of one category on one group of rows: one without each fold, then one on all."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=[linear.zlib.crc32(b"%d" % d) for d in pdf["doc_id"]]).sort_values(["order", "doc_id", "text"], kind="stable")
        models = [linear.Ftrl(size, alpha=0.3, beta=1.0, l1=1.0, l2=0.1) for _ in range(folds + 1)]
        examples = []
        for doc_id, text, label in zip(pdf["doc_id"], pdf["text"], pdf[category]):
            fold = fold_of(doc_id, folds)
            index, values, _ = _chain_features(text, earlier.value[fold], bits)
            examples.append((np.append(index, size), np.append(values, 1.0), int(label), fold))
        for _ in range(epochs):
            for index, values, label, fold in examples:
                for f, model in enumerate(models):
                    if f != fold:
                        model.learn(index, values, label)
        return linear.packed_models([m.weights() for m in models], len(pdf))

    return fit


def train_chain(rows: DataFrame, categories: list[str], *, bits: int = linear.BITS, folds: int = FOLDS, epochs: int = EPOCHS) -> list[np.ndarray]:
    """The chain's models, in the order of ``categories``.

    ``rows``: doc_id, text, shard and one column of 0 or 1 a category; bounded by the caller.
    Category k has ``folds`` models fitted without one fold each, for the probabilities
    that later categories are fitted on, and one fitted on all rows, which is returned.
    """
    spark, size = rows.sparkSession, (1 << bits) + len(categories)
    without: list[list[np.ndarray]] = []  # by category, then by fold
    whole: list[np.ndarray] = []
    for k, category in enumerate(categories):
        earlier = spark.sparkContext.broadcast([list(m) for m in zip(*without)] if without else [[] for _ in range(folds)])

        packed = rows.groupBy("shard").applyInPandas(_fit(category, earlier, size, bits, folds, epochs), linear.PACKED)
        fitted = linear.averaged(packed, folds + 1, size)
        without.append(fitted[:folds])
        whole.append(fitted[folds])
    return whole


def predict_chain(docs: DataFrame, models: list[np.ndarray], categories: list[str], *, text_col: str = "text", out: str = "p", bits: int = linear.BITS) -> DataFrame:
    """``docs`` with a struct of one probability a category. Null texts are empty; equal texts get equal ones; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf(", ".join(f"`{c}` double" for c in categories))
    def probabilities(texts: pd.Series) -> pd.DataFrame:
        found = [_chain_features(t or "", shared.value, bits)[2] for t in texts]
        return pd.DataFrame(np.asarray(found, float).reshape(len(found), len(categories)), columns=categories)

    return docs.withColumn(out, probabilities(F.col(text_col).cast("string")))


def classify(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", seeds: dict[str, list[str]] = SEEDS, id_col: str = "doc_id", text_col: str = "text", max_rows: int = linear.MAX_ROWS, threshold: float = 0.5
) -> DataFrame:
    """doc_id, one probability a category (p_insult, p_contempt, p_toxic) and ``toxic`` (1 from ``threshold`` on).

    The chain ends with the given label; before it come the categories of ``seeds``. It is
    fitted on about ``max_rows`` labelled rows at most. Null texts are empty; rows without
    id or label are not fitted on but scored; repeated rows are scored alike; further
    columns are not read; without labelled rows each probability is one half.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = linear.bounded_labels(marked, "doc_id", max_rows)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = source.join(F.broadcast(marked), "doc_id")  # at most max_rows pairs of numbers
    rows = stash(rows.withColumns(seeded_categories(F.col("toxic"), F.col("text"), seeds)), "toxicity-rows")
    categories = [*seeds, "toxic"]
    models = train_chain(rows, categories)
    out = predict_chain(source, models, categories)
    return out.select("doc_id", *[F.col(f"p.{c}").alias(f"p_{c}") for c in categories], (F.col("p.toxic") >= threshold).cast("int").alias("toxic"))
