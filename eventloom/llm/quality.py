"""Quality classifier: hashed word n-gram logistic regression, scored as sparse dot products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import hidden

EPOCHS = 6


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string")) % 3 == 1


def train(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bits: int = linear.BITS, max_rows: int = linear.MAX_ROWS, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights fitted on labelled rows whose id isn't held out.

    Rows without label, id or document are left out; a null text is an empty one. At most
    about ``max_rows`` rows are fitted, in groups of ``linear.SHARD_ROWS``. Without rows all
    weights are 0, so that each score is one half.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    marked = linear.bounded_labels(marked.where(~held_out(F.col("doc_id"))), "doc_id", max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(marked), "doc_id")  # at most max_rows pairs of numbers

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=[linear.zlib.crc32(b"%d" % d) for d in pdf["doc_id"]]).sort_values(["order", "doc_id", "text"], kind="stable")
        model = linear.Ftrl(1 << bits, alpha=0.5, beta=1.0, l1=0.05, l2=0.01)
        examples = []
        for text, label in zip(pdf["text"], pdf["label"]):
            index, values = linear.ngram_features(text, bits)
            examples.append((np.append(index, 1 << bits), np.append(values, 1.0), int(label)))
        for _ in range(epochs):
            for index, values, label in examples:
                model.learn(index, values, label)
        return linear.packed_models([model.weights()], len(pdf))

    packed = rows.groupBy("shard").applyInPandas(fit, linear.PACKED)
    return linear.averaged(packed, 1, 1 << bits)[0]


def score(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; only the text goes to Python. Null texts are empty; equal texts get equal scores."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits numbers, however large the corpus

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([float(linear.sigmoid(linear.margin(w, *linear.ngram_features(t or "", bits)))) for t in texts], dtype=float)

    return docs.withColumn(out, probability(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) of every row of ``docs``.

    Null ids are not held out, null texts score as empty ones, repeated rows are scored
    alike, further columns are not read, and an empty table gives no rows.
    """
    weights = train(docs, labels, **options)
    source = docs.select(F.col(options.get("id_col", "doc_id")).cast("long").alias("doc_id"), F.col(options.get("text_col", "text")).alias("text"))
    out = score(source, weights)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with its columns.

    Null texts score as empty ones, rows without an id are scored too, equal texts share their
    fate, repeated rows all stay or go, and an empty table stays empty.
    """
    name = hidden(docs, "score")
    scored = score(docs, train(docs, labels, **options), text_col=options.get("text_col", "text"), out=name)
    return scored.where(F.col(name) >= threshold).drop(name)
