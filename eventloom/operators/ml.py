"""Sentiment models: training, a store of them by kind of text, prediction, and a hook for any pretrained classifier."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..sources.tables import stash, unstash
from . import report

FEATURES = 1 << 16
#: Kinds of text that models are kept for; the first one's model stands in where another has none.
TEXT_TYPES = ("comment", "article")
#: Bits of the hash that a round of counting looks at.
BITS = 12

log = logging.getLogger(__name__)


def split(labelled: DataFrame, key: str = "doc_id", seed: int = 42, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows for fitting and rows held out: of each label exactly the share (rounded) with the least hashes of key and text.

    The hash up to which rows are held out is found by counting: each round takes some more of
    its bits and counts the rows of each value; nothing is sorted. Rows that are equal in key,
    label and text count one by one.
    """
    h = F.xxhash64(F.col(key), F.col("label"), F.col("text"), F.lit(seed))
    rows = labelled.withColumn("__h", F.shiftrightunsigned(h, 4))  # 60 bits
    wanted = {r.label: int(r.n * share + 0.5) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prefix = dict.fromkeys(wanted, 0)
    for low in range(60 - BITS, -1, -BITS):
        within = F.lit(False)
        for label, p in prefix.items():
            within |= F.col("label").eqNullSafe(F.lit(label)) & (F.shiftrightunsigned("__h", low + BITS) == p)
        counts: dict = {label: {} for label in wanted}
        # A round gives at most 2^BITS rows a label.
        for r in rows.where(within).groupBy("label", F.shiftrightunsigned("__h", low).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r.label][r.p] = r.n
        for label, n in counts.items():
            for p in sorted(n):
                if n[p] >= wanted[label]:
                    prefix[label] = p
                    break
                wanted[label] -= n[p]
    below, edge, left = F.lit(False), F.lit(False), F.lit(0)
    for label, p in prefix.items():
        mine = F.col("label").eqNullSafe(F.lit(label))
        below, edge = below | (mine & (F.col("__h") < p)), edge | (mine & (F.col("__h") == p))
        left = F.when(mine, wanted[label]).otherwise(left)
    # Rows of the last hash are equal in what counts, so it doesn't matter which of them are held out.
    same = rows.where(edge).groupBy(*labelled.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__left", left)
    held, fit = (same.where(n > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*labelled.columns) for n in (F.least("__n", "__left"), F.col("__n") - F.least("__n", "__left")))
    return rows.where(~below & ~edge).select(*labelled.columns).unionByName(fit), rows.where(below).select(*labelled.columns).unionByName(held)


def train(labelled: DataFrame, kind: str = "lr", steps: int = 1000) -> PipelineModel:
    """tf-idf of unit length and a linear model on ``text`` and ``label`` (positive or negative); a neutral label is an error."""
    y = F.when(F.col("label") == "positive", 1.0).when(F.col("label") == "negative", 0.0).otherwise(F.raise_error(F.lit("only positive and negative rows can be trained on")).cast("double"))
    rows = stash(labelled.select(tx.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"), y.alias("y")), "fit")
    # The penalty is that of one unit for the sum of all losses.
    model = NaiveBayes(labelCol="y", featuresCol="features") if kind == "nb" else LogisticRegression(labelCol="y", featuresCol="features", maxIter=steps, regParam=1 / max(1, rows.count()), standardization=False)
    stages = [HashingTF(inputCol="tokens", outputCol="tf", numFeatures=FEATURES), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features"), model]
    out = Pipeline(stages=stages).fit(rows)
    unstash(rows)
    return out


def predict(model: PipelineModel, texts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``texts`` with p_positive and the label; unsure ones are neutral."""
    out = model.transform(texts.withColumn("tokens", tx.tokenize(F.coalesce("text", F.lit("")))))
    p = vector_to_array("probability")
    out = out.withColumn("p_positive", F.get(p, F.lit(1)))
    return out.withColumn("label", vl.label_from_proba(F.col("p_positive"), 1 - F.col("p_positive"), threshold)).drop("tokens", "tf", "tfidf", "features", "rawPrediction", "probability", "prediction")


def train_and_choose(labelled: DataFrame, key: str = "doc_id", threshold: float = 0.6) -> tuple[str, PipelineModel, dict[str, float]]:
    """The better of both models by held-out accuracy; unsure rows are neutral, so wrong."""
    fit, held = (stash(part, "split") for part in split(labelled, key))
    found = {kind: train(fit, kind) for kind in ("nb", "lr")}
    scores = {k: accuracy(predict(m, held.withColumnRenamed("label", "truth"), threshold)) for k, m in found.items()}
    best = max(scores, key=lambda k: (scores[k], k))
    unstash(fit, held)
    return best, found[best], scores


def accuracy(predicted: DataFrame) -> float:
    """Share of rows whose ``label`` is their ``truth``; 0 for none."""
    return predicted.agg(F.avg((F.col("label") == F.col("truth")).cast("double"))).first()[0] or 0.0


def _versions(spark: SparkSession, folder: str, text_type: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/text_type={text_type}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    # A model whose writing has not ended has no stages' metadata yet.
    names = [s.getPath().getName() for s in files.listStatus(place)]
    done = [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/text_type={text_type}/{n}/metadata/_SUCCESS"))]
    return sorted(n for n in done if n.startswith("version="))


def save_model(model: PipelineModel, spark: SparkSession, folder: str, text_type: str) -> str:
    """The model as the newest version for a kind of text; earlier ones stay. Gives its path."""
    if text_type not in TEXT_TYPES:
        raise ValueError(f"text_type must be one of {TEXT_TYPES}, got {text_type!r}")
    last = _versions(spark, folder, text_type)
    number = int(last[-1].split("=")[1]) + 1 if last else 1
    path = f"{folder}/text_type={text_type}/version={number:08d}"
    model.write().overwrite().save(path)
    return path


def newest_model(spark: SparkSession, folder: str, text_type: str) -> tuple[str, bool]:
    """Path of the newest model for a kind of text, and whether it is another kind's that stands in; an error if there is none."""
    if text_type not in TEXT_TYPES:
        raise ValueError(f"text_type must be one of {TEXT_TYPES} or 'auto', got {text_type!r}")
    for kind in dict.fromkeys((text_type, TEXT_TYPES[0])):
        if versions := _versions(spark, folder, kind):
            if kind != text_type:
                log.warning("no %s model; that for %s texts is used", text_type, kind)
            return f"{folder}/text_type={kind}/{versions[-1]}", kind != text_type
    raise FileNotFoundError(f"no sentiment model for {text_type} texts, nor for {TEXT_TYPES[0]} ones, in {folder}")


def predict_stored(folder: str, texts: DataFrame, text_type: str = "auto", threshold: float = 0.6) -> DataFrame:
    """``predict`` with the newest stored model for the kind of text; with "auto" long texts are articles.

    Each model is loaded once, and reads the rows of its kinds only.
    """
    spark = texts.sparkSession
    if text_type != "auto":
        return predict(PipelineModel.load(newest_model(spark, folder, text_type)[0]), texts, threshold)
    by_path: dict[str, list[str]] = {}
    for kind in TEXT_TYPES:
        by_path.setdefault(newest_model(spark, folder, kind)[0], []).append(kind)
    out = None
    for path, kinds in by_path.items():
        mine = texts if len(by_path) == 1 else texts.where(vl.auto_text_type(F.coalesce("text", F.lit(""))).isin(kinds))
        found = predict(PipelineModel.load(path), mine, threshold)
        out = found if out is None else out.unionByName(found)
    return out


def domain_shift(folder: str, model_type: str, labelled: DataFrame, threshold: float = 0.6) -> tuple[float, int]:
    """Accuracy of a kind's newest model on labelled texts (``text``, ``label``) of any other kind, and their number."""
    found = stash(predict_stored(folder, labelled.withColumnRenamed("label", "truth"), model_type, threshold).select("truth", "label"), "shift")
    n, score = found.count(), accuracy(found)
    unstash(found)
    return score, n


def sentiment_route(texts: DataFrame, positive: list[str], negative: list[str], classify: Callable[[pd.Series], pd.DataFrame]) -> DataFrame:
    """``texts`` (``text``, ``platform``) with ``method`` and ``label``: articles by the dictionary, all others by a classifier."""
    article = vl.text_type(F.col("platform")) == "article"
    # The classifier sees no article.
    rows = batch_infer(texts.withColumns({"__article": article, "__short": F.when(~article, F.col("text"))}), classify, "__short").withColumnRenamed("label", "__model")
    found = report.sentiment_dict(rows.withColumn("tokens", F.when(F.col("__article"), tx.tokenize(F.col("text"))).otherwise(F.array().cast("array<string>"))), positive, negative)
    label = F.when(F.col("__article"), F.col("label")).otherwise(F.col("__model"))
    return found.select(*[c for c in texts.columns], F.when(F.col("__article"), "dict").otherwise("model").alias("method"), label.alias("label"))


def batch_infer(texts: DataFrame, classify: Callable[[pd.Series], pd.DataFrame], text_col: str = "text") -> DataFrame:
    """``texts`` with ``label`` and ``score`` of any classifier of batches; labels are unified, unsure ones neutral."""

    @F.pandas_udf("raw string, score double")
    def run(batch: pd.Series) -> pd.DataFrame:
        found = classify(batch.fillna(""))
        return pd.DataFrame({"raw": found["label"].astype(str), "score": found["score"].astype(float)})

    out = texts.withColumn("__out", run(F.col(text_col)))
    return out.withColumns({"label": vl.label_from_model(F.col("__out.raw"), F.col("__out.score")), "score": F.col("__out.score")}).drop("__out")
