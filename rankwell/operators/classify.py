"""Text to cluster classifier: training, selection, metrics, routing.

Inputs have ``id, question, documents, cluster``; the model reads the tokens of the
question joined with its first chunk, and at question time those of the question alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_with_chunk, tokenize
from ..functions.vectors import rounded
from .clustering import check_cluster_count

FEATURES = 1 << 14


@dataclass(frozen=True)
class Setting:
    """One candidate of the model selection."""

    reg_param: float = 0.01
    max_iter: int = 20


def training_rows(df: DataFrame) -> DataFrame:
    text = question_with_chunk(F.col("question"), F.col("documents"))
    return df.select(
        "id", tokenize(text).alias("tokens"), F.col("cluster").cast("double").alias("label")
    )


def question_rows(df: DataFrame, text: str = "question") -> DataFrame:
    return df.select("query_id", tokenize(F.col(text)).alias("tokens"))


def class_count(df: DataFrame) -> DataFrame:
    """Classes run from 0 to the largest label of the training rows."""
    return df.agg((F.max("cluster") + 1).alias("n_classes"))


def fit_features(rows: DataFrame) -> PipelineModel:
    """Hashed TF-IDF of ``tokens``: no setting changes it, so it is fitted once."""
    stages = [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=FEATURES),
        IDF(inputCol="tf", outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(rows)


def fit_classifier(
    rows: DataFrame,
    setting: Setting = Setting(),
    features: PipelineModel | None = None,
) -> PipelineModel:
    """Features and logistic regression. With ``features`` given, ``rows`` carry theirs."""
    regression = LogisticRegression(
        family="multinomial", regParam=setting.reg_param, maxIter=setting.max_iter
    )
    if features is None:
        features = fit_features(rows)
        rows = features.transform(rows)
    fitted = regression.fit(rows)
    return PipelineModel([*features.stages, fitted])


def save_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Label and prediction as integers."""
    return model.transform(rows).select(
        F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred")
    )


def select_model(
    train: DataFrame, validation: DataFrame, settings: list[Setting]
) -> tuple[PipelineModel, DataFrame]:
    """Fit every setting and keep the first with the best validation accuracy."""
    features = fit_features(train)
    train = features.transform(train).select("label", "features").persist()
    best, best_accuracy, rows = None, -1.0, []
    for number, setting in enumerate(settings):
        model = fit_classifier(train, setting, features)
        score = accuracy(predict(model, validation)).first()["accuracy"] or 0.0
        if score > best_accuracy:
            best, best_accuracy = model, score
        rows.append((number, setting.reg_param, setting.max_iter, score))
    train.unpersist()
    chosen = next(r[0] for r in rows if r[3] == best_accuracy)
    table = train.sparkSession.createDataFrame(
        [(*r, r[0] == chosen) for r in rows],
        "setting int, reg_param double, max_iter int, accuracy double, best boolean",
    )
    return best, table


def loss_history(model: PipelineModel, train: DataFrame) -> DataFrame:
    """Training loss per iteration, and its running sum from the start of training."""
    losses = model.stages[-1].summary.objectiveHistory
    running, rows = 0.0, []
    for iteration, loss in enumerate(losses):
        running += loss
        rows.append((iteration, float(loss), float(running)))
    return train.sparkSession.createDataFrame(
        rows, "iteration int, loss double, running_loss double"
    )


# --- metrics -------------------------------------------------------------------------


def accuracy(predictions: DataFrame) -> DataFrame:
    right = F.when(F.col("label") == F.col("pred"), 1.0).otherwise(0.0)
    return predictions.agg(
        F.count("*").alias("n"), rounded(F.avg(right)).alias("accuracy")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two means.

    Everything derives from the confusion counts: one row per pair of classes.
    """
    confusion = predictions.groupBy("label", "pred").agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
        ),
        F.struct(
            F.col("pred").alias("class"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    per_class = (
        # The hit is counted on the label side only.
        confusion.select(F.posexplode(sides).alias("side", "s"), hit.alias("hit"))
        .groupBy(F.col("s.class").alias("class"))
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
            F.sum(F.when(F.col("side") == 0, F.col("hit")).otherwise(0)).alias("hits"),
        )
        .withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            _ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
    )
    measures = ["precision", "recall", "f1"]
    support = F.sum("support")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in measures], support.alias("support"))
    weighted = per_class.agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), support).alias(m) for m in measures],
        support.alias("support"),
    )
    overall = per_class.agg(
        *[_ratio(F.sum("hits"), support).alias(m) for m in measures], support.alias("support")
    )

    def named(df: DataFrame, name: Column) -> DataFrame:
        return df.select(name.alias("class"), *[rounded(F.col(m)).alias(m) for m in measures],
                         F.col("support"))

    return (
        named(per_class, F.col("class").cast("string"))
        .unionByName(named(overall, F.lit("accuracy")))
        .unionByName(named(macro, F.lit("macro avg")))
        .unionByName(named(weighted, F.lit("weighted avg")))
    )


# --- routing -------------------------------------------------------------------------


def top_classes(
    df: DataFrame, probabilities: Column, n: int, key: str = "query_id"
) -> DataFrame:
    """The ``n`` most probable classes per row; the smaller class wins a tie.

    Sorted inside the row, so no shuffle is needed.
    """
    ordered = F.array_sort(
        F.transform(
            probabilities,
            lambda p, i: F.struct((-rounded(p)).alias("minus"), i.cast("int").alias("cluster")),
        )
    )
    best = F.slice(ordered, 1, n)
    return df.select(key, F.posexplode(best).alias("pos", "best")).select(
        key,
        (F.col("pos") + 1).alias("rank"),
        F.col("best.cluster").alias("cluster"),
        (-F.col("best.minus") + 0.0).alias("probability"),
    )


def classify_topn(model: PipelineModel, questions: DataFrame, n: int) -> DataFrame:
    """Most probable clusters of every question row ``(query_id, tokens)``."""
    check_cluster_count(n, model.stages[-1].numClasses)
    return top_classes(model.transform(questions), vector_to_array("probability"), n)
