"""Text to vectors: a hook for any batch model, and hashed TF-IDF built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import missing_vectors

DIMENSIONS = 256

BatchModel = Callable[[list[str]], np.ndarray]


# Letters that :func:`letter_counts` counts.
LETTERS = "aeinorst"


def letter_counts(texts: list[str]) -> np.ndarray:
    """A batch model without learning: how often each of ``LETTERS`` occurs in a text."""
    return np.array([[t.count(c) for c in LETTERS] for t in texts], np.float32).reshape(-1, len(LETTERS))


def text_lengths(texts: list[str]) -> np.ndarray:
    """Another one: the number of characters, in thousands and in ones."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.stack([sizes // 1000 * 1000, sizes % 1000], axis=1).astype(np.float32).reshape(-1, 2)


def embed(df: DataFrame, text: str, model: BatchModel, column: str = "embedding") -> DataFrame:
    """Add the vectors of a batch model: ``model(texts)`` gives one row per text."""
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(model(batch[text].tolist()), dtype=np.float32)
            yield batch.assign(**{column: list(vectors)})

    return df.mapInPandas(run, schema)


def embed_missing(
    store: DataFrame, docs: DataFrame, text: str, name: str, model: BatchModel
) -> DataFrame:
    """Store ``(original_id, model, embedding)`` completed for one model.

    Only documents without a vector of this model are embedded; ``docs`` has
    ``original_id`` and the text.
    """
    lacking = missing_vectors(store, docs.select("original_id", text), name)
    new = embed(lacking, text, model).select(
        "original_id", F.lit(name).alias("model"), "embedding"
    )
    return store.unionByName(new)


def fit_hashed(df: DataFrame, tokens: Column, dimensions: int = DIMENSIONS) -> PipelineModel:
    """Hashed TF-IDF of unit length; the weights come from ``df``."""
    stages = [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.select(tokens.alias("_tokens")))


def embed_hashed(
    model: PipelineModel, df: DataFrame, tokens: Column, column: str = "embedding"
) -> DataFrame:
    vectors = model.transform(df.withColumn("_tokens", tokens))
    return vectors.withColumn(column, vector_to_array("_unit", "float32")).drop(
        "_tokens", "_tf", "_tfidf", "_unit"
    )
