"""Preprocessing of a question-document corpus into staged, reusable tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens, first_chunk, joined_chunks, tokenize
from ..operators import classify, epochs
from ..operators.clustering import Centroids, assign_nearest, fit_kmeans
from ..operators.embedding import DIMENSIONS, embed_hashed, fit_hashed
from ..operators.lexical import LexicalIndex, build_index, prune_rare_terms
from ..operators.rows import (
    TEST,
    TRAIN,
    cover_clusters,
    dedup_first,
    dense_id,
    split_hashed,
    split_positional,
)
from ..sources.workspace import Workspace, fingerprint

def chunk_text(chunks: str) -> Column:
    """Text of a document: ``all`` its chunks, or the ``first``."""
    if chunks not in ("all", "first"):
        raise ValueError(f"chunks is 'all' or 'first', not {chunks!r}")
    documents = F.col("documents")
    return joined_chunks(documents) if chunks == "all" else first_chunk(documents)


def _stored(*more: str) -> list[str]:
    """Columns that every stored corpus table has, and its own."""
    shared = ["id", "original_id", "dataset_name", "question", "documents AS chunk"]
    return [*shared, *more]


@dataclass(frozen=True)
class Corpus:
    """``rows``: id, original_id, dataset_name, question, documents, embedding, cluster,
    split. ``model`` turns tokens into the same vector space, for questions."""

    rows: DataFrame
    model: PipelineModel
    workspace: Workspace
    chunks: str = "all"

    @cached_property
    def index(self) -> LexicalIndex:
        """BM25 index of the documents' texts."""
        docs = self.rows.select(
            F.col("id").alias("doc_id"), chunk_text(self.chunks).alias("text")
        )
        return build_index(docs, F.col("text"), self.workspace.child("lexical"))

    def tokenized(self) -> DataFrame:
        """Corpus with its pruned tokens, in the columns of ``TOKENIZED_SCHEMA``."""
        docs = self.rows.select(
            F.col("id").alias("doc_id"), chunk_text(self.chunks).alias("text")
        )
        kept = prune_rare_terms(docs, F.col("text")).withColumnRenamed("doc_id", "id")
        return self.rows.join(kept, "id").selectExpr(*_stored("tokens AS tokenized_chunk"))

    def vectors(self, model: str) -> DataFrame:
        """Corpus with its vectors, in the columns of ``VECTOR_SCHEMA``."""
        named = self.rows.withColumn("model", F.lit(model))
        return named.selectExpr(*_stored("model", "embedding"))

    def documents(self) -> DataFrame:
        return self.rows.select(
            F.col("id").alias("doc_id"), F.col("embedding").alias("vector"), "cluster"
        )

    def questions(self, split: str | None = None) -> DataFrame:
        """Question rows with vector and model tokens; all, or one split."""
        rows = self.rows if split is None else self.rows.where(F.col("split") == split)
        asked = rows.select(F.col("id").alias("query_id"), "question")
        embedded = embed_hashed(
            self.model, asked, content_tokens(F.col("question")), "vector"
        )
        return embedded.withColumn("tokens", tokenize(F.col("question")))


def build_corpus(
    raw: DataFrame,
    workspace: Workspace,
    n_clusters: int = 4,
    dimensions: int = DIMENSIONS,
    seed: int = 0,
    chunks: str = "all",
) -> Corpus:
    """Dedup by question, number, embed, cluster and split ``raw`` (id, question,
    documents, dataset_name). ``chunks``: embed and index ``all`` texts of a document, or
    the ``first``.

    Finished stages are not built again; they lie in a folder named after the input and
    all parameters, so another input or setting never finds them.
    """
    workspace = workspace.child(fingerprint(raw, n_clusters, dimensions, seed, chunks))
    numbered = workspace.stage(
        "numbered",
        lambda: dense_id(
            dedup_first(raw, "question", "id").withColumnRenamed("id", "original_id"),
            ["original_id"],
            workspace,
            "placed",
        ),
    )
    tokens = content_tokens(chunk_text(chunks))
    model_path = workspace.path("embedder")
    if not workspace.has("vectors"):
        fit_hashed(numbered, tokens, dimensions).write().overwrite().save(model_path)
    model = PipelineModel.load(model_path)
    vectors = workspace.stage("vectors", lambda: embed_hashed(model, numbered, tokens))

    def clustered() -> DataFrame:
        rows = vectors.withColumn("vector", F.col("embedding"))
        fitted = fit_kmeans(rows, n_clusters, seed)
        labelled = assign_nearest(rows, Centroids.of_model(fitted)).drop("vector", "d2")
        return labelled

    labelled = workspace.stage("clustered", clustered)
    rows = workspace.stage(
        "split", lambda: cover_clusters(split_positional(labelled, "id"), "id")
    )
    return Corpus(rows, model, workspace, chunks)


def train_classifier(
    corpus: Corpus, workspace: Workspace, settings: list[classify.Setting]
) -> tuple[PipelineModel, DataFrame]:
    """Select a classifier on the training split, by a 90/10 validation inside it, and
    save it. Returns the saved model and the table of candidates."""
    workspace = workspace.child(fingerprint(corpus.rows, *settings))
    path = workspace.path("classifier")
    if not workspace.has("candidates"):  # written last
        train = corpus.rows.where(F.col("split") == TRAIN).drop("split")
        parts = split_hashed(train, "id")
        best, table = classify.select_model(
            classify.training_rows(parts.where(F.col("split") == TRAIN)),
            classify.training_rows(parts.where(F.col("split") == TEST)),
            settings,
        )
        classify.save_classifier(best, path)
        table.write.mode("overwrite").parquet(workspace.path("candidates"))
    candidates = workspace.spark.read.parquet(workspace.path("candidates"))
    return classify.load_classifier(path), candidates


def train_epochs(
    corpus: Corpus, workspace: Workspace, schedule: epochs.Schedule = epochs.Schedule()
) -> epochs.Trained:
    """Train on the training split by epochs, with the same validation inside it."""
    workspace = workspace.child(fingerprint(corpus.rows, schedule))
    train = corpus.rows.where(F.col("split") == TRAIN).drop("split")
    parts = split_hashed(train, "id")
    tokens = classify.training_rows(parts.where(F.col("split") == TRAIN))
    features = classify.fit_features(tokens)
    asked = classify.training_rows(parts.where(F.col("split") == TEST))
    classes = classify.class_count(corpus.rows).first()["n_classes"]
    return epochs.train(
        epochs.sparse_rows(features.transform(tokens)),
        workspace.stage("validation", lambda: epochs.sparse_rows(features.transform(asked))),
        classify.FEATURES,
        classes,
        workspace,
        "batches",
        schedule,
    )
