"""Every operator as a query over the given tables.

Roles of the tables: ``documents`` is the text corpus and ``benchmark`` its questions;
``embeddings`` is the vector corpus, every vector is also a question (itself excluded
from the hits) and a hit is relevant when it carries the same label; user turns of
``conversations`` with the assistant's replies form the question-document corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import (
    classify,
    clustering,
    context,
    embedding,
    evaluation,
    fusion,
    kmeans,
    lexical,
    neighbours,
    rings,
    rows,
)
from ..operators.ranking import pad_with_first, top_k
from ..sources import tables
from ..sources.workspace import Workspace
from ..streaming.questions import answer_stream, read_questions
from . import build, increment
from .retrieve import Retriever

TOP_K = 5
MAX_PROBES = 3
K_SWEEP = (1, 3, 5)
PROBE_SWEEP = (1, 2, 3)
FUSION_WEIGHTS = {"cosine": 1.0, "centroid_1": 0.5, "centroid_3": 0.75}
BM25_GRID = [(1.2, 0.5), (1.5, 0.75), (2.0, 1.0)]
SETTINGS = [classify.Setting(0.1, 10), classify.Setting(0.01, 20), classify.Setting(0.001, 20)]


class Inputs:
    """The tables of one folder and what several queries share, built on first use."""

    _known: dict[tuple[str, str], Inputs] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.workspace = Workspace.of(spark, self.folder)

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Inputs:
        key = (spark.sparkContext.applicationId, folder.rstrip("/"))
        if key not in cls._known:
            cls._known[key] = cls(spark, folder)
        return cls._known[key]

    def table(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.folder, name)

    # text corpus
    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def questions(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def index(self) -> lexical.LexicalIndex:
        docs = self.documents.select("doc_id", "text")
        return lexical.build_index(docs, F.col("text"), self.workspace.child("lexical"))

    @cached_property
    def weighted(self) -> DataFrame:
        """Weighted question terms, staged since several queries join them."""
        terms = lexical.question_terms(self.questions, F.col("text"))
        return self.workspace.stage(
            "weighted_terms", lambda: lexical.weighted_terms(self.index, terms)
        )

    def bm25(self, k: int) -> DataFrame:
        """Hits without zero-score documents."""
        return lexical.best_documents(self.index, self.weighted, k)

    def bm25_padded(self, k: int) -> DataFrame:
        return pad_with_first(self.bm25(k), self.questions, self.index.documents, k)

    @cached_property
    def hits(self) -> DataFrame:
        """Top 3 with zero-score documents, staged for the texts that follow."""
        return self.workspace.stage("hits", lambda: self.bm25_padded(3))

    @cached_property
    def bm25_truth(self) -> DataFrame:
        """Documents whose text contains the passage, whatever the index holds.

        Containment implies all indexed terms, so the covering documents are candidates.
        """

        def contained() -> DataFrame:
            texts = self.documents.select("doc_id", F.col("text").alias("_text"))
            return (
                self.bm25_covering.join(self.questions, "query_id")
                .join(texts, "doc_id")
                .where(F.contains("_text", "text"))
                .select("query_id", "doc_id")
            )

        return self.workspace.stage("bm25_truth", contained)

    @cached_property
    def bm25_covering(self) -> DataFrame:
        return self.workspace.stage(
            "bm25_covering", lambda: lexical.covering_documents(self.index, self.weighted)
        )

    # letter counts as a batch embedding of documents and questions
    def letters(self, df: DataFrame, key: str) -> DataFrame:
        return embedding.embed(df.select(key, "text"), "text", embedding.letter_counts, "vector")

    def fused_bm25(self, k: int) -> DataFrame:
        """BM25, without zero-score fillers, and cosine of letter counts in one ranking."""
        corpus = self.workspace.stage("letters", lambda: self.letters(self.documents, "doc_id"))
        asked = self.letters(self.questions, "query_id")
        lists = {
            "bm25": fusion.bm25_list(self.index, self.weighted),
            "cosine": fusion.cosine_list(corpus.select("doc_id", "vector"), asked),
        }
        return fusion.fuse_complete(lists, k)

    # vector corpus
    @property
    def labelled(self) -> DataFrame:
        """``id, vector, cluster`` with the given label as cluster."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("vector"),
            F.col("label").alias("cluster"),
        )

    @property
    def corpus(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")
        )

    @property
    def vector_questions(self) -> DataFrame:
        return self.corpus.withColumnRenamed("doc_id", "query_id")

    @cached_property
    def centroids(self) -> clustering.Centroids:
        return clustering.Centroids.of(
            self.workspace.stage("centroids", lambda: clustering.centroid_means(self.labelled))
        )

    @cached_property
    def cluster_index(self) -> DataFrame:
        """Corpus stored by nearest centroid: ``doc_id, vector, cluster``."""
        assigned = clustering.assign_nearest(self.corpus, self.centroids).drop("d2")
        return clustering.write_by_cluster(assigned, "doc_id", self.workspace, "cluster_index")

    def rings(self, cosine: bool) -> rings.RingIndex:
        """The vector corpus by rings around the centroids of its labels."""
        points = clustering.unit_vectors(self.labelled) if cosine else self.labelled
        name = "rings_cosine" if cosine else "rings_product"
        means = self.workspace.stage(f"{name}_centers", lambda: clustering.centroid_means(points))
        corpus = self.corpus if cosine else clustering.unit_vectors(self.corpus)
        return rings.build_rings(
            corpus, clustering.Centroids.of(means), self.workspace, name, cosine
        )

    def cosine(self, k: int) -> DataFrame:
        return neighbours.exact_topk(self.corpus, self.vector_questions, k, exclude_self=True)

    @cached_property
    def _routes(self) -> DataFrame:
        return self.workspace.stage(
            "routes", lambda: clustering.route(self.vector_questions, self.centroids, MAX_PROBES)
        )

    def routes(self, n: int) -> DataFrame:
        """The ``n`` nearest clusters of every question, read off those of the most probes."""
        return self._routes.where(F.col("route_rank") <= n)

    def routed(self, k: int, n: int) -> DataFrame:
        return neighbours.routed_topk(
            self.cluster_index, self.routes(n), k, exclude_self=True
        )

    def fused(self, k: int, weights: dict[str, float] | None = None) -> DataFrame:
        routed = {
            f"centroid_{n}": fusion.routed_list(self.cluster_index, self.routes(n), exclude_self=True)
            for n in (1, MAX_PROBES)
        }
        cosine = fusion.cosine_list(self.corpus, self.vector_questions, exclude_self=True)
        return fusion.fuse_complete({"cosine": cosine} | routed, k, weights)

    def by_label(self, hits: DataFrame) -> DataFrame:
        labels = self.table("embeddings").select("vec_id", "label")
        return evaluation.relevant_by_label(
            hits,
            labels.withColumnRenamed("vec_id", "query_id"),
            labels.withColumnRenamed("vec_id", "doc_id"),
        )

    def label_report(self, hits: DataFrame, ks: tuple[int, ...] = K_SWEEP) -> DataFrame:
        ranks = evaluation.truth_rank(self.vector_questions, self.by_label(hits))
        return evaluation.report(ranks, ks)

    # documents ordered by length; the number of digits of the length is the cluster,
    # so that some clusters lie wholly in the last tenth
    @cached_property
    def positioned(self) -> DataFrame:
        ordered = self.documents.select(
            "doc_id", "n_chars", F.length(F.col("n_chars").cast("string")).alias("cluster")
        )
        return rows.dense_id(
            ordered, ["n_chars", "doc_id"], self.workspace, "by_length", "position"
        )

    @property
    def split(self) -> DataFrame:
        return rows.split_positional(self.positioned, "position")

    # question-document corpus
    @property
    def pairs(self) -> DataFrame:
        return tables.question_answer_pairs(self.table("conversations"))

    @cached_property
    def built(self):
        return build.build_corpus(self.pairs, self.workspace.child("pairs"))

    @cached_property
    def trained(self):
        return build.train_classifier(self.built, self.workspace.child("pairs"), SETTINGS)

    @property
    def text_rows(self) -> DataFrame:
        """The documents as raw corpus rows, each its own question."""
        return self.documents.select(
            F.format_string("d%019d", "doc_id").alias("id"),
            F.col("text").alias("question"),
            F.array("text").alias("documents"),
            F.lit("documents").alias("dataset_name"),
        )

    @cached_property
    def growing(self) -> increment.GrowingCorpus:
        """Conversations first, then the documents, with two models; each step twice."""
        corpus = increment.GrowingCorpus(self.spark, self.workspace.path("growing"))
        for step in (self.pairs, self.text_rows):
            corpus.ingest(step)
            corpus.ingest(step)
            corpus.embed("letters", embedding.letter_counts)
        corpus.embed("lengths", embedding.text_lengths)
        corpus.embed("letters", embedding.letter_counts)
        return corpus

    def classifier_rows(self) -> DataFrame:
        return classify.training_rows(self.built.rows.where(F.col("split") == rows.TRAIN))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[make.__name__] = lambda spark, folder: make(Inputs.of(spark, folder))
    return make


def _joined(tokens) -> list:
    return [F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens")]


# --- sources and sinks ---------------------------------------------------------------


@query
def union_splits(i: Inputs) -> DataFrame:
    return tables.union_splits(
        {
            "train": i.documents.select("text"),
            "test": i.table("conversations").select("text"),
            "validation": i.table("benchmark").select("text"),
        }
    )


@query
def jsonl_roundtrip(i: Inputs) -> DataFrame:
    path = i.workspace.path("documents_jsonl")
    tables.write_jsonl(i.documents, path)
    return tables.read_jsonl(
        i.spark, path, "doc_id long, text string, lang string, source string, n_chars long"
    )


@query
def append_new_rows(i: Inputs) -> DataFrame:
    path = i.workspace.path("appended")
    tokens = F.size(text.content_tokens(F.col("text"))).alias("n_tokens")
    everything = i.documents.select("doc_id", tokens)
    labelled = everything.join(i.table("labels"), "doc_id", "left_semi")
    for number, batch in enumerate([labelled, everything, everything], start=1):
        tables.append_new_rows(
            i.spark, batch.withColumn("batch", F.lit(number)), path, "doc_id"
        )
    return i.spark.read.parquet(path)


@query
def upsert_vectors(i: Inputs) -> DataFrame:
    given = i.table("embeddings").select(
        F.col("vec_id").alias("original_id"), F.lit("base").alias("model"), "embedding"
    )
    doubled = F.transform("embedding", lambda x: (x * 2).cast("float"))
    known = i.table("labels").select(F.col("doc_id").alias("original_id"))
    store = given.join(known, "original_id", "left_semi").withColumn("embedding", doubled)
    unit = given.select(
        "original_id", F.lit("unit").alias("model"), vectors.normalize(F.col("embedding")).alias("embedding")
    )
    merged = tables.upsert_vectors(store, given.unionByName(unit))
    total = F.aggregate(
        vectors.as_double(F.col("embedding")), F.lit(0.0), lambda acc, x: acc + x
    )
    return merged.select(
        "original_id", "model", F.size("embedding").alias("dims"),
        vectors.rounded(total, 4).alias("total"),
    )


@query
def upsert_written(i: Inputs) -> DataFrame:
    """The same rows as ``upsert_vectors``, from a table replaced by two upserts."""
    given = i.table("embeddings").select(
        F.col("vec_id").alias("original_id"), F.lit("base").alias("model"), "embedding"
    )
    doubled = F.transform("embedding", lambda x: (x * 2).cast("float"))
    known = i.table("labels").select(F.col("doc_id").alias("original_id"))
    first = given.join(known, "original_id", "left_semi").withColumn("embedding", doubled)
    unit = given.select(
        "original_id", F.lit("unit").alias("model"), vectors.normalize(F.col("embedding")).alias("embedding")
    )
    path = i.workspace.path("upserted")
    tables.write_upsert(i.spark, first, path)
    merged = tables.write_upsert(i.spark, given.unionByName(unit).unionByName(unit), path)
    total = F.aggregate(
        vectors.as_double(F.col("embedding")), F.lit(0.0), lambda acc, x: acc + x
    )
    return merged.select(
        "original_id", "model", F.size("embedding").alias("dims"),
        vectors.rounded(total, 4).alias("total"),
    )


@query
def vectors_by_model(i: Inputs) -> DataFrame:
    raw = i.table("embeddings").select("vec_id", F.lit("raw").alias("model"), "embedding")
    unit = raw.select(
        "vec_id", F.lit("unit").alias("model"), vectors.normalize(F.col("embedding")).alias("embedding")
    )
    store = i.workspace.stage(
        "vector_store", lambda: raw.unionByName(unit), partition_by="model"
    )
    return _components(tables.vectors_of(store, "unit"), "vec_id", "embedding")


def _components(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vectors.as_double(F.col(vector))).alias("pos", "v")).select(
        key, "pos", vectors.rounded(F.col("v")).alias("value")
    )


@query
def build_again(i: Inputs) -> DataFrame:
    """A corpus built in two steps: numbers, lengths and vectors as of one build."""
    corpus = i.growing
    lengths = corpus.index().documents.select(F.col("doc_id").alias("id"), "doc_len")
    total = F.aggregate(vectors.as_double(F.col("embedding")), F.lit(0.0), lambda acc, x: acc + x)
    made = corpus.vectors().groupBy("original_id").pivot("model", ["letters", "lengths"]).agg(F.sum(total.cast("long")))
    found = corpus.rows().join(lengths, "id").join(made, "original_id", "left")
    return found.select("id", "original_id", "dataset_name", "doc_len", "letters", F.col("lengths").alias("chars"))


@query
def terms_again(i: Inputs) -> DataFrame:
    """Collection counts and document frequencies of the same corpus, from its deltas."""
    return i.growing.index().vocabulary


# --- projections, filters, dedup, ids ------------------------------------------------


@query
def dedup_first(i: Inputs) -> DataFrame:
    return rows.dedup_first(i.documents, "text", "doc_id").select("doc_id", "lang", "source")


@query
def first_chunk(i: Inputs) -> DataFrame:
    return i.pairs.select("id", text.first_chunk(F.col("documents")).alias("chunk"))


@query
def dense_id(i: Inputs) -> DataFrame:
    return i.positioned.select("doc_id", "n_chars", "position")


@query
def filter_clusters(i: Inputs) -> DataFrame:
    return i.labelled.where(F.col("cluster").isin(0, 3, 7)).select("id", "cluster")


# --- text ----------------------------------------------------------------------------


@query
def tokenize(i: Inputs) -> DataFrame:
    return i.documents.select("doc_id", *_joined(text.tokenize(F.col("text"))))


@query
def drop_stopwords(i: Inputs) -> DataFrame:
    tokens = text.drop_stop_words(text.tokenize(F.col("text")))
    return i.documents.select("doc_id", *_joined(tokens))


@query
def drop_punct(i: Inputs) -> DataFrame:
    tokens = text.drop_punctuation(text.tokenize(F.col("text")))
    return i.documents.select("doc_id", *_joined(tokens))


@query
def tokenize_questions(i: Inputs) -> DataFrame:
    return i.questions.select("query_id", *_joined(text.content_tokens(F.col("text"))))


@query
def term_counts(i: Inputs) -> DataFrame:
    return lexical.term_counts(lexical.token_rows(i.documents, F.col("text")))


@query
def prune_rare_terms(i: Inputs) -> DataFrame:
    kept = lexical.prune_rare_terms(i.documents, F.col("text"))
    return kept.select("doc_id", *_joined(F.col("tokens")))


@query
def concat_features(i: Inputs) -> DataFrame:
    both = text.question_with_chunk(F.col("question"), F.col("documents"))
    return i.pairs.select("id", both.alias("text"))


@query
def truncate_tokens(i: Inputs) -> DataFrame:
    return i.documents.select("doc_id", *_joined(text.truncate_tokens(F.col("text"))))


@query
def preview(i: Inputs) -> DataFrame:
    found = context.with_texts(i.hits.drop("score"), i.documents.select("doc_id", "text"))
    return found.select(
        "query_id", "rank", "doc_id", text.preview(F.col("text")).alias("preview")
    )


# --- BM25 ----------------------------------------------------------------------------


@query
def doc_length(i: Inputs) -> DataFrame:
    return i.index.documents.select("doc_id", "doc_len")


@query
def corpus_stats(i: Inputs) -> DataFrame:
    return i.index.documents.agg(
        F.count("*").alias("n_docs"),
        vectors.rounded(F.avg("doc_len")).alias("avg_doc_len"),
    )


@query
def postings(i: Inputs) -> DataFrame:
    return lexical.pruned_postings(i.index)


@query
def doc_freq(i: Inputs) -> DataFrame:
    return lexical.pruned_postings(i.index).groupBy("term").agg(F.count("*").alias("df"))


@query
def idf(i: Inputs) -> DataFrame:
    value = lexical.idf(F.col("df"), i.index.n_docs)
    return i.index.vocabulary.select("term", "df", vectors.rounded(value).alias("idf"))


@query
def bm25_scores(i: Inputs) -> DataFrame:
    return lexical.score_pairs(i.index, i.weighted, i.bm25_covering)


@query
def bm25_topk(i: Inputs) -> DataFrame:
    return i.bm25(TOP_K)


@query
def bm25_topk_padded(i: Inputs) -> DataFrame:
    return i.bm25_padded(TOP_K)


@query
def bm25_param_grid(i: Inputs) -> DataFrame:
    scored = lexical.score_grid(i.index, i.weighted, BM25_GRID)
    return top_k(scored, 3, ("k1", "b", "query_id"))


# --- vectors -------------------------------------------------------------------------


def _with_centroid(i: Inputs) -> DataFrame:
    """Every vector beside the mean vector of its label (one row per label)."""
    means = i.centroids.table(i.spark)
    return i.labelled.join(F.broadcast(means), "cluster")


@query
def vec_dot(i: Inputs) -> DataFrame:
    value = vectors.dot(F.col("vector"), F.col("centroid"))
    return _with_centroid(i).select("id", vectors.rounded(value).alias("dot"))


@query
def vec_norm(i: Inputs) -> DataFrame:
    return _with_centroid(i).select(
        "id",
        vectors.rounded(vectors.norm(F.col("vector"))).alias("norm"),
        vectors.rounded(vectors.norm(F.col("centroid"))).alias("centroid_norm"),
    )


@query
def vec_cosine(i: Inputs) -> DataFrame:
    value = vectors.cosine(F.col("vector"), F.col("centroid"))
    return _with_centroid(i).select("id", vectors.rounded(value).alias("cosine"))


@query
def vec_normalize(i: Inputs) -> DataFrame:
    unit = i.corpus.select("doc_id", vectors.normalize(F.col("vector")).alias("unit"))
    return _components(unit, "doc_id", "unit")


@query
def vec_dim(i: Inputs) -> DataFrame:
    return i.corpus.agg(
        F.min(F.size("vector")).alias("dim"),
        F.count_distinct(F.size("vector")).alias("n_dims"),
    )


@query
def ip_topk(i: Inputs) -> DataFrame:
    unit = clustering.unit_vectors(i.corpus)
    return neighbours.exact_topk(
        unit, unit.withColumnRenamed("doc_id", "query_id"), TOP_K, cosine=False, exclude_self=True
    )


@query
def cosine_topk_one(i: Inputs) -> DataFrame:
    """The question is the mean of all vectors, one literal for the scan."""
    mean = clustering.centroid_means(i.labelled.withColumn("cluster", F.lit(0))).first()
    question = F.lit(mean["centroid"])
    score = vectors.rounded(vectors.cosine(F.col("vector"), question))
    return neighbours.topk_for_one(i.corpus, score, TOP_K)


@query
def cosine_topk_batch(i: Inputs) -> DataFrame:
    return i.cosine(TOP_K)


@query
def cosine_topk_rings(i: Inputs) -> DataFrame:
    return rings.ring_topk(i.rings(True), i.vector_questions, TOP_K, exclude_self=True).hits


@query
def ip_topk_rings(i: Inputs) -> DataFrame:
    asked = clustering.unit_vectors(i.corpus).withColumnRenamed("doc_id", "query_id")
    return rings.ring_topk(i.rings(False), asked, TOP_K, exclude_self=True).hits


@query
def rings_compared(i: Inputs) -> DataFrame:
    """Mean number of rings a question reads, and mean share of the corpus in them."""
    index = i.rings(True)
    found = rings.ring_topk(index, i.vector_questions, TOP_K, exclude_self=True)
    return found.compared.agg(
        F.count("*").alias("questions"),
        vectors.rounded(F.avg("n_rings")).alias("mean_rings"),
        vectors.rounded(F.avg("compared") / float(max(1, index.sizes.sum()))).alias("share"),
    )


@query
def embed_hashed(i: Inputs) -> DataFrame:
    tokens = text.content_tokens(F.col("text"))
    model = embedding.fit_hashed(i.documents, tokens)
    embedded = embedding.embed_hashed(model, i.documents.select("doc_id", "text"), tokens)
    return embedded.select(
        "doc_id",
        F.size("embedding").alias("dims"),
        vectors.rounded(vectors.norm(F.col("embedding"))).alias("norm"),
    )


@query
def embed_batch(i: Inputs) -> DataFrame:
    """The embedding hook with a batch function that SQL can repeat."""
    return _components(i.letters(i.documents, "doc_id"), "doc_id", "vector")


# --- clustering ----------------------------------------------------------------------


def _assigned(df: DataFrame, centroids: clustering.Centroids) -> DataFrame:
    return clustering.assign_nearest(df, centroids).select("id", "cluster", "d2")


@query
def kmeans_assign(i: Inputs) -> DataFrame:
    points = i.labelled.drop("cluster")
    return _assigned(points, clustering.Centroids.of_fit(kmeans.fit(points, 4)))


@query
def kmeans_norm_assign(i: Inputs) -> DataFrame:
    points = clustering.unit_vectors(i.labelled.drop("cluster"))
    return _assigned(points, clustering.Centroids.of_fit(kmeans.fit(points, 4, max_iter=20)))


@query
def kmeans_rounds(i: Inputs) -> DataFrame:
    """Inertia of every round of a fit, from the seeds to the end."""
    history = kmeans.fit(i.labelled.drop("cluster"), 4).history(i.spark)
    return history.select("round", vectors.rounded(F.col("inertia"), 4).alias("inertia"))


@query
def assign_nearest(i: Inputs) -> DataFrame:
    return _assigned(i.labelled.drop("cluster"), i.centroids)


@query
def centroid_means(i: Inputs) -> DataFrame:
    return _components(clustering.centroid_means(i.labelled), "cluster", "centroid")


@query
def lloyd_step(i: Inputs) -> DataFrame:
    moved = clustering.lloyd_step(i.labelled.drop("cluster"), i.centroids)
    return _components(moved, "cluster", "centroid")


@query
def inertia(i: Inputs) -> DataFrame:
    return clustering.inertia(i.labelled.drop("cluster"), i.centroids)


@query
def silhouette_exact(i: Inputs) -> DataFrame:
    measured = clustering.silhouette_rows(i.labelled)
    mean = vectors.rounded(F.avg("silhouette")).alias("silhouette")
    # The row of cluster -1 is the score of the whole clustering.
    return (
        measured.withColumn("cluster", F.explode(F.array(F.col("cluster"), F.lit(-1))))
        .groupBy("cluster")
        .agg(F.count("*").alias("n"), mean)
    )


@query
def silhouette_compared(i: Inputs) -> DataFrame:
    """Mean number of rows that the exact silhouette compares a row with, and the share."""
    parts = clustering.silhouette_parts(i.labelled)
    rows_compared = F.avg("compared")
    return parts.agg(
        F.count("*").alias("n"),
        vectors.rounded(rows_compared).alias("rows_compared"),
        vectors.rounded(rows_compared / F.count("*")).alias("share"),
    )


@query
def silhouette_ml(i: Inputs) -> DataFrame:
    score = clustering.silhouette_squared(i.labelled)
    return i.labelled.agg(
        F.count("*").alias("n"), vectors.rounded(F.lit(score)).alias("silhouette")
    )


@query
def sweep_k(i: Inputs) -> DataFrame:
    swept = clustering.sweep_k(i.labelled.drop("cluster"), range(2, 6))
    return swept.select(
        "k",
        vectors.rounded(F.col("inertia"), 4).alias("inertia"),
        vectors.rounded(F.col("silhouette")).alias("silhouette"),
        "best",
    )


@query
def cluster_sizes(i: Inputs) -> DataFrame:
    return clustering.cluster_sizes(i.labelled)


@query
def project_2d(i: Inputs) -> DataFrame:
    return clustering.project_2d(i.labelled)


# --- splits and classifier -----------------------------------------------------------


@query
def split_positional(i: Inputs) -> DataFrame:
    return i.split.select("doc_id", "position", "split")


@query
def missing_clusters(i: Inputs) -> DataFrame:
    return rows.missing_clusters(i.split, "position")


@query
def split_covered(i: Inputs) -> DataFrame:
    return rows.cover_clusters(i.split, "position").select("doc_id", "cluster", "split")


@query
def split_hashed(i: Inputs) -> DataFrame:
    return rows.split_hashed(i.documents.select("doc_id"), "doc_id")


@query
def class_count(i: Inputs) -> DataFrame:
    return classify.class_count(i.labelled)


@query
def train_classifier(i: Inputs) -> DataFrame:
    model, _ = i.trained
    test = classify.training_rows(i.built.rows.where(F.col("split") == rows.TEST))
    return classify.accuracy(classify.predict(model, test))


@query
def model_selection(i: Inputs) -> DataFrame:
    return i.trained[1]


@query
def loss_history(i: Inputs) -> DataFrame:
    train = i.classifier_rows()
    return classify.loss_history(classify.fit_classifier(train), train)


@query
def train_epochs(i: Inputs) -> DataFrame:
    """Loss and validation accuracy of every epoch, and where the weights were kept."""
    return build.train_epochs(i.built, i.workspace.child("pairs")).history(i.spark)


def _label_predictions(i: Inputs) -> DataFrame:
    points = i.labelled.withColumnRenamed("cluster", "label")
    return clustering.assign_nearest(points, i.centroids).select(
        "label", F.col("cluster").alias("pred")
    )


@query
def accuracy(i: Inputs) -> DataFrame:
    return classify.accuracy(_label_predictions(i))


@query
def classification_report(i: Inputs) -> DataFrame:
    return classify.classification_report(_label_predictions(i))


@query
def softmax_topn(i: Inputs) -> DataFrame:
    """Logits are minus the squared distance to each centroid."""
    nearest = i.centroids.nearest(F.col("vector"), len(i.centroids.clusters))
    ordered = i.corpus.select("doc_id", F.array_sort(nearest).alias("found"))
    logits = F.transform("found", lambda x: -x["d2"])
    return classify.top_classes(ordered, vectors.softmax(logits), MAX_PROBES, "doc_id")


@query
def classify_topn(i: Inputs) -> DataFrame:
    return classify.classify_topn(i.trained[0], i.built.questions(), 2)


# --- routed retrieval and fusion -----------------------------------------------------


@query
def routed_classifier_topk(i: Inputs) -> DataFrame:
    retriever = Retriever(corpus=i.built.documents(), classifier=i.trained[0])
    return retriever.retrieve("classifier", i.built.questions(rows.TEST), TOP_K, n_clusters=2)


@query
def route_centroids(i: Inputs) -> DataFrame:
    return i.routes(MAX_PROBES).drop("vector")


@query
def index_by_cluster(i: Inputs) -> DataFrame:
    return i.cluster_index.select("doc_id", "cluster")


@query
def topk_per_cluster(i: Inputs) -> DataFrame:
    return neighbours.topk_per_cluster(
        i.cluster_index, i.routes(MAX_PROBES), TOP_K, exclude_self=True
    ).select("query_id", "cluster", "rank", "doc_id", "score")


@query
def routed_centroid_topk(i: Inputs) -> DataFrame:
    return i.routed(TOP_K, MAX_PROBES)


@query
def search_space_share(i: Inputs) -> DataFrame:
    """Mean share of the corpus that a question scans when probing 1, 2, 3 clusters."""
    sizes = clustering.cluster_sizes(i.cluster_index).select("cluster", "n")
    total = float(i.cluster_index.count())
    n_questions = float(i.vector_questions.count())
    # Routes are first counted per cluster, so the join is between tiny tables.
    probed = (
        evaluation.expand(i.routes(MAX_PROBES), "n_clusters", PROBE_SWEEP)
        .where(F.col("route_rank") <= F.col("n_clusters"))
        .groupBy("n_clusters", "cluster")
        .agg(F.count("*").alias("times"))
    )
    scanned = F.sum(F.col("times") * F.col("n")) / F.lit(n_questions) / F.lit(total)
    return probed.join(F.broadcast(sizes), "cluster").groupBy("n_clusters").agg(
        vectors.rounded(scanned).alias("share")
    )


@query
def rrf_fusion(i: Inputs) -> DataFrame:
    return i.fused(TOP_K)


@query
def rrf_weighted(i: Inputs) -> DataFrame:
    return i.fused(TOP_K, FUSION_WEIGHTS)


@query
def rrf_bm25_cosine(i: Inputs) -> DataFrame:
    return i.fused_bm25(TOP_K)


@query
def routed_kmeans_topk(i: Inputs) -> DataFrame:
    """Centroid mode on clusters fitted to the normalized vectors, not on given labels."""
    points = clustering.unit_vectors(i.labelled.drop("cluster"))
    centroids = clustering.Centroids.of_model(clustering.fit_kmeans(points, 4, max_iter=20))
    units = points.select(F.col("id").alias("doc_id"), "vector")
    stored = clustering.write_by_cluster(
        clustering.assign_nearest(units, centroids).drop("d2"), "doc_id", i.workspace, "kmeans_index"
    )
    asked = units.withColumnRenamed("doc_id", "query_id")
    routed = clustering.route(asked, centroids, MAX_PROBES)
    return neighbours.routed_topk(stored, routed, TOP_K, exclude_self=True)


@query
def retrieve_all_modes(i: Inputs) -> DataFrame:
    by_text = Retriever(index=i.index, question_text=F.col("text"))
    by_vector = Retriever(
        corpus=i.cluster_index, centroids=i.centroids, options={"exclude_self": True}
    )
    asked = {
        "bm25": by_text.retrieve("bm25", i.questions, 3),
        "cosine": by_vector.retrieve("cosine", i.vector_questions, 3),
        "centroid": by_vector.retrieve("centroid", i.vector_questions, 3, n_clusters=2),
        "rrf": by_vector.retrieve(
            "rrf", i.vector_questions, 3, n_clusters=2, fused=("cosine", "centroid")
        ),
    }
    return tables.union_splits(asked, "mode")


# --- evaluation ----------------------------------------------------------------------


def _bm25_ranks(i: Inputs) -> DataFrame:
    hits = i.bm25_padded(TOP_K)
    return evaluation.truth_rank(
        i.questions, evaluation.relevant_by_pairs(hits, i.bm25_truth)
    )


@query
def truth_rank(i: Inputs) -> DataFrame:
    return _bm25_ranks(i)


@query
def success_at_k(i: Inputs) -> DataFrame:
    return i.label_report(i.cosine(TOP_K)).select("k", "success")


@query
def mrr_at_k(i: Inputs) -> DataFrame:
    return i.label_report(i.cosine(TOP_K)).select("k", "mrr")


@query
def eval_bm25(i: Inputs) -> DataFrame:
    return evaluation.report(_bm25_ranks(i), K_SWEEP)


@query
def eval_cosine(i: Inputs) -> DataFrame:
    return i.label_report(i.cosine(TOP_K))


@query
def eval_routed(i: Inputs) -> DataFrame:
    return i.label_report(i.routed(TOP_K, 2))


@query
def eval_rrf(i: Inputs) -> DataFrame:
    return i.label_report(i.fused(TOP_K, FUSION_WEIGHTS))


@query
def eval_rrf_bm25(i: Inputs) -> DataFrame:
    hits = i.fused_bm25(TOP_K)
    ranks = evaluation.truth_rank(i.questions, evaluation.relevant_by_pairs(hits, i.bm25_truth))
    return evaluation.report(ranks, K_SWEEP)


@query
def eval_grid(i: Inputs) -> DataFrame:
    """Mode x number of clusters x k. Each mode ranks once, for the largest k and the
    most clusters; smaller settings are read off those rows."""
    questions = i.vector_questions.select("query_id")
    routes = i.routes(MAX_PROBES).select("query_id", "cluster", "route_rank")
    per_cluster = neighbours.topk_per_cluster(
        i.cluster_index, i.routes(MAX_PROBES), TOP_K, exclude_self=True
    ).drop("rank")
    probed = evaluation.expand(
        per_cluster.join(routes, ["query_id", "cluster"]), "n_clusters", PROBE_SWEEP
    ).where(F.col("route_rank") <= F.col("n_clusters"))
    routed = top_k(probed, TOP_K, ("n_clusters", "query_id"))
    columns = ["n_clusters", "query_id", "doc_id", "rank"]
    # No clusters are probed by the exact search; it goes under 0.
    exact = i.cosine(TOP_K).withColumn("n_clusters", F.lit(0))
    hits = routed.select(*columns).unionByName(exact.select(*columns))
    asked = evaluation.expand(questions, "n_clusters", (0, *PROBE_SWEEP))
    ranks = evaluation.truth_rank(asked, i.by_label(hits), ("n_clusters",))
    by_vector = evaluation.report(ranks, K_SWEEP, ("n_clusters",)).withColumn(
        "mode", F.when(F.col("n_clusters") == 0, "cosine").otherwise("centroid")
    )
    by_text = eval_bm25(i).withColumn("n_clusters", F.lit(0)).withColumn("mode", F.lit("bm25"))
    return by_vector.unionByName(by_text)


def _pair_report(i: Inputs, hits: DataFrame, split: str | None = None) -> DataFrame:
    """The true document of a question is the one of its own row."""
    asked = i.built.rows if split is None else i.built.rows.where(F.col("split") == split)
    own = asked.select(F.col("id").alias("query_id"))
    truth = own.withColumn("doc_id", F.col("query_id"))
    ranks = evaluation.truth_rank(own, evaluation.relevant_by_pairs(hits, truth))
    return evaluation.report(ranks, K_SWEEP)


@query
def eval_bm25_pairs(i: Inputs) -> DataFrame:
    """All questions of the question-document corpus."""
    asked = i.built.rows.select(F.col("id").alias("query_id"), "question")
    hits = lexical.bm25_topk(i.built.index, asked, F.col("question"), TOP_K)
    return _pair_report(i, hits)


@query
def eval_hashed_pairs(i: Inputs) -> DataFrame:
    retriever = Retriever(corpus=i.built.documents())
    return _pair_report(i, retriever.retrieve("cosine", i.built.questions(), TOP_K))


@query
def eval_routed_classifier(i: Inputs) -> DataFrame:
    """The test split only: the classifier has seen the rest."""
    return _pair_report(i, routed_classifier_topk(i), rows.TEST)


@query
def eval_classifier_grid(i: Inputs) -> DataFrame:
    """Number of clusters x k, classifier-routed; the test split only."""
    model, _ = i.trained
    retriever = Retriever(corpus=i.built.documents(), classifier=model)
    asked = i.built.questions(rows.TEST)
    reports = [
        _pair_report(i, retriever.retrieve("classifier", asked, TOP_K, n_clusters=n), rows.TEST)
        .withColumn("n_clusters", F.lit(n))
        for n in PROBE_SWEEP
    ]
    return reduce(DataFrame.unionByName, reports)


# --- context and streaming -----------------------------------------------------------


def _contexts(i: Inputs) -> DataFrame:
    return context.build_context(i.hits, i.documents.select("doc_id", "text"))


@query
def build_context(i: Inputs) -> DataFrame:
    return _contexts(i)


@query
def build_prompts(i: Inputs) -> DataFrame:
    prompts = context.build_prompts(_contexts(i), i.questions)
    return prompts.select(
        "query_id",
        F.col("messages")[0]["role"].alias("first_role"),
        F.col("messages")[0]["content"].alias("first_content"),
        F.col("messages")[1]["role"].alias("second_role"),
        F.col("messages")[1]["content"].alias("second_content"),
    )


@query
def stream_questions(i: Inputs) -> DataFrame:
    """The questions arrive as files, four micro-batches; each question is answered once."""
    folder, sink = i.workspace.path("arriving"), i.workspace.path("answers")
    arriving = i.workspace.stage("arriving", lambda: i.questions.repartition(4, "query_id"))
    stream = read_questions(i.spark, folder, "query_id long, text string", files_per_batch=1)
    retriever = Retriever(index=i.index, question_text=F.col("text"))
    answer_stream(
        stream.select(*arriving.columns),
        lambda batch: retriever.retrieve("bm25", batch, TOP_K),
        sink,
        i.workspace.path("answers_checkpoint"),
    ).awaitTermination()
    return i.spark.read.parquet(sink).select("query_id", "rank", "doc_id", "score")
