"""One call for every retrieval mode; all give the same ranking columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame

from ..operators import lexical
from ..operators.classify import classify_topn
from ..operators.clustering import Centroids, route
from ..operators.fusion import Ranked, bm25_list, cosine_list, fuse_complete, routed_list
from ..operators.joins import settle

MODES = ("bm25", "cosine", "centroid", "classifier", "rrf")


@dataclass
class Retriever:
    """What the modes need; leave out what the modes in use do not.

    ``corpus``: ``doc_id, vector[, cluster]``. Questions carry ``query_id`` and, by mode,
    a ``vector``, the text that ``question_text`` names, or model ``tokens``.
    """

    corpus: DataFrame | None = None
    index: lexical.LexicalIndex | None = None
    question_text: Column | None = None
    centroids: Centroids | None = None
    classifier: PipelineModel | None = None
    options: dict = field(default_factory=dict)

    def retrieve(
        self,
        mode: str,
        questions: DataFrame,
        k: int,
        n_clusters: int = 3,
        fused: tuple[str, ...] = ("bm25", "cosine"),
        weights: dict[str, float] | None = None,
        pad: bool = True,
    ) -> DataFrame:
        """``pad``: BM25 fills short lists with zero-score documents; never inside a
        fusion, which is that of the complete lists, where a place earns credit.
        """
        if mode == "rrf":
            lists = {m: self.ranked(m, questions, n_clusters) for m in fused}
            return fuse_complete(lists, k, weights)
        if mode == "bm25":
            return lexical.bm25_topk(self.index, questions, self.question_text, k, pad)
        return self.ranked(mode, questions, n_clusters).top(k)

    def ranked(self, mode: str, questions: DataFrame, n_clusters: int = 3) -> Ranked:
        """The complete lists of one mode, read as far as asked for."""
        if mode == "bm25":
            terms = lexical.question_terms(questions, self.question_text)
            return bm25_list(self.index, settle(lexical.weighted_terms(self.index, terms)))
        if mode == "cosine":
            return cosine_list(self.corpus, questions, **self.options)
        if mode == "centroid":
            routed = route(questions, self.centroids, n_clusters)
            return routed_list(self.corpus, routed, **self.options)
        if mode == "classifier":
            routes = classify_topn(self.classifier, questions, n_clusters)
            routed = routes.join(questions.select("query_id", "vector"), "query_id")
            return routed_list(self.corpus, routed, **self.options)
        raise ValueError(f"unknown mode {mode!r}, choose one of {', '.join(MODES)}")
