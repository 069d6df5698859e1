"""BM25: term statistics, the staged index, scoring and top-k."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drop_stop_words, is_stop_word, words
from ..functions.vectors import SCORE_DIGITS, rounded
from ..sources.tables import file_bytes, text_bytes
from ..sources.workspace import Workspace, bucket_count, fingerprint
from . import blockmax
from .joins import fits, is_stored, keep_matching, settle, settle_alone
from .ranking import pad_with_first, ranking

K1, B = 1.5, 0.75

# Text of one bucket: the postings counted from it stay below a task's memory.
BUCKET_BYTES = 16 << 20
# Question terms up to this many rows, with texts of so many bytes, travel to every task.
MAX_BROADCAST_TERMS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
# Up to this many rows, the terms are also written into the scan of the postings.
MAX_LITERAL_TERMS = 1_000
# Up to this many question terms, tasks score packed blocks question by question.
BLOCK_TERMS = 200_000
# Passes over the blocks, each with the terms of some questions, whose results are counted
# together (places); with more, matches are shuffled.
MAX_PASSES = 64
# Passes of a top-k that run at once: what they shuffle goes before the next ones begin.
ROUND_PASSES = 8
# Parts of a question's documents where its terms are too many to broadcast.
QUESTION_SALTS = 16
# Matches (postings of question terms) one task sums up at most; with more, terms that
# cannot decide a top-k are left out of the first pass.
MATCHES_PER_TASK = 50_000_000
# In a shuffled match both sides of a term are split, so that one join key pairs about
# this many postings with this many questions ...
POSTINGS_PER_SALT = 200_000
QUESTIONS_PER_SALT = 1_000
# ... or more, where that would mean more split terms than this (they are broadcast).
MAX_SPLIT_TERMS = 100_000
# Rarest terms of a question that set the floor of its top-k, and the room left for
# rounding when scores are compared with it.
FLOOR_TERMS = 4
FLOOR_SLACK = 2e-6


# --- term tables ---------------------------------------------------------------------


def token_rows(docs: DataFrame, text: Column) -> DataFrame:
    """One row per content token. Stop words are dropped after the split into rows,
    where the test is compiled code over a hash set."""
    exploded = docs.select("doc_id", F.explode(words(text)).alias("term"))
    return exploded.where(~is_stop_word(F.col("term")))


def postings(docs: DataFrame, text: Column) -> DataFrame:
    """Term frequency per document; no shuffle when ``docs`` is partitioned by doc_id."""
    return token_rows(docs, text).groupBy("doc_id", "term").agg(F.count("*").alias("f"))


def term_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term").agg(F.count("*").alias("cf"))


def vocabulary(raw: DataFrame) -> DataFrame:
    """Collection and document frequency per term, and the first document with it."""
    return raw.groupBy("term").agg(
        F.sum("f").alias("cf"),
        F.count("*").alias("df"),
        F.min("doc_id").alias("first_doc"),
    )


def rare_postings(terms: DataFrame) -> DataFrame:
    """Postings of terms that occur once in the whole collection.

    Such a term has exactly one document, already known from the vocabulary, so rare
    terms are found and removed by document and no frequent term becomes a join key.
    """
    return terms.where(F.col("cf") == 1).select(F.col("first_doc").alias("doc_id"), "term")


def prune_rare_terms(docs: DataFrame, text: Column) -> DataFrame:
    """``doc_id, tokens`` without the terms that occur once; order and repeats kept.

    A term that occurs once has one document and one position, and both fall out of
    the counting. What is left is done inside each document's row, in linear time; the
    shuffle to get there moves texts, which are smaller than their tokens.
    """
    placed = docs.select("doc_id", F.posexplode(words(text)).alias("pos", "term"))
    once = (
        placed.where(~is_stop_word(F.col("term")))
        .groupBy("term")
        .agg(F.count("*").alias("cf"), F.min("doc_id").alias("doc_id"), F.min("pos").alias("pos"))
        .where(F.col("cf") == 1)
    )
    # At most one entry per word of the document.
    rare = once.groupBy("doc_id").agg(F.collect_list("pos").alias("rare"))
    rows = (
        docs.select("doc_id", text.alias("_text"))
        .repartition("doc_id")
        .select("doc_id", words(F.col("_text")).alias("words"))
        .join(rare, "doc_id", "left")
    )
    positions = F.transform("words", lambda _, i: i)
    kept = F.array_except(positions, F.coalesce("rare", F.array().cast("array<int>")))
    tokens = F.transform(kept, lambda i: F.get(F.col("words"), i))
    return rows.select("doc_id", drop_stop_words(tokens).alias("tokens"))


def idf(df: Column, n_docs: int) -> Column:
    return F.log(1 + (F.lit(float(n_docs)) - df + 0.5) / (df + 0.5))


# --- the index -----------------------------------------------------------------------


@dataclass(frozen=True)
class LexicalIndex:
    """Staged BM25 tables of one corpus.

    ``postings`` (doc_id, term, f, doc_len) is hash-bucketed by ``doc_id``: all scores
    of a document are summed where it lies, and only ranked rows are ever shuffled.
    Postings of terms that occur once stay in it, unseen: those terms are in neither
    the vocabulary nor the document lengths. Postings and blocks are staged when they are
    first read: who asks for lengths or terms alone does not wait for them.
    """

    documents: DataFrame  # doc_id, doc_len; empty documents included
    raw: DataFrame  # doc_id, term, f
    vocabulary: DataFrame  # term, cf, df; rare terms removed
    rare: DataFrame  # doc_id, term of the terms that occur once
    n_docs: int
    avg_doc_len: float
    n_postings: int
    buckets: int
    workspace: Workspace

    @cached_property
    def postings(self) -> DataFrame:
        return self.workspace.stage_bucketed(
            "postings",
            lambda: self.raw.join(self.documents.hint("shuffle_hash"), "doc_id"),
            ["doc_id"],
            self.buckets,
            sort_by="term",  # equal terms side by side pack and read best
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """Packed postings with block bounds, see ``blockmax``."""
        setting = blockmax.Setting(K1, B, self.avg_doc_len)
        return self.workspace.stage_bucketed(
            "blocks",
            lambda: blockmax.pack(self.postings, self.rare, self.buckets, setting),
            ["bucket"],
            self.buckets,
            sort_by="term",
            dealt=True,
        )


def build_index(docs: DataFrame, text: Column, workspace: Workspace) -> LexicalIndex:
    """Tokenize ``docs (doc_id, ...)`` and stage its BM25 index.

    The text itself is shuffled once, by document: it is far smaller than its
    postings, which are then counted and written without another shuffle. Stages lie in a
    folder named after the input, so another corpus in the same workspace never finds them.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_text", text)
    workspace = workspace.child(fingerprint(docs.select("doc_id", "_text")))
    buckets = workspace.buckets("postings", bucket_count(spark, text_bytes(docs, F.col("_text")), BUCKET_BYTES))
    raw = workspace.stage_bucketed(
        "raw_postings",
        lambda: postings(docs.repartition(buckets, "doc_id"), F.col("_text")),
        ["doc_id"],
        buckets,
    )
    counted = raw.groupBy("doc_id").agg(F.sum("f").alias("n_tokens"))
    lengths = docs.select("doc_id").join(counted, "doc_id", "left")
    return assemble_index(raw, lengths, vocabulary(raw), workspace, buckets)


def assemble_index(
    raw: DataFrame, lengths: DataFrame, terms: DataFrame, workspace: Workspace, buckets: int | None = None
) -> LexicalIndex:
    """Stage an index from counts: ``raw (doc_id, term, f)``, ``lengths (doc_id, n_tokens)``
    with every document, and ``terms (term, cf, df, first_doc)``. ``raw`` is a stored table:
    the index reads it when its postings are asked for."""
    buckets = buckets or workspace.buckets("postings", bucket_count(raw.sparkSession, 4 * file_bytes(raw), BUCKET_BYTES))
    terms = workspace.stage("terms", lambda: terms)
    rare = rare_postings(terms)

    def pruned() -> DataFrame:
        once = rare.groupBy("doc_id").agg(F.count("*").alias("n_rare"))
        length = F.coalesce("n_tokens", F.lit(0)) - F.coalesce("n_rare", F.lit(0))
        return lengths.join(once, "doc_id", "left").select("doc_id", length.alias("doc_len"))

    documents = workspace.stage_bucketed("doc_lengths", pruned, ["doc_id"], buckets)
    totals = documents.agg(
        F.count("*").alias("n"), F.avg("doc_len").alias("avg_doc_len")
    ).first()
    n_postings = terms.agg(F.sum("df")).first()[0] or 0
    return LexicalIndex(
        documents=documents,
        raw=raw,
        vocabulary=terms.where(F.col("cf") > 1).select("term", "cf", "df"),
        rare=rare,
        n_docs=totals["n"],
        avg_doc_len=totals["avg_doc_len"] or 0.0,
        n_postings=n_postings,
        buckets=buckets,
        workspace=workspace,
    )


def _without_rare(post: DataFrame, rare: DataFrame) -> DataFrame:
    return post.join(rare, ["doc_id", "term"], "left_anti")


def pruned_postings(index: LexicalIndex) -> DataFrame:
    """The postings without those of rare terms."""
    return _without_rare(index.postings, index.rare).select("doc_id", "term", "f")


# --- scoring -------------------------------------------------------------------------


def question_terms(questions: DataFrame, text: Column) -> DataFrame:
    """``(query_id, term, qf)``: a repeated question term counts each time."""
    tokens = questions.select("query_id", F.explode(words(text)).alias("term"))
    return (
        tokens.where(~is_stop_word(F.col("term")))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qf"))
    )


def weighted_terms(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """Question terms with ``weight = qf * idf``; terms no document has are gone."""
    return terms.join(index.vocabulary, "term").select(
        "query_id", "term", "df", (F.col("qf") * idf(F.col("df"), index.n_docs)).alias("weight")
    )


def saturation(index: LexicalIndex, k1: Column | float, b: Column | float) -> Column:
    """The part of BM25 that depends on the document: f and its length."""
    relative = F.col("doc_len") / F.lit(index.avg_doc_len)
    return F.col("f") * (k1 + 1.0) / (F.col("f") + k1 * (1.0 - b + b * relative))


def term_bytes(terms: DataFrame) -> int:
    return terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0


def match_terms(
    index: LexicalIndex,
    weighted: DataFrame,
    max_broadcast: int = MAX_BROADCAST_TERMS,
    n_asked: int | None = None,
) -> DataFrame:
    """Postings joined with the question terms, the columns of both kept.

    Few question terms are broadcast, which leaves the postings in their buckets. Many
    are shuffled by term, and a frequent term is split on both sides: its postings by
    document, its questions by question, and each part meets each part of the other
    side exactly once. ``n_asked`` is the number of question terms, where it is known.
    """
    asked = weighted.drop("df")
    n_asked = asked.count() if n_asked is None else n_asked
    # A term has no length limit, so the bytes of few terms are looked at as well.
    if n_asked <= max_broadcast and term_bytes(asked) <= MAX_BROADCAST_BYTES:
        postings = index.postings
        if n_asked <= MAX_LITERAL_TERMS:
            # Literals reach the scan: the postings' files are sorted by term.
            terms = [r["term"] for r in asked.select("term").distinct().collect()]
            postings = postings.where(F.col("term").isin(terms))
        return postings.join(F.broadcast(asked), "term")
    asked_counts = asked.groupBy("term").agg(F.count("*").alias("qdf"))
    salts = _salts(
        index.vocabulary,
        "df",
        max(POSTINGS_PER_SALT, index.n_postings // MAX_SPLIT_TERMS),
        "doc_salts",
    ).join(
        _salts(
            asked_counts,
            "qdf",
            max(QUESTIONS_PER_SALT, n_asked // MAX_SPLIT_TERMS),
            "query_salts",
        ),
        "term",
        "full",
    )

    def part(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))

    left = (
        index.postings.join(F.broadcast(salts), "term", "left")
        .withColumn("doc_salt", part("doc_id", "doc_salts"))
        .withColumn("query_salt", every("query_salts"))
        .drop("doc_salts", "query_salts")
    )
    right = (
        asked.join(F.broadcast(salts), "term", "left")
        .withColumn("query_salt", part("query_id", "query_salts"))
        .withColumn("doc_salt", every("doc_salts"))
        .drop("doc_salts", "query_salts")
    )
    keys = ["term", "doc_salt", "query_salt"]
    return left.join(right.hint("merge"), keys).drop("doc_salt", "query_salt")


def _salts(rows: DataFrame, count: str, per_salt: int, name: str) -> DataFrame:
    """Terms with more than ``per_salt`` rows and the number of salts they need.

    There are at most (all rows / per_salt) such terms, which bounds the list.
    """
    return rows.where(F.col(count) > per_salt).select(
        "term", F.ceil(F.col(count) / per_salt).cast("int").alias(name)
    )


def score_matches(
    index: LexicalIndex,
    weighted: DataFrame,
    k1: float = K1,
    b: float = B,
    n_asked: int | None = None,
) -> DataFrame:
    """BM25 score of every document that shares a term with a question."""
    part = F.col("weight") * saturation(index, k1, b)
    return (
        match_terms(index, weighted, n_asked=n_asked)
        .groupBy("query_id", "doc_id")
        .agg(rounded(F.sum(part)).alias("score"))
    )


def best_documents(
    index: LexicalIndex,
    weighted: DataFrame,
    k: int,
    k1: float = K1,
    b: float = B,
    max_broadcast: int = MAX_BROADCAST_TERMS,
    matches_per_task: int = MATCHES_PER_TASK,
) -> DataFrame:
    """Exact top-k ranking of the documents that share a term with a question.

    Question terms that fit into every task are scored over packed blocks, skipping those
    that cannot decide (:mod:`blockmax`), in as many passes as it takes: matches, whose number
    grows with questions times documents, never leave a task. Where ``max_broadcast`` forbids
    that, the matches are counted beforehand, from the document frequencies. A number the tasks can sum up goes in one pass inside the buckets of the postings. Beyond it,
    frequent terms would pair most documents with most questions, so terms that cannot
    decide a top-k (:func:`_split_terms`) only complete the scores of documents found
    by the others. ``weighted`` is used several times; stage or settle it.
    """
    n_terms, n_matches, n_bytes = weighted.agg(
        F.count("*"), F.sum("df"), F.sum(F.octet_length("term"))
    ).first()
    if not n_terms:
        return ranking(weighted.select("query_id", F.lit(0).cast("long").alias("doc_id"), F.col("weight").alias("score")), k)
    parts = _passes(n_terms, n_bytes, max_broadcast, None)
    if parts:
        return _best_in_rounds(index, weighted, parts, k, blockmax.Setting(k1, b, index.avg_doc_len))
    if n_terms <= max_broadcast and (n_matches or 0) <= matches_per_task * index.buckets:
        return ranking(score_matches(index, weighted, k1, b, n_terms), k)
    part = F.col("weight") * saturation(index, k1, b)
    terms = settle(_split_terms(index, weighted, k, k1, b, max_broadcast))
    decisive = terms.where("decisive").drop("decisive", "df")
    found = settle(
        match_terms(index, decisive, max_broadcast)
        .groupBy("query_id", "doc_id")
        .agg(F.sum(part).alias("part"), F.first("need").alias("need"))
        .where(F.col("part") >= F.col("need"))
        .select("query_id", "doc_id", "part")
    )
    completing = terms.where(~F.col("decisive")).select("query_id", "term", "weight")
    looked_up = keep_matching(index.postings, found, "doc_id")
    rest = (
        with_terms(found.select("query_id", "doc_id"), completing, n_terms <= max_broadcast)
        .join(looked_up, ["doc_id", "term"])
        .select("query_id", "doc_id", part.alias("part"))
    )
    scored = (
        found.unionByName(rest)
        .groupBy("query_id", "doc_id")
        .agg(rounded(F.sum("part")).alias("score"))
    )
    return ranking(scored, k)


def _best_in_rounds(
    index: LexicalIndex, weighted: DataFrame, parts: list[Column], k: int, setting: blockmax.Setting
) -> DataFrame:
    """Top-k of the questions of each pass over the packed blocks.

    A bucket gives up to ``k`` rows a question. With several passes these are ranked and
    written round by round, so disk holds those of one round, and what a round sent goes with it.
    """
    exact_tops = (setting.k1, setting.b) == (K1, B)
    found = []
    for at in range(0, len(parts), ROUND_PASSES):
        sent: list = []
        scored = reduce(
            DataFrame.unionAll,
            [
                blockmax.best(index.blocks, blockmax.asked_of(weighted.where(some)), k, setting, exact_tops, MAX_LITERAL_TERMS, sent)
                for some in parts[at : at + ROUND_PASSES]
            ],
        )
        ranked = ranking(scored.select("query_id", "doc_id", rounded(F.col("score")).alias("score")), k)
        if len(parts) == 1:
            return ranked
        found.append(settle_alone(ranked))
        for held in sent:
            held.destroy()
    return reduce(DataFrame.unionAll, found)


def _passes(n_terms: int, n_bytes: int, max_broadcast: int, most: int | None) -> list[Column]:
    """Questions of each pass over the blocks; none where it would take more than ``most`` passes.

    Whole questions go to a pass, which sends its terms and reads the blocks once.
    """
    sent = min(max_broadcast, BLOCK_TERMS)
    passes = max(-(-n_terms // sent), -(-n_bytes // MAX_BROADCAST_BYTES), 1) if sent else 0
    if not sent or (most and passes > most):
        return []
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    return [dealt == p for p in range(passes)] if passes > 1 else [F.lit(True)]


def _split_terms(
    index: LexicalIndex,
    weighted: DataFrame,
    k: int,
    k1: float,
    b: float,
    max_broadcast: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """Mark the ``decisive`` terms of each question.

    All parts of a score are positive, so the k-th best sum over a question's rarest
    terms alone is a floor for its k-th best score. A part is below ``weight * (k1 +
    1)``. The weakest terms whose bounds together stay below the floor cannot lift a
    document into the top-k by themselves: every result holds a decisive term.
    ``need`` is what the decisive terms of a result must reach at least. A question
    without a floor has only decisive terms.
    """
    in_question = Window.partitionBy("query_id")
    order = F.row_number().over(in_question.orderBy("df", "term"))
    rarest = (
        weighted.withColumn("_order", order)
        .where((F.col("_order") <= FLOOR_TERMS) & (F.col("df") <= POSTINGS_PER_SALT))
        .drop("_order", "df")
    )
    part = F.col("weight") * saturation(index, k1, b)
    sums = match_terms(index, rarest, max_broadcast).groupBy("query_id", "doc_id").agg(
        F.sum(part).alias("score")
    )
    floors = ranking(sums, k).where(F.col("rank") == k).select(
        "query_id", (F.col("score") - FLOOR_SLACK).alias("floor")
    )
    bound = F.col("weight") * (k1 + 1.0)
    up_to = in_question.orderBy(bound, "term").rowsBetween(Window.unboundedPreceding, 0)
    decisive = F.sum(bound).over(up_to) >= F.coalesce("floor", F.lit(0.0))
    rest = F.coalesce(F.sum(F.when(~F.col("decisive"), bound)).over(in_question), F.lit(0.0))
    return (
        weighted.join(floors, "query_id", "left")
        .withColumn("decisive", decisive)
        .withColumn("need", F.coalesce("floor", F.lit(0.0)) - rest)
        .drop("floor")
    )


def bm25_topk(
    index: LexicalIndex,
    questions: DataFrame,
    text: Column,
    k: int,
    pad: bool = True,
    k1: float = K1,
    b: float = B,
    **limits: int,
) -> DataFrame:
    """Best ``k`` documents per question; ``pad`` fills short lists with zero scores."""
    weighted = settle(weighted_terms(index, question_terms(questions, text)))
    hits = best_documents(index, weighted, k, k1, b, **limits)
    return pad_with_first(hits, questions, index.documents, k) if pad else hits


def with_terms(pairs: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """``pairs (query_id, doc_id)`` with the terms of their question.

    ``few`` terms are broadcast. Otherwise a question's pairs are spread by document, and
    its terms, which are no more than the words of one question, go to each part.
    """
    if few:
        return pairs.join(F.broadcast(terms), "query_id")
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(QUESTION_SALTS)).cast("int"))
    copies = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(QUESTION_SALTS - 1))))
    return salted.join(copies, ["query_id", "_salt"]).drop("_salt")


def score_pairs(
    index: LexicalIndex,
    weighted: DataFrame,
    pairs: DataFrame,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """BM25 score of given ``(query_id, doc_id)`` pairs, 0 when nothing matches."""
    scores = matching_pairs(index, weighted, pairs, k1, b)
    return pairs.join(scores, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def matching_pairs(
    index: LexicalIndex, weighted: DataFrame, pairs: DataFrame, k1: float = K1, b: float = B
) -> DataFrame:
    """BM25 score of those ``(query_id, doc_id)`` pairs that share a term."""
    part = F.col("weight") * saturation(index, k1, b)
    return (
        _matches_of(index, weighted, pairs)
        .groupBy("query_id", "doc_id")
        .agg(rounded(F.sum(part)).alias("score"))
    )


def _matches_of(
    index: LexicalIndex, weighted: DataFrame, pairs: DataFrame, max_broadcast: int = MAX_BROADCAST_TERMS
) -> DataFrame:
    """Postings of the question's terms for each ``(query_id, doc_id)``, with their weights.

    Question terms that fit into every task come to the buckets of the postings, and so do
    the pairs, by document; a posting never leaves its bucket, nor do matches. For more
    terms, both sides are shuffled by document and term.
    """
    pairs, asked = pairs.select("query_id", "doc_id"), weighted.drop("df")
    if not fits(asked, max_broadcast) or term_bytes(asked) > MAX_BROADCAST_BYTES:
        pairs = pairs if is_stored(pairs) else settle(pairs)
        looked_up = keep_matching(index.postings, pairs, "doc_id")
        return with_terms(pairs, asked, False).join(looked_up, ["doc_id", "term"])
    of_terms = index.postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    return of_terms.join(pairs, "doc_id").join(F.broadcast(asked), ["query_id", "term"])


def places(
    index: LexicalIndex,
    weighted: DataFrame,
    wanted: DataFrame,
    k1: float = K1,
    b: float = B,
    max_broadcast: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """Rank of each ``wanted (query_id, doc_id)`` in the complete list of its question.

    Documents that share a term are scored, and only counted: for each place between the
    wanted documents, how many fall there. Terms that fit into tasks are counted over packed
    blocks, as :func:`best_documents` scores them, and only counts leave a task; for more,
    all scored documents meet the wanted ones. A wanted document without a shared term
    has no row. ``weighted`` is used several times; stage or settle it.
    """
    order = F.struct((-F.col("score")).alias("score"), "doc_id")
    own = settle(matching_pairs(index, weighted, wanted.select("query_id", "doc_id"), k1, b))
    # As many per question as the caller wants, best first.
    lists = own.groupBy("query_id").agg(F.sort_array(F.collect_list(order)).alias("own"))
    asked = weighted.join(own.select("query_id").distinct(), "query_id", "left_semi")
    few = fits(own, max_broadcast)
    n_terms, n_bytes = asked.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    parts = _passes(n_terms, n_bytes or 0, max_broadcast, MAX_PASSES) if few else []
    if parts:
        fallen = _fallen(index, asked, own, parts, k1, b)
    else:
        scored = score_matches(index, asked, k1, b)
        if few:
            met = scored.join(F.broadcast(lists), "query_id")
        else:  # one question may match most documents
            salted = scored.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(QUESTION_SALTS)))
            salts = F.explode(F.sequence(F.lit(0), F.lit(QUESTION_SALTS - 1)))
            met = salted.join(lists.withColumn("_salt", salts), ["query_id", "_salt"])
        place = F.size(F.filter("own", lambda x: x <= order))
        fallen = met.withColumn("place", place).where(F.col("place") < F.size("own")).withColumn("n", F.lit(1))
    fallen = fallen.groupBy("query_id", "place").agg(F.sum("n").alias("n"))
    upwards = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lists.select("query_id", F.posexplode("own").alias("place", "pair"))
        .join(fallen, ["query_id", "place"], "left")
        .select(
            "query_id",
            F.col("pair.doc_id").alias("doc_id"),
            # Those at the places up to it, and the wanted ones before it, once each.
            (F.sum(F.coalesce("n", F.lit(0))).over(upwards) + 1).cast("int").alias("rank"),
        )
    )


def _fallen(
    index: LexicalIndex, asked: DataFrame, own: DataFrame, parts: list[Column], k1: float, b: float
) -> DataFrame:
    """``query_id, place, n`` of each bucket, from passes over the packed blocks."""
    setting = blockmax.Setting(k1, b, index.avg_doc_len)
    counted = []
    for some in parts:
        terms = blockmax.asked_of(asked.where(some))
        wanted = blockmax.wanted_of(own.where(some).toArrow(), terms, SCORE_DIGITS)
        counted.append(
            blockmax.fallen(index.blocks, terms, wanted, setting, (k1, b) == (K1, B), MAX_LITERAL_TERMS, SCORE_DIGITS)
        )
    return reduce(DataFrame.unionAll, counted)


def score_grid(
    index: LexicalIndex, weighted: DataFrame, grid: list[tuple[float, float]]
) -> DataFrame:
    """Scores for several ``(k1, b)`` from one pass over the matches."""
    settings = F.array(
        *[F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b")) for k1, b in grid]
    )
    matches = match_terms(index, weighted).withColumn("setting", F.explode(settings))
    part = F.col("weight") * saturation(index, F.col("setting.k1"), F.col("setting.b"))
    return (
        matches.groupBy(
            F.col("setting.k1").alias("k1"), F.col("setting.b").alias("b"), "query_id", "doc_id"
        )
        .agg(rounded(F.sum(part)).alias("score"))
    )


def covering_documents(
    index: LexicalIndex, weighted: DataFrame, max_broadcast: int = MAX_BROADCAST_TERMS
) -> DataFrame:
    """``(query_id, doc_id)`` of documents that contain every indexed question term.

    Candidates come from each question's rarest term alone; the other terms are then
    looked up by document, so frequent terms never meet all their postings.
    """
    # The number of terms and the rarest one come from one aggregate per question.
    facts = weighted.groupBy("query_id").agg(
        F.count("*").alias("n_terms"), F.min(F.struct("df", "term")).alias("rarest")
    )
    anchors = facts.select(
        "query_id", F.col("rarest.term").alias("term"), F.lit(1.0).alias("weight")
    )
    # From the buckets of the postings, if the terms are few: such a table needs no shuffle.
    candidates = match_terms(index, anchors, max_broadcast).select("query_id", "doc_id")
    return (
        _matches_of(index, weighted, candidates, max_broadcast)
        .groupBy("query_id", "doc_id")
        .agg(F.count("*").alias("found"))
        .join(facts.select("query_id", "n_terms"), "query_id")
        .where(F.col("found") == F.col("n_terms"))
        .select("query_id", "doc_id")
    )
