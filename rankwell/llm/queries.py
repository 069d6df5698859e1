"""The queries of this subpackage, each over its whole table, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    jaccard_join,
    language_id,
    phrases,
    pii,
    quality,
    sentencepiece_codec,
    spelling,
    substring_dedup,
    suffix_dedup,
    token_files,
    topk_search,
)
from .staging import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.remainder(3) == 1
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = language_id.language_id(docs, docs.where(~held_out), with_spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.remainder(4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    model = quality.fit(labels.join(docs, "doc_id"))
    found = quality.score(docs, model)
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "n_passages", "top_passage")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = chat_format.transcripts(turns)
    parsed = chat_format.format_transcripts(found, chat_format.fit(turns), ["conv_id", "segment", "true_roles"])
    return parsed.select("conv_id", "segment", "n_turns", "roles", "rendered", (F.col("roles") == F.col("true_roles")).alias("recovered"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digest(sentencepiece_codec.encode(docs, path, decoded="decoded"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_documents(shards)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = pii.fit(pii.labelled_passages(docs))
    return pii.digest(pii.find_spans(docs, weights))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
hits AS (SELECT doc_id, i, 1 AS hit FROM windows JOIN firsts USING (h) WHERE d < doc_id),
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
marked AS (
    SELECT doc_id, i, word,
           coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING), 0) AS gone
    FROM places LEFT JOIN hits USING (doc_id, i)),
kept AS (
    SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
           string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS words
    FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(ws) >= 5
             THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g
    FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 75 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT b, root FROM reach JOIN ways ON a = reach.doc_id),
roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM roots LEFT JOIN sizes USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12_SQL = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size),
words AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
    SELECT lang, phrase, size, a, k,
           array_to_string(string_split(phrase, ' ')[1:k], ' ') AS one, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS two
    FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
scored AS (
    SELECT c.lang, c.phrase, c.size, c.a, c.k, x.a AS l, y.a AS r,
           CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.one JOIN f y ON y.lang = c.lang AND y.phrase = c.two),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, phrase, max(a) AS longer
    FROM (SELECT lang, a, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase
          FROM f, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < size AND i + m - 1 <= size)
    GROUP BY ALL),
kept AS (
    SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
    WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words ON words.lang = ranked.lang WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op3_sentencepiece": op3_sentencepiece,
    "op6_jaccard_join": op6_jaccard_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op7_token_files": op7_token_files,
    "op10_topk_search": op10_topk_search,
    "op11_pii": op11_pii,
    "op12_phrases": op12_phrases,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op4_substring_dedup": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op10_topk_search": OP10_SQL,
    "op12_phrases": OP12_SQL,
}
