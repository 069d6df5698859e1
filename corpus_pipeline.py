"""A corpus pipeline in five stages: from ``documents`` to token ids.

Every stage takes all rows its predecessor kept, and its decisions take effect:

1. language ID: documents without a letter (``und``) go; a null ``lang`` is filled in;
2. n-gram Jaccard join: the document with the smallest id of each component stays;
3. suffix-array dedup: repeated 100-byte strings are cut out of the texts;
4. benchmark decontamination: documents that hold a test item go;
5. SentencePiece: the kept texts as ids, with the columns of the document.

Rows without ``doc_id`` go in the first stage; null and empty texts are ``und`` there.
Rows with equal ``doc_id`` share their fate. Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import decontaminate, jaccard_join, language_id, sentencepiece_codec, suffix_dedup
from rankwell.llm.queries import tokenizer_path
from rankwell.llm.staging import ship, staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model learns from all labelled rows of ``docs``."""
    ship(spark)
    docs = docs.where("doc_id is not null")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.label(docs, model, with_spans=False, keep=docs.columns)
    # By place, since a column of the input may be called like one of the labels.
    found = found.toDF(*docs.columns, "_lang", "_score", "_spans").where(F.col("_lang") != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "_lang")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates."""
    found = jaccard_join.jaccard_components(docs)
    firsts = found.where("component_id = doc_id").select("doc_id")
    return docs.join(firsts, "doc_id", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that start earlier; ``n_chars`` counted anew."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (``ids``, ``n_tokens``), and whether decoding gives the text back."""
    ship(spark)
    path = tokenizer_path("piece_bpe_32k.model")
    rows = docs.select("doc_id", "text", "lang", "source")
    decoded = sentencepiece_codec.encode(rows, path, decoded="decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can express neither learned labels nor suffix order; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
