"""A corpus that grows: new rows and further embedding models touch only themselves.

Every increment leaves deltas beside the ones before: its rows, their postings, lengths
and term counts. Sums of counts are additive, so collection counts, document frequencies,
rare terms and pruned lengths of the whole come from adding the deltas up; no text that is
already in is read again. A vector is made once for each row and model. All deltas of an
increment become visible in one commit (``sources.snapshots``), and an increment that is
already in is skipped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical
from ..operators.embedding import BatchModel, embed
from ..operators.joins import MAX_BROADCAST_KEYS, fits, scratch, settle
from ..operators.rows import dense_id
from ..sources.snapshots import Snapshots
from ..sources.tables import file_bytes, first_rows, missing_vectors
from ..sources.workspace import Workspace, bucket_count, fingerprint
from .build import chunk_text

VECTOR = "original_id string, model string, embedding array<float>"


class GrowingCorpus:
    """Raw rows ``(id, question, documents, dataset_name)`` taken in step by step.

    A question counts once over all steps (a null question too): the first row of the
    earliest step stays. Rows are numbered on from step to step, in the order of their ids
    inside a step.
    """

    def __init__(self, spark: SparkSession, root: str, chunks: str = "all"):
        self.spark, self.chunks = spark, chunks
        self.store = Snapshots(spark, root)
        self.work = Workspace(spark, f"{root.rstrip('/')}/work")

    # growing
    def ingest(self, raw: DataFrame) -> bool:
        """Take in the rows of ``raw`` that are new; False where this input is already in."""
        step = fingerprint(raw, "rows", self.chunks)
        base = self.store.manifest()
        if step in base["done"]:
            return False
        work = self.work.child(f"{step}-{uuid.uuid4().hex[:8]}")
        first_id = base["facts"].get("n_rows", 0)
        # The rows to take in are found and numbered by narrow keys; texts are shuffled once.
        marked = raw.withColumn("_digest", F.coalesce(F.sha2("question", 256), F.lit("")))
        marked = marked.withColumn("_hash", F.xxhash64(*marked.columns))
        place = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_hash")).alias("first")
        keys = marked.groupBy("_digest").agg(place).select("_digest", F.col("first._hash").alias("_hash"), F.col("first.id").alias("original_id"))
        present = self.store.read("rows", base)
        if present is not None:
            keys = keys.join(present.select(F.coalesce("digest", F.lit("")).alias("_digest")), "_digest", "left_anti")
        numbered = dense_id(keys, ["original_id", "_digest"], work, "placed")
        numbered = numbered.select("_digest", "_hash", (F.col("id") + first_id).alias("_id"))
        chosen = first_rows(marked.join(numbered.hint("merge"), ["_digest", "_hash"]), ["_digest", "_hash"], "id")
        columns = [F.col(c).alias("original_id" if c == "id" else c) for c in raw.columns]
        digest = F.when(F.col("_digest") != "", F.col("_digest")).alias("digest")
        written = {"rows": self.store.write_part(chosen.select(*columns, digest, F.col("_id").alias("id")))}
        rows = self.store.part(written["rows"])

        docs = rows.select(F.col("id").alias("doc_id"), chunk_text(self.chunks).alias("text"))
        parts = bucket_count(self.spark, file_bytes(rows))
        written["postings"] = self.store.write_part(lexical.postings(docs.repartition(parts, "doc_id"), F.col("text")))
        postings = self.store.part(written["postings"])
        counted = postings.groupBy("doc_id").agg(F.sum("f").alias("n_tokens"))
        lengths = docs.select("doc_id").join(counted, "doc_id", "left").na.fill({"n_tokens": 0})
        written["lengths"] = self.store.write_part(lengths)
        written["terms"] = self.store.write_part(lexical.vocabulary(postings))
        self.store.commit(base, written, done=(step,), facts={"n_rows": first_id + rows.count()})
        return True

    def embed(self, name: str, model: BatchModel) -> int:
        """Vectors of one more model, or of rows it has not seen; how many were made."""
        base = self.store.manifest()
        rows, store = self.store.read("rows", base), self.vectors(base)
        if rows is None:
            return 0
        wanted = first_rows(rows.select("id", "original_id"), ["original_id"], "id")
        with scratch(self.spark):
            # Keys alone tell which rows lack a vector; where none does, no text is read.
            lacking = settle(missing_vectors(store, wanted, name).select("id"))
            few = F.broadcast(lacking) if fits(lacking, MAX_BROADCAST_KEYS) else lacking
            texts = rows.select("id", "original_id", chunk_text(self.chunks).alias("text"))
            new = embed(texts.join(few, "id", "left_semi"), "text", model)
            part = self.store.write_part(new.select("original_id", F.lit(name).alias("model"), "embedding"))
        made = self.store.commit(base, {"vectors": part})["tables"]["vectors"]["parts"][-1]
        return self.spark.read.parquet(f"{self.store.root}/{made}").count()

    # reading
    def rows(self) -> DataFrame | None:
        """``id, original_id, question, documents, dataset_name`` of all steps."""
        held = self.store.read("rows")
        return held if held is None else held.drop("digest")

    def vectors(self, manifest: dict | None = None) -> DataFrame:
        held = self.store.read("vectors", manifest)
        return self.spark.createDataFrame([], VECTOR) if held is None else held

    def index(self) -> lexical.LexicalIndex:
        """BM25 index of the current snapshot, put together from the deltas.

        Staged under the snapshot's number: an older one is never found for it.
        """
        held = self.store.manifest()
        if "terms" not in held["tables"]:
            raise ValueError("nothing has been taken in yet")
        lexical_parts = [p for name in ("postings", "lengths", "terms") for p in held["tables"][name]["parts"]]
        work = self.work.child(f"index-{len(lexical_parts)}-{held['facts']['n_rows']}-{held['done'][-1]}")
        deltas = self.store.read("terms", held)
        summed = deltas.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.min("first_doc").alias("first_doc"))
        return lexical.assemble_index(self.store.read("postings", held), self.store.read("lengths", held), summed, work)
