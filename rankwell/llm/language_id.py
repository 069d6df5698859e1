"""Language identification of mixed-language text.

A model holds, for each language, the share of its letters in each script, and log
probabilities of byte trigrams. For every word, the script of its letters narrows the
candidates to the languages that are written in it; the word's score for a language is the
sum over its trigrams. A Viterbi pass over the words of a document, with a penalty for each
switch, labels spans of one language. The language with the most labelled letters is the
document's.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_DOCS``).

Rows: a null text, or one without a letter, is ``und`` with score 0. Labels that are null
teach nothing; with no label at all everything is ``und``. Repeated rows and rows with
equal ids each get a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .staging import ship

SAMPLE_DOCS = 20_000
BINS = 1 << 16
PRIOR = 0.05
SWITCH = 12.0
SCRIPT_SHARE = 0.01
PART_BYTES = 3 << 20
UNKNOWN = "und"
NEW = ("lang_pred", "score", "n_spans", "spans")

# First and last lead byte (with the second byte's range) of the Unicode
# blocks of a script in UTF-8.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC2, 0xCA))),
    ("greek", ((0xCD, 0xCF),)),
    ("cyrillic", ((0xD0, 0xD4),)),
    ("hebrew", ((0xD7, 0xD7),)),
    ("arabic", ((0xD8, 0xDD),)),
    ("indic", ((0xE0, 0xE0),)),
    ("kana", ((0xE3, 0xE3),)),
    ("han", ((0xE4, 0xE9),)),
    ("hangul", ((0xEA, 0xED),)),
)


class Model(NamedTuple):
    languages: list[str]
    trigrams: np.ndarray  # bins x languages, log probability
    scripts: np.ndarray  # scripts x languages, whether a language is written in it


def _letters() -> np.ndarray:
    gap = np.ones(256, bool)
    gap[65:91] = gap[97:123] = gap[128:] = False
    return gap


def _script_of_lead() -> np.ndarray:
    """Number of the script + 1 that a lead byte tells; 0 for the others."""
    table = np.zeros(256, np.uint8)
    for i, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            table[a : b + 1] = i + 1
    return table


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bin of the trigram around each byte; bytes that are no letters count as a space."""
    clean = np.where(_letters()[data], np.uint8(32), data).astype(np.uint32)
    padded = np.concatenate([[32], clean, [32]]).astype(np.uint32)
    code = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _words(block: tb.Texts):
    start, end, bounds = tb.words(block, _letters())
    scripts = _script_of_lead()[block.data]
    return start, end, bounds, scripts[start] if len(start) else np.zeros(0, np.uint8)


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Model of ``labelled (doc_id, text, lang)``, from about ``sample_docs`` of its rows.

    The rows are picked by a hash of their ids, evenly over the table.
    """
    ship(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null")
    n = rows.count()
    if n > sample_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample_docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for block in tb.blocks(_lowered(batch.column("text"))):
                start, _, bounds, script = _words(block)
                bins = _trigrams(block.data)
                here = langs[block.first : block.first + block.n]
                for lang in set(here):
                    g = grams.setdefault(lang, np.zeros(BINS, np.int64))
                    s = scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 1, np.int64))
                    for i in np.flatnonzero(here == lang):
                        g += np.bincount(bins[block.offsets[i] : block.offsets[i + 1]], minlength=BINS)
                        s += np.bincount(script[bounds[i] : bounds[i + 1]], minlength=len(s))
        for lang in grams:
            yield pa.record_batch(
                [pa.array([lang]), pa.array([grams[lang].tobytes()], pa.binary()), pa.array([scripts[lang].tobytes()], pa.binary())],
                names=["lang", "grams", "scripts"],
            )

    def total(table: pa.Table) -> pa.Table:
        sums = {
            c: np.sum([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()], axis=0)
            for c in ("grams", "scripts")
        }
        return pa.table(
            {"lang": table.column("lang").slice(0, 1), **{c: pa.array([s.tobytes()], pa.binary()) for c, s in sums.items()}}
        )

    schema = "lang string, grams binary, scripts binary"
    counted = rows.select("lang", "text").mapInArrow(work, schema).groupBy("lang").applyInArrow(total, schema)
    found = sorted(counted.collect(), key=lambda r: r["lang"])
    if not found:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    grams = np.stack([np.frombuffer(r["grams"], np.int64) for r in found], axis=1).astype(np.float64) + PRIOR
    # The bin of nothing but spaces says nothing.
    scripts = np.stack([np.frombuffer(r["scripts"], np.int64) for r in found], axis=1).astype(np.float64)
    written = scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE
    return Model([r["lang"] for r in found], np.log(grams / grams.sum(axis=0)).astype(np.float32), written)


def word_scores(block: tb.Texts, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of every word for every language, letters of the words, and document bounds."""
    start, end, bounds, script = _words(block)
    bins = _trigrams(block.data)
    out = np.empty((len(start), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        sums = np.concatenate([[0.0], np.cumsum(model.trigrams[:, k][bins], dtype=np.float64)])
        out[:, k] = sums[end] - sums[start]
    # Only languages written in the word's script; where none is, all stay.
    allowed = model.scripts[script]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    out[~allowed] = -1e6
    return out, end - start, bounds


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word, all documents side by side, one step for each word.

    Staying is free; going to any other label costs ``switch``.
    """
    n_words, k = scores.shape
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = bounds[:-1][order], lengths[order]
    stay = np.ones((n_words, k), bool)
    best = np.zeros(n_words, np.int16)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    value = np.zeros((len(begins), k), np.float64)
    for t in range(longest):
        m = active[t]
        at = begins[:m] + t
        if t:
            v = value[:m]
            top = v.max(axis=1, keepdims=True)
            from_top = top - switch
            stay[at] = v >= from_top
            best[at] = v.argmax(axis=1)
            value[:m] = np.maximum(v, from_top)
        value[:m] += scores[at]
    label = np.zeros(n_words, np.int16)
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begins[:m] + t
        label[at] = state[:m]
        if t:
            state[:m] = np.where(stay[at, state[:m]], state[:m], best[at])
    return label


def _spans(label: np.ndarray, letters: np.ndarray, bounds: np.ndarray, k: int):
    """Letters of each label in each document, and the number of spans."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = len(bounds) - 1
    held = np.bincount(doc * k + label, weights=letters, minlength=n * k).reshape(n, k)
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    return held, doc, new


def label(
    docs: DataFrame, model: Model, switch: float = SWITCH, with_spans: bool = True, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` of ``docs``, and ``lang_pred, score, n_spans, spans`` of whole texts.

    ``score``: share of the letters in spans of ``lang_pred``. ``spans``: language, first
    and last word of each span, in order; left out without ``with_spans``.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.languages)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(len(keep))
            for block in tb.blocks(_lowered(texts), PART_BYTES):
                n = block.n
                kept = [batch.column(c).slice(block.first, n) for c in range(len(keep))]
                best, score, count = np.full(n, k), np.zeros(n), np.zeros(n, np.int32)
                starts, labels, begins = np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(n + 1, np.int64)
                ends = starts
                if k:
                    scores, letters, bounds = _scored_parts(block, model)
                    found = viterbi(scores, bounds, switch)
                    held, doc, new = _spans(found, letters, bounds, k)
                    total = held.sum(axis=1)
                    known = total > 0
                    top = held.argmax(axis=1)
                    for i in np.flatnonzero(known & ~_has_ascii_letter(block)):
                        known[i] = any(c.isalpha() for c in texts[block.first + i].as_py())
                    best[known] = top[known]
                    score[known] = (held[np.arange(n), top] / np.maximum(total, 1))[known]
                    starts = np.flatnonzero(new)
                    begins = np.searchsorted(doc[starts], np.arange(n + 1))
                    labels = found[starts]
                    ends = np.append(starts[1:], len(found))
                    count = np.where(known, np.diff(begins), 0).astype(np.int32)
                    shift = bounds[:-1][doc[starts]]
                    starts, ends = starts - shift, ends - shift
                columns = [*kept, pa.array(names[best], pa.string()), pa.array(score), pa.array(count)]
                if with_spans:
                    cells = pa.StructArray.from_arrays(
                        [pa.array(names[labels], pa.string()), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32) - 1)],
                        fields=list(span),
                    )
                    columns.append(pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), cells))
                yield pa.record_batch(columns, names=names_out)

    # Kept columns may be called like the new ones, so they go by number in between.
    fields = [f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.select(*keep).schema)]
    fields += ["lang_pred string", "score double", "n_spans int"]
    if with_spans:
        fields.append("spans array<struct<lang: string, first: int, last: int>>")
    names_out = [f.split()[0] for f in fields]
    numbered = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    return numbered.mapInArrow(work, ", ".join(fields)).toDF(*keep, *NEW[: len(fields) - len(keep)])


def _scored_parts(block: tb.Texts, model: Model):
    """``word_scores`` of a large block, a few documents at a time."""
    parts, letters, bounds, at = [], [], [np.zeros(1, np.int64)], 0
    first = 0
    while first < block.n:
        last = max(first + 1, int(np.searchsorted(block.offsets, block.offsets[first] + tb.BLOCK_BYTES, side="right")) - 1)
        edge = block.offsets[first : last + 1]
        piece = tb.Texts(block.data[edge[0] : edge[-1]], edge - edge[0], first)
        s, n, b = word_scores(piece, model)
        parts.append(s)
        letters.append(n)
        bounds.append(b[1:] + at)
        at += len(s)
        first = last
    return np.concatenate(parts), np.concatenate(letters), np.concatenate(bounds)


def _has_ascii_letter(block: tb.Texts) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[97:123] = 1
    sums = np.concatenate([[0], np.cumsum(table[block.data])])
    return sums[block.offsets[1:]] > sums[block.offsets[:-1]]


def remainder(divisor: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def language_id(docs: DataFrame, train: DataFrame, **options) -> DataFrame:
    """Labels of ``docs``, by a model of ``train (doc_id, text, lang)``."""
    return label(docs, fit(train), **options)
