"""SentencePiece encoding and decoding of whole texts with a BPE piece model.

The merge-type encoding is found by backtracking instead of merging: Aho-Corasick gives
the pieces that match at each place, the longest is tried first, a piece may follow
another only if merging the two texts anew gives just these two, and a bitfield remembers
the places from which no encoding goes on. Encodings of adjacent compatible pieces are
the merge result, so no merge queue over the text is needed.

No piece holds a space mark after another character, so texts fall apart before each
run of space marks, and the encodings of the parts are independent.

Rows: a null text counts as empty and has no ids. Characters without a piece become the
ids of their UTF-8 bytes. Repeated rows and empty tables pass through; other columns are
kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .staging import ship

MARK = "▁"  # stands for a space inside pieces
CACHE_WORDS = 150_000
LONGEST_KEPT = 64  # characters of a word that is remembered
CACHE_PAIRS = 300_000
REPLACEMENT = "�".encode()


class Pieces:
    """A BPE piece model: vocabulary, scores, matching automaton, pair checks."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {
            i for i in range(len(self.texts)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        }
        self.ids = {p: i for i, p in enumerate(self.texts) if i not in special}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.sizes = [len(p) for p in self.texts]
        self.reach = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.longest = self.automaton.iter_long
        #: For each piece the longest piece that is a proper prefix of it, or -1.
        self.shorter = [
            next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1) for p in self.texts
        ]
        self.cells = [i.to_bytes(4, "little") for i in range(len(self.texts))]
        self.pairs: dict[int, bool] = {}
        inner = [p for p in self.ids if MARK in p.lstrip(MARK)]
        loose = {c for p in self.ids for c in p} - set(self.ids)
        if inner or loose:
            raise ValueError(f"pieces this encoder cannot cut at: {(inner + sorted(loose))[:5]}")

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: best score first, leftmost of equals."""
        score = self.scores.get
        parts = list(text)
        pairs = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(pairs):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at] += parts.pop(at + 1)
            pairs.pop(at)
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1])

    def compatible(self, one: int, two: int) -> bool:
        key = one << 32 | two
        known = self.pairs.get(key)
        if known is None:
            a, b = self.texts[one], self.texts[two]
            known = self.merged(a + b) == [a, b]
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text without a place to cut it before encoding."""
        greedy = [i for _, i in self.longest(text)]
        if sum([self.sizes[i] for i in greedy]) == len(text):
            for one, two in zip(greedy, greedy[1:]):
                if not self.compatible(one, two):
                    return self._backtrack(text)
            return greedy  # the longest piece everywhere, and no pair of them objects
        out: list[int] = []
        for known, stretch in groupby(text, self.ids.__contains__):
            chars = "".join(stretch)
            if known:
                out.extend(self.encode_part(chars))
            else:  # characters without a piece stand alone
                out.extend(self.byte_ids[b] for b in chars.encode())
        return out

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters, trying longer pieces first."""
        sizes, shorter, compatible, longest = self.sizes, self.shorter, self.compatible, self.longest
        n = len(text)
        failed = bytearray((n >> 3) + 1)  # bit p: no encoding goes on from place p
        chosen: list[int] = []
        at, last = 0, -1
        # A matcher copies what it is given, so it gets no more than a piece can take.
        reach = self.reach
        i = next(longest(text[:reach]))[1]
        while True:
            while i >= 0:
                to = at + sizes[i]
                if not failed[to >> 3] >> (to & 7) & 1 and (last < 0 or compatible(last, i)):
                    break
                i = shorter[i]
            if i >= 0:
                chosen.append(i)
                if to == n:
                    return chosen
                at, last = to, i
                i = next(longest(text[at : at + reach]))[1]
            elif not chosen:
                raise ValueError("no encoding: the model's pieces are not closed under merging")
            else:
                failed[at >> 3] |= 1 << (at & 7)
                i = chosen.pop()
                at -= sizes[i]
                last = chosen[-1] if chosen else -1
                i = shorter[i]


class _Words(dict):
    """Ids (as bytes of int32) of the parts met so far; a bounded memory, emptied when full."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        """``word`` follows a space; a line break in it has no piece and cuts it."""
        if "\n" in word and "\n" not in self.pieces.ids:
            head, *rest = word.split("\n")
            line = np.array(self.pieces.byte_ids[10], np.int32).tobytes()
            return self[head] + b"".join(line + (self[MARK + r] if r else b"") for r in rest)
        # A key that starts with a mark is a part without one.
        text = word[1:] if word[:1] == MARK else MARK + word
        cells = self.pieces.cells
        ids = b"".join([cells[i] for i in self.pieces.encode_part(text)])
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(_pieces(path))


_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def encode_text(text: str, path: str) -> bytes:
    """Ids of a whole text as bytes of int32."""
    if not text:
        return b""
    words = _words(path)
    pieces = text.split(" ")
    if MARK not in text and "" not in pieces:
        return b"".join([words[w] for w in pieces])
    marked = MARK + text.replace(" ", MARK)
    return b"".join(
        [words[p[1:]] if p[1:2] != MARK and len(p) > 1 and p[0] == MARK else np.array(_pieces(path).encode_part(p), np.int32).tobytes() for p in _PARTS.findall(marked)]
    )


def _outside(schema: T.StructType, *names: str) -> list[T.StructField]:
    return [f for f in schema.fields if f.name not in names]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int); a column of that name is replaced.

    With ``decoded`` the ids are decoded again in the same pass, into a column so named.
    """
    ship(docs.sparkSession)
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    new += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    kept = _outside(docs.schema, *(f.name for f in new))
    schema = T.StructType([*kept, *new])
    field = pa.field("element", pa.int32(), nullable=False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in tb.text_slices(batch, text):
                cells = [encode_text(x, path) for x in texts]
                ends = np.cumsum([0] + [len(c) // 4 for c in cells])
                values = np.frombuffer(b"".join(cells), np.int32)
                columns = [rows.column(f.name) for f in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), type=pa.list_(field)))
                if decoded:
                    columns.append(pa.array(decode_ids(values, ends, path), pa.string()))
                yield pa.record_batch(columns, names=schema.names)
        tb.give_back()

    return docs.select(*(f.name for f in kept), *([text] if text not in [f.name for f in kept] else [])).mapInArrow(work, schema)


class _Surfaces:
    """Bytes of every id end to end; spaces for marks, one byte for byte pieces."""

    def __init__(self, path: str):
        model = _pieces(path)
        special = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
        cells = [
            special.get(i, t.replace(MARK, " ").encode() if t in model.ids else b"") for i, t in enumerate(model.texts)
        ]
        self.data = np.frombuffer(b"".join(cells), np.uint8)
        self.sizes = np.array([len(c) for c in cells], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.marked = np.array([t.startswith(MARK) and t in model.ids for t in model.texts])


@lru_cache(maxsize=2)
def _surfaces(path: str) -> _Surfaces:
    return _Surfaces(path)


def _valid(raw: bytes) -> str:
    """UTF-8 text; each byte that belongs to no character becomes one replacement mark."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def decode_ids(ids: np.ndarray, bounds: np.ndarray, path: str) -> list[str]:
    """Texts of several id sequences that lie end to end in ``ids``."""
    table = _surfaces(path)
    sizes = table.sizes[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.repeat(table.starts[ids] - ends[:-1], sizes)
    data = table.data[np.arange(ends[-1]) + shift].tobytes()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        # Ids without a surface come before the text; the first one with a surface may
        # begin with a mark.
        seen = int(np.searchsorted(ends, ends[a], side="right")) - 1
        first = int(ends[a]) + (1 if seen < b and table.marked[ids[seen]] else 0)
        out.append(_valid(data[first : int(ends[b])]))
    return out


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids``; null ids give an empty text."""
    ship(rows.sparkSession)
    kept = _outside(rows.schema, text)
    schema = T.StructType([*kept, T.StructField(text, T.StringType(), False)])
    block = 1 << 19

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(pc.fill_null(pc.list_value_length(batch.column(ids)), 0), np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + block, side="right")) - 1)
                part = batch.slice(first, last - first)
                values = part.column(ids).flatten().to_numpy(zero_copy_only=False)
                texts = decode_ids(values, ends[first : last + 1] - ends[first], path)
                yield pa.record_batch(
                    [*(part.column(f.name) for f in kept), pa.array(texts, pa.string())], names=schema.names
                )
                first = last

    return rows.mapInArrow(work, schema)


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
