"""Token ids as compressed binary shards, with random access.

Documents in ascending ``doc_id`` are dealt to shards of consecutive documents. A shard's
id sequence is compressed by Re-Pair: pairs of neighbours that occur often are replaced by
new symbols (nonterminals), again and again, until no pair is frequent or the 16-bit
symbols are used up. Here each round replaces all pairs that are locally the most frequent,
so a shard takes some array passes instead of one per rule. No rule spans two documents, so a document is a stretch of the
compressed sequence; with the expansion length of every rule, any stretch of ids is read
without expanding what lies before it.

A shard is one row (the file format, kept in Parquet as binary cells, little-endian):

* ``shard`` long: number of the shard, ascending with ``doc_id``
* ``doc_ids`` int64, ``bounds`` uint32 (documents + 1): places in ``symbols``
* ``symbols`` uint16: ids below ``base``, and ``base + r`` for rule ``r``
* ``rules`` uint16 pairs, ``lengths`` uint32: the two symbols and the expansion of a rule

Rows: a null text counts as empty and holds the end id alone. Documents with a repeated
``doc_id`` are written side by side. Rows without ``doc_id`` are dropped.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textblocks as tb
from .staging import ship, staged

END_ID = 2
SHARD_TOKENS = 1_000_000
PARTITION_BYTES = 16 << 20
MIN_COUNT = 8
MIN_WINS = 4
BIN_BITS = 21
MAX_SYMBOL = 1 << 16
FEW = 150_000  # places that are counted by sorting
SLICE_BYTES = 4 << 20  # of text, encoded at a time
JOINED = 20_000  # characters of words that go through the library as one text
CACHE_WORDS = 700_000  # of each generation
CACHE_BYTES = 32 << 20
FIRST = "\0"  # marks a word that no space stands before
LAST_LATIN = "\u024f"
# Latin letters before a sign that is no letter, digit or white space.
SIDES = re.compile(r"(\0?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~].*)", re.DOTALL).fullmatch
SHARD = "shard long, doc_ids binary, bounds binary, symbols binary, rules binary, lengths binary, base int, n_tokens long"


def _quoted(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


# Texts that do not fall apart: white space side by side, at an end or other than space and
# line break, all that Python takes for such (none stands above U+3000); or FIRST.
_OTHERS = "".join(_quoted(c) for c in map(chr, range(0x3001)) if c == FIRST or c.isspace() and c not in " \n")
WHOLE = rf"\A[ \n]|[ \n]\z|[ \n][ \n]|[{_OTHERS}]"


def _portions(texts: list[str], limit: int) -> Iterator[list[str]]:
    """``texts`` in portions of ``limit`` characters, or of one longer text."""
    ends = np.cumsum([0, *map(len, texts)])
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield texts[first:last]
        first = last


class Words:
    """A byte-level BPE tokenizer that keeps the ids of the words it has met.

    Its first step cuts texts by a pattern in which a single space belongs to what
    follows, and a line break between two words stands alone. So a text whose white space
    is single spaces and line breaks falls apart at each of them; any other goes through
    the library whole. Arrow numbers the words of some texts, so each is looked up once.

    The memory has two generations: a full young one becomes the old one, and what is met
    again is young again, so only what is not met for a whole generation is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import ByteLevel

        # Threads of the library would be as many as the machine has cores, for each task.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.base = self.tokenizer.get_vocab_size()
        if self.base >= MAX_SYMBOL:
            raise ValueError("the vocabulary leaves no room for rules in 16 bits")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([WHOLE, *("".join(map(_quoted, s)) for s in special)])
        # A byte-level piece is written with one character for each byte.
        self.sizes = np.array([len(self.tokenizer.id_to_token(i)) for i in range(self.base)])
        written = ByteLevel().normalize_str
        self.written = {ord(c): written(c) for c in map(chr, range(ord(LAST_LATIN) + 1)) if c != "\n"}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of words and ids in ``known``

    def _library(self, texts: list[str]) -> list[bytes]:
        # What the library makes of a text takes many times its bytes.
        out = []
        for part in _portions(texts, tb.BLOCK_BYTES):
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            out += [np.array(x.ids, np.uint16).tobytes() for x in found]
        return out

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a space or line break, encoded as one text: it falls
        apart there, and the lengths of the ids' pieces tell where each word ends."""
        found = self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)
        ids = np.array(found[0].ids, np.uint16)
        ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(w.encode()) for w in words])) + 1
        raw = ids.tobytes()
        bounds = [0, *(2 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _lettered(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters after a space: each is one piece, so only the last
        step of the library is left, which takes a character for each byte."""
        tokenize = self.tokenizer.model.tokenize
        pieces = "\n".join([" " + w for w in words]).translate(self.written).split("\n")
        return [array("H", [t.id for t in tokenize(x)]).tobytes() for x in pieces if x]

    def _keep(self, words: list[str], cells: list[bytes]) -> None:
        self.known.update(zip(words, cells))
        self.held += sum(map(len, words)) + sum(map(len, cells))

    def _recall(self, words: list[str]) -> list[str]:
        """Make ``words`` young that the old generation knows; the others."""
        cells = list(map(self.old.get, words))
        met = {word: cell for word, cell in zip(words, cells) if cell is not None}
        self._keep(list(met), list(met.values()))
        return [word for word, cell in zip(words, cells) if cell is None]

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of different words that are not known.

        The pattern also cuts where a sign follows letters. Such a word is put together
        from its sides, which the library sees once for all words they stand in.
        """
        whole, cut = [], []
        for word in words:
            sides = None if word.isalpha() else SIDES(word)
            if sides:
                cut.append((word, sides[1], FIRST + sides[2]))
            else:
                whole.append(word)
        sides = {side for _, *pair in cut for side in pair}
        whole += self._recall([w for w in sides.difference(whole) if w not in self.known])
        # A word follows a space, but for a line break and what FIRST marks.
        lettered = [w for w in whole if w.isalpha() and (w.isascii() or max(w) <= LAST_LATIN)]
        self._keep(lettered, self._lettered(lettered))
        spaced = [w for w in set(whole).difference(lettered) if w[0] != FIRST and w != "\n"]
        for part in _portions(spaced, JOINED):
            self._keep(part, self._joined([" " + w for w in part]))
        first = [w for w in whole if w[0] == FIRST and w != FIRST]
        for part in _portions(first, JOINED):
            # The line break before a word is an id of its own.
            self._keep(part, [x[2:] for x in self._joined(["\n" + w[1:] for w in part])])
        others = [w for w in whole if w in (FIRST, "\n")]
        self._keep(others, self._library([w.lstrip(FIRST) for w in others]))
        known = self.known
        self._keep([word for word, _, _ in cut], [known[a] + known[b] for _, a, b in cut])

    def _cells(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known, self.old, self.held = {}, self.known, 0
        cells = list(map(self.known.get, words))
        gaps = [j for j, cell in enumerate(cells) if cell is None]
        if gaps:
            self._learn(self._recall([words[j] for j in gaps]))
            for j in gaps:
                cells[j] = self.known[words[j]]
        return cells

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as bytes of uint16."""
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, self.whole)
        none = pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), pc.if_else(whole, none, column), none)
        parts = pc.split_pattern(pc.replace_substring(marked, "\n", " \n " + FIRST), " ")
        words = parts.flatten().dictionary_encode()
        cells = pa.array(self._cells(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        ids = cells.take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[parts.offsets.to_numpy()].tolist()
        raw = ids.buffers()[2].to_pybytes() if ends[-1] else b""
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        whole = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def _starts(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _counted(code: np.ndarray, turn: int, speaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bin for each pair, its count (-1 where another pair speaks for the bin), and the
    pair that speaks for each bin."""
    if len(code) <= FEW:
        pairs, bins, counts = np.unique(code, return_inverse=True, return_counts=True)
        return bins, counts[bins], pairs
    factor = np.uint32((0x9E3779B1 + 0x3C6EF372 * turn) & 0xFFFFFFFF)
    bins = ((code * factor) >> np.uint32(32 - BIN_BITS)).astype(np.intp)
    speaks[bins] = code
    other = np.flatnonzero(speaks.take(bins) != code)
    counts = np.bincount(bins, minlength=1 << BIN_BITS)
    np.subtract.at(counts, bins.take(other), 1)
    found = counts.take(bins)
    found[other] = -1
    return bins, found, speaks


def compress(ids: np.ndarray, bounds: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, new bounds, rules (pairs) and expansion lengths of a shard's ids.

    Counts are kept up to date, not made anew: a pair that was counted and is not frequent
    can never become so, hence a round looks only at the places of frequent pairs, at
    those next to a replacement, and at those a table bin has not spoken for yet. It ends
    when no place is left or all symbols are used.
    """
    seq = ids.astype(np.uint32)
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    rules: list[np.ndarray] = []
    size = base
    lengths = np.ones(base, np.int64)
    speaks = np.zeros(1 << BIN_BITS, np.uint32)
    around = np.zeros(len(seq) + 2, np.int64)
    alive = np.ones(len(seq), bool)
    alive[-1:] = False
    alive[:-1] &= doc[:-1] == doc[1:]
    turn = 0
    while size < MAX_SYMBOL:
        places = np.flatnonzero(alive)
        if not len(places):
            break
        code = (seq[:-1] << np.uint32(16) | seq[1:]).take(places)
        bins, counts, spoken = _counted(code, turn, speaks)
        turn += 1
        some = counts >= MIN_COUNT
        alive[places] = some | (counts < 0)
        some = np.flatnonzero(some)
        places, bins, counts = places.take(some), bins.take(some), counts.take(some)
        if not len(places):
            continue
        # A strict order of pairs: among neighbours the greater one wins, and in a run of
        # one pair ("aaaa") every second place does.
        weight = counts << BIN_BITS | bins
        around[places + 1] = weight
        before, after = around.take(places), around.take(places + 2)
        around[places + 1] = 0
        wins = (weight > before) & (weight >= after)
        inner = np.flatnonzero(before == weight)
        if len(inner):
            run = _starts(inner - np.arange(len(inner)))
            number = np.arange(len(inner)) - np.repeat(run, np.diff(np.append(run, len(inner))))
            inner = inner[number % 2 == 1]
            wins[inner] = weight[inner] >= after[inner]
        # A bin stands for the pair that speaks for it: the others were not counted.
        wins = np.flatnonzero(wins)
        places, which = places.take(wins), bins.take(wins)
        times = np.bincount(which)
        best = np.flatnonzero(times >= min(MIN_WINS, times.max()))
        best = best[np.argsort(spoken[best])]
        if len(best) > MAX_SYMBOL - size:
            best = best[np.sort(np.argsort(-times[best], kind="stable")[: MAX_SYMBOL - size])]
        symbol = np.full(len(times), -1, np.int32)
        symbol[best] = size + np.arange(len(best))
        pairs = spoken[best].astype(np.int64)
        new = np.stack([pairs >> 16, pairs & 0xFFFF], axis=1)
        rules.append(new)
        lengths = np.concatenate([lengths, lengths[new].sum(axis=1)])
        size += len(best)
        given = symbol.take(which)
        some = np.flatnonzero(given >= 0)
        places, given = places.take(some), given.take(some)
        seq[places] = given
        left = np.ones(len(seq), bool)
        left[places + 1] = False
        left = np.flatnonzero(left)
        seq, doc, alive = seq.take(left), doc.take(left), alive.take(left)
        # What a new symbol makes with its neighbours has not been counted.
        changed = places - np.arange(len(places))
        alive[changed] = True
        alive[np.maximum(changed - 1, 0)] = True
        alive[-1:] = False
        alive[:-1] &= doc[:-1] == doc[1:]
    bounds = np.searchsorted(doc, np.arange(len(bounds)))
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq.astype(np.uint16), bounds.astype(np.uint32), table.astype(np.uint16), lengths[base:].astype(np.uint32)


class Shard:
    """One shard read back."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.bounds = np.frombuffer(row["bounds"], np.uint32).astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], np.uint16)
        rules = np.frombuffer(row["rules"], np.uint16).reshape(-1, 2)
        self.base = row["base"]
        sizes = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.sizes = np.concatenate([np.ones(self.base, np.int64), sizes])
        # All expansions end to end; a rule only names symbols made before it.
        cells = [i.to_bytes(2, "little") for i in range(self.base)]
        for left, right in rules.tolist():
            cells.append(cells[left] + cells[right])
        self.table = np.frombuffer(b"".join(cells), np.uint16)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[symbols] - (ends - sizes), sizes)
        return self.table[np.arange(len(shift)) + shift]

    def ends(self) -> np.ndarray:
        """Where documents end among the shard's ids, with a 0 before."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[self.symbols])])
        return ends[self.bounds]

    def document(self, i: int) -> np.ndarray:
        """Ids of the shard's document ``i``."""
        return self.expand(self.symbols[self.bounds[i] : self.bounds[i + 1]])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids from place ``start`` to before ``stop``, expanding only the symbols there."""
        ends = np.cumsum(self.sizes[self.symbols])
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : stop - before]


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs (doc_id, text)`` and write the shards; the table read back."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    ordered = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        end = np.array([end_id], np.uint16).tobytes()
        held: list[bytes] = []
        ids: list[int] = []
        tokens = made = 0

        def shard() -> pa.RecordBatch:
            bounds = np.cumsum([0] + [len(x) // 2 for x in held])
            parts = compress(np.frombuffer(b"".join(held), np.uint16), bounds, words.base)
            cells = [np.array(ids, np.int64), parts[1], parts[0], parts[2], parts[3]]
            return pa.record_batch(
                [pa.array([made], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in cells), pa.array([words.base], pa.int32()), pa.array([tokens], pa.int64())],
                names=[c.split()[0] for c in SHARD.split(", ")],
            )

        for batch in batches:
            for rows, texts in tb.text_slices(batch, "text", SLICE_BYTES):
                for doc_id, cell in zip(rows.column("doc_id").to_pylist(), words.encode(texts)):
                    held.append(cell + end)
                    ids.append(doc_id)
                    tokens += len(cell) // 2 + 1
                    if tokens >= shard_tokens:
                        yield shard()
                        held, ids, tokens, made = [], [], 0, made + 1
        if held:
            yield shard()
        tb.give_back()

    part = (F.spark_partition_id().cast("long") * F.lit(1 << 32)).alias("part")
    shards = ordered.mapInArrow(work, SHARD).select(part, "*")
    columns = [c.split()[0] for c in SHARD.split(", ")[1:]]
    return staged(shards.select((F.col("part") + F.col("shard")).alias("shard"), *columns), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, from the shards' bytes.

    ``start`` counts the ids of all documents before; shards are few (one for about a
    million ids), so their running total is a window over one short table.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("offset"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                ends = shard.ends()
                ids = memoryview(shard.expand(shard.symbols).astype("<u4")).cast("B")
                cuts = (4 * ends).tolist()
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids), pa.array(row["offset"] + ends[:-1]), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.join(placed, "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
