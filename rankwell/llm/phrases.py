"""Phrase collocations: which runs of two to four words belong together, per language.

Counting is direct-address tiling. Frequent words get ids by rank of frequency, so the
pairs that occur most fall into the few tiles at the head of the (left id, right id) grid.
Those tiles are counted in dense arrays (``np.bincount`` over the cell number); the many
others are sparse and counted as sorted coordinate lists. The frequent pairs are then
ranked in turn and stand for one unit each, so (pair, word) is again a pair: three and four
words are counted by the same step, over ever shorter sequences.

How it spreads: texts are cut into blocks of a MB in one language. A block knows its own
distinct words and learns their ids by a join, so no vocabulary is broadcast and no task
holds more than its blocks. A block sends its counts summed and packed; counts of one tile
meet in groups of ``FAN`` blocks, the sums in groups again, so a hot tile is never one
task's work, and what a group holds is bounded by the cells of its tiles. The ids of
frequent pairs go back the same way, to groups of ``FAN`` blocks for each tile.

Measures are exact: counts are whole numbers, and scores are decimal quotients.

Rows: a null or empty text has no words, a null language is ``und``. Repeated rows count
each. ``doc_id`` and other columns are ignored. A text of any length is one block at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .ranks import numbered
from .staging import discard, staged

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
INSIDE_PERCENT = 80
UNKNOWN = "und"
BLOCK_BYTES = 1 << 20
TILE = 512
HEAD_TILES = 8  # tiles with both numbers below this are dense
SLICE_WORDS = 2_000_000
PART_WORDS = 500_000  # of the blocks of one task
FAN = 64

BLOCK = "block long, lang string, n long, words array<string>, counts array<int>, codes binary"
ENTRY = "home long, block long, left binary, right binary, times binary"
KNOWN = "block long, left binary, right binary, id binary"
SEQUENCE = "block long, unit binary, word binary"


def _gaps() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that part words, and those among them that part pieces."""
    cut = np.zeros(256, bool)
    cut[list(b".,;:!?")] = True
    cut[10:14] = True
    gap = cut.copy()
    gap[[32, 9]] = True
    return gap, cut


def _block_codes(block: tb.Texts) -> tuple[list[int] | np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the block's words from 1, 0 between pieces; start, end and count of each code's word."""
    gap, cut = _gaps()
    start, end, bounds = tb.words(block, gap)
    if not len(start):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, zero
    one, two = (tb.word_hashes(block, start, end, seed) for seed in (0, 1))
    _, first, code, counts = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    if (two[first][code] != two).any():  # 64 bits of two words agree: tell them by 128
        both = np.stack([one, two], axis=1)
        _, first, code, counts = np.unique(both, axis=0, return_index=True, return_inverse=True, return_counts=True)
        code = code.reshape(-1)
    # The most frequent words get the least codes, whose high bytes are zero.
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code, first, counts = rank[code], first[order], counts[order]
    cuts = np.concatenate([[0], np.cumsum(cut[block.data])])
    parted = np.ones(len(start), bool)
    parted[1:] = cuts[start[1:]] > cuts[end[:-1]]
    parted[bounds[:-1][np.diff(bounds) > 0]] = True
    codes = np.zeros(len(start) + int(parted.sum()), np.int64)
    codes[np.arange(len(start)) + np.cumsum(parted)] = code + 1
    return codes, start[first], end[first], counts


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts in one language: distinct lowered words, their counts, and the words as codes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column("text").filter(pa.array(langs == lang))
                for block in tb.blocks(texts, BLOCK_BYTES):
                    block.data = tb.lowered(block.data)
                    codes, start, end, counts = _block_codes(block)
                    if not len(codes):
                        continue
                    data = block.data.tobytes()
                    words = [data[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
                    cells = [made, lang, int(counts.sum()), words, counts.astype(np.int32), tb.planes(codes.astype(np.int32)).tobytes()]
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
                    yield pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])
                    made += 1
        tb.give_back()

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    return rows.mapInArrow(work, BLOCK)


def _row(schema: str, *cells: object) -> pa.RecordBatch:
    """One row: numbers as they are, arrays of int64 as bytes by planes."""
    packed = [pa.array([tb.planes(c).tobytes()], pa.binary()) if isinstance(c, np.ndarray) else pa.array([c], pa.int64()) for c in cells]
    return pa.record_batch(packed, names=[c.split()[0] for c in schema.split(", ")])


def _int64(column: pa.Array, i: int) -> np.ndarray:
    return tb.unplanes(np.frombuffer(column[i].as_buffer(), np.uint8), np.int64)


def _sequences(held: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """``block, unit, word``: the ids of frequent words, others and cuts as -1."""
    local = held.select("block", "lang", F.posexplode("words").alias("place", "word")).withColumn("code", F.col("place") + 1)
    known = local.join(words, ["lang", "word"]).select("block", "code", "id").repartition(parts, "block")
    known = known.groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("known"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = tb.unplanes(np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint8), np.int32)
                pairs = batch.column("known")[i].values
                table = np.full(int(codes.max()) + 1, -1, np.int64)
                table[pairs.field("code").to_numpy()] = pairs.field("id").to_numpy()
                ids = table[codes]
                # Only where two frequent words meet there is a phrase.
                keep = ids >= 0
                keep[1:] |= ids[:-1] >= 0
                ids = ids[keep]
                yield _row(SEQUENCE, batch.column("block")[i].as_py(), _shifted(ids[:0]), _shifted(ids))
        tb.give_back()

    return held.select("block", "codes").repartition(parts, "block").join(known, "block").mapInArrow(work, SEQUENCE)


def _shifted(ids: np.ndarray) -> np.ndarray:
    """Ids from 1 and 0 for none, which pack better than -1."""
    return ids + 1


def _sequence(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Units and words of a sequence; single words are units themselves and kept once."""
    unit, word = (_int64(batch.column(c), i) - 1 for c in ("unit", "word"))
    return (unit if len(unit) else word), word


def _meeting(unit: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """Places where a unit of ``size`` words and the word after it can be one longer phrase."""
    if len(unit) <= size:
        return np.zeros(0, np.int64)
    ok = (unit[:-size] >= 0) & (word[size:] >= 0)
    if size > 1:  # the phrase without its first word is frequent too
        ok &= unit[1 : len(unit) - size + 1] >= 0
    return np.flatnonzero(ok)


def _reduced(left: np.ndarray, right: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorted coordinate list with equal cells added up; without ``times`` each counts once."""
    if len(left) and max(int(left.max()), int(right.max())) < 1 << 31:
        key = left << 32 | right  # one number to sort by
        if times is None:
            key, times = np.unique(key, return_counts=True)
            return key >> 32, key & 0xFFFFFFFF, times
        order = np.argsort(key)
    else:
        order = np.lexsort((right, left))
    times = np.ones(len(left), np.int64) if times is None else times
    left, right, times = left[order], right[order], times[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return left[at], right[at], np.add.reduceat(times, at) if len(at) else times


def _homes(left: np.ndarray, right: np.ndarray, slices: int) -> np.ndarray:
    """Where a cell is counted: its own tile (below 0) if dense, else its tile's slice."""
    x, y = left // TILE, right // TILE
    spread = tb.mix(tb.mix(x.astype(np.uint64)) + y.astype(np.uint64)) % np.uint64(slices)
    return np.where((x < HEAD_TILES) & (y < HEAD_TILES), -1 - (x * HEAD_TILES + y), spread.astype(np.int64))


def _entries(sequences: DataFrame, size: int, slices: int) -> DataFrame:
    """Counts of (unit, next word) of each block, by the home of their cells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                unit, word = _sequence(batch, i)
                at = _meeting(unit, word, size)
                if not len(at):
                    continue
                left, right, times = _reduced(unit[at], word[at + size])
                home = _homes(left, right, slices)
                if slices < 1 << 15:  # short numbers sort in linear time
                    home = home.astype(np.int16)
                order = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.diff(home[order])) + 1
                block = batch.column("block")[i].as_py()
                for part in np.split(order, cuts):
                    yield _row(ENTRY, int(home[part[0]]), block, left[part], right[part], times[part])
        tb.give_back()

    return sequences.mapInArrow(work, ENTRY)


def _sums(home: int, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All counts of a home: one dense array of its tile's cells, or a sorted list."""
    dense = np.zeros(TILE * TILE, np.int64) if home < 0 else None
    zero = np.zeros(0, np.int64)
    total = (zero, zero, zero)
    for batch in batches:
        left, right, times = (
            np.concatenate([_int64(batch.column(c), i) for i in range(batch.num_rows)]) for c in ("left", "right", "times")
        )
        if dense is not None:
            # Sums of one batch are far below 2**53, where these weights are exact.
            cells = left % TILE * TILE + right % TILE
            dense += np.bincount(cells, weights=times, minlength=TILE * TILE).astype(np.int64)
        else:
            total = _reduced(*(np.concatenate(p) for p in zip(total, (left, right, times))))
    if dense is None:
        return total
    cells = np.flatnonzero(dense)
    x, y = divmod(-1 - home, HEAD_TILES)
    return x * TILE + cells // TILE, y * TILE + cells % TILE, dense[cells]


def _frequent(entries: DataFrame, n_blocks: int, min_count: int) -> DataFrame:
    """``left, right, a``: the cells that occur at least ``min_count`` times in all blocks."""
    held: list[DataFrame] = []
    while n_blocks > FAN:
        groups = -(-n_blocks // FAN)
        salted = entries.withColumn("block", F.pmod(F.xxhash64("block", "home"), F.lit(groups)))

        def some(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home, block = key[0].as_py(), key[1].as_py()
            yield _row(ENTRY, home, block, *_sums(home, batches))

        sums = staged(salted.groupBy("home", "block").applyInArrow(some, ENTRY), "sums")
        discard(*held)
        entries, held, n_blocks = sums, [sums], groups

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, times = _sums(key[0].as_py(), batches)
        keep = times >= min_count
        yield pa.record_batch([pa.array(x[keep]) for x in (left, right, times)], names=["left", "right", "a"])

    found = staged(entries.groupBy("home").applyInArrow(total, "left long, right long, a long"), "frequent")
    discard(*held)
    return found


def _answers(entries: DataFrame, units: DataFrame, slices: int, n_blocks: int) -> DataFrame:
    """``KNOWN``: for each block the frequent ones among its pairs, with their ids.

    The frequent cells of a home meet its entries in groups of about ``FAN`` blocks.
    """

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("left", "right", "id")]
            homes = _homes(columns[0], columns[1], slices)
            yield pa.record_batch([pa.array(x) for x in (homes, *columns)], names=["home", "left", "right", "id"])

    def packed(table: pa.Table) -> pa.Table:
        cells = [table.column(c).to_numpy() for c in ("left", "right", "id")]
        return pa.Table.from_batches([_row("home long, left binary, right binary, times binary", table.column("home")[0].as_py(), *cells)])

    homes = units.select("left", "right", "id").mapInArrow(at_home, "home long, left long, right long, id long")
    held = staged(homes.groupBy("home").applyInArrow(packed, "home long, left binary, right binary, times binary"), "held")
    groups = -(-n_blocks // FAN)
    answers = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = entries.select("home", F.pmod(F.xxhash64("block", "home"), F.lit(groups)).cast("int").alias("salt"), "block", "left", "right", F.lit(None).cast("binary").alias("times"))
    both = asked.unionAll(answers.select("home", "salt", F.lit(None).cast("long").alias("block"), "left", "right", "times"))

    def told(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting = None, []
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                left, right = _int64(batch.column("left"), i), _int64(batch.column("right"), i)
                if block is None:
                    known = _Pairs(left, right, _int64(batch.column("times"), i))
                else:
                    waiting.append((block, left, right))
        for block, left, right in waiting if known else ():
            ids = known.ids(left, right)
            hit = ids >= 0
            if hit.any():
                yield _row(KNOWN, block, left[hit], right[hit], ids[hit])

    return both.groupBy("home", "salt").applyInArrow(told, KNOWN)


class _Pairs:
    """Ids of known pairs: both sides by their rank among those that occur."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        self.lefts, self.rights = np.unique(left), np.unique(right)
        key = np.searchsorted(self.lefts, left) * len(self.rights) + np.searchsorted(self.rights, right)
        order = np.argsort(key)
        self.key, self.found = key[order], ids[order]

    def ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair, -1 for those unknown."""
        x = np.minimum(np.searchsorted(self.lefts, left), len(self.lefts) - 1)
        y = np.minimum(np.searchsorted(self.rights, right), len(self.rights) - 1)
        wanted = x * len(self.rights) + y
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        hit = (self.lefts[x] == left) & (self.rights[y] == right) & (self.key[at] == wanted)
        return np.where(hit, self.found[at], -1)


def _longer(sequences: DataFrame, known: DataFrame, size: int, parts: int) -> DataFrame:
    """Sequences whose units are the frequent phrases of ``size + 1`` words."""
    nothing = F.lit(None).cast("binary")
    both = sequences.select("block", "unit", "word", nothing.alias("id")).unionAll(known.select("block", "left", "right", "id"))

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sequence = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("id")[i].is_valid:
                    cells.append(tuple(_int64(batch.column(c), i) for c in ("unit", "word", "id")))
                else:
                    sequence = _sequence(batch, i)
        if not cells:
            return
        unit, word = sequence
        pairs = _Pairs(*(np.concatenate(c) for c in zip(*cells)))
        at = _meeting(unit, word, size)
        new = np.full(len(unit), -1, np.int64)
        new[at] = pairs.ids(unit[at], word[at + size])
        # A unit needs the words up to the one after it, and no others.
        keep = np.zeros(len(unit), bool)
        for shift in range(size + 2):
            keep[shift:] |= new[: len(new) - shift] >= 0
        yield _row(SEQUENCE, key[0].as_py(), _shifted(new[keep]), _shifted(word[keep]))

    return both.repartition(parts, "block").groupBy("block").applyInArrow(work, SEQUENCE)


def frequent_phrases(held: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, size, a`` of all phrases up to ``longest`` words that occur ``min_count`` times.

    ``held`` are written ``blocks``.
    """
    n_blocks, n_words = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = max(1, -(-n_words // SLICE_WORDS))
    parts = max(held.sparkSession.sparkContext.defaultParallelism, -(-n_words // PART_WORDS))
    each = held.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", "x.words", "x.counts")
    counted = each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("a")).where(F.col("a") >= min_count)
    words = staged(numbered(staged(counted, "words"), [F.desc("a"), F.col("lang"), F.col("word")]), "word_ids")
    sequences = staged(_sequences(held, words.select("lang", "word", "id"), parts), "sequences")

    phrases = words.select("id", "lang", F.col("word").alias("phrase"), "a")
    found = [phrases.select("lang", "phrase", F.lit(1).alias("size"), "a")]
    next_word = words.select(F.col("id").alias("right"), "word")
    for size in range(1, longest):
        entries = staged(_entries(sequences, size, slices), "entries")
        frequent = _frequent(entries, n_blocks, min_count)
        units = staged(numbered(frequent, [F.desc("a"), F.col("left"), F.col("right")]), "units")
        named = units.join(phrases.select(F.col("id").alias("left"), "lang", "phrase"), "left").join(next_word, "right")
        phrases = staged(named.select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "a"), "phrases")
        found.append(phrases.select("lang", "phrase", F.lit(size + 1).alias("size"), "a"))
        if size + 1 < longest:
            before = sequences
            sequences = staged(_longer(sequences, _answers(entries, units, slices, n_blocks), size, parts), "sequences")
            discard(before)
        discard(entries, frequent)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _parts(phrase: str, first, length) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, length), " ")


def _wide(column) -> F.Column:
    return column.cast("decimal(38,0)")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase's score is that of its weakest cut into two parts; phrases that mostly occur
    inside a longer candidate are left out.
    """
    held = staged(blocks(docs), "blocks")
    words = staged(held.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    units = staged(frequent_phrases(held, min_count, longest), "all_phrases")
    discard(held)
    candidates = units.where("size > 1")

    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("one", _parts("phrase", 1, F.col("k"))).withColumn("two", _parts("phrase", F.col("k") + 1, F.col("size") - F.col("k")))
    left = units.select("lang", F.col("phrase").alias("one"), F.col("a").alias("l"))
    right = units.select("lang", F.col("phrase").alias("two"), F.col("a").alias("r"))
    both = cut.join(left, ["lang", "one"]).join(right, ["lang", "two"])
    score = F.expr(f"cast({SCALE} as decimal(9,0)) * cast(a as decimal(19,0)) div cast(cast(l as decimal(20,0)) + r as decimal(21,0))")
    weakest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))

    spans = F.sequence(F.lit(2), F.col("size") - 1)
    starts = candidates.where("size > 2").withColumn("length", F.explode(spans))
    starts = starts.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    inner = starts.groupBy("lang", _parts("phrase", F.col("first"), F.col("length")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * inside_percent)
    )

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = kept.select("lang", "phrase", "a", "x.l", "x.r", F.col("x.score").cast("long").alias("score"))
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = best.join(words, "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
