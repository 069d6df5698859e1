"""N-gram Jaccard join: documents whose word shingles overlap by a given share.

1. Each block of texts sends its shingles (64-bit hashes) to slices of the hash space, with
   the sets that hold them. Shingles held by just the same sets form one class, so a set
   becomes a short sorted array of (class, number of shingles), exact for every
   intersection. A shingle of one set only can be in no overlap; sets with too many of
   these are out.
2. Sets that can still overlap enough share a class among their rarest ones (prefix
   filter). Groups of such sets meet in tiles: cut by bands of set size, hot groups cut
   further by a hash, each pair of cuts one task. In a tile, bitmap signatures of hashed
   shingles bound each overlap from above: every bit that differs stands for at least one
   shingle that only one of the two has.
3. What passes is compared exactly on the sorted arrays, in the tile.

Only links that can join two components matter, so each group is first compared with one
of its members, and tiles are made where a group still holds several components. A tile
keeps track of the components it has joined and gives fewer links than it has members.

Rows: null texts and texts without words have an empty set, which links with nothing.
Equal sets are one node. Rows without ``doc_id`` are dropped; a repeated ``doc_id`` is one
document with the rows' sets side by side. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import components
from .ranks import numbered
from .staging import ship, staged

SHINGLE = 5
PERCENT = 75
SLICE_TEXT_BYTES = 8 << 20
GROUP_BYTES = 2 << 20
SIGNATURE_BITS = 1024
TILE = 512
TILE_CLASSES = 200_000  # entries of the sorted arrays on one side of a tile
# A band of set sizes spans this factor; partners lie in the same or the next band.
BAND = PERCENT / 100

REPLY, SEVERAL, DOC, MEMBER = 0, 1, 2, 3
SENT = "slice int, kind int, key binary, a binary, b binary, n binary, hashes binary"
TOLD = "kind int, key long, a long, b long, n int, sig binary, slice int"


def _starts(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def shingle_sets(block: tb.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document: numbers of documents, hashes, both sorted."""
    start, end, bounds = tb.words(block)
    rolling = tb.Rolling(tb.word_hashes(block, start, end, lower=True), 1)
    counts = np.diff(bounds)
    grams = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(block.n), grams)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams) + bounds[:-1][doc]
    last = first + np.minimum(size, counts)[doc]
    hashes = rolling(first, last)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[keep], hashes[keep]


def _signatures(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    bits = np.zeros((n_docs, SIGNATURE_BITS), bool)
    bits[doc, (tb.mix(hashes) % np.uint64(SIGNATURE_BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


class _Sent:
    """Rows for the slices, gathered for one record batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, slice_, kind, key, a=None, b=None, n=None, hashes=None):
        cells = [None if x is None else np.ascontiguousarray(x).tobytes() for x in (key, a, b, n, hashes)]
        self.rows.append((int(slice_), kind, *cells))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        names = [c.split()[0] for c in SENT.split(", ")]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)], names=names)


def _send(docs: DataFrame, slice_bits: int, size: int, seed: int) -> DataFrame:
    """Sets and their shingles, cut by slices. A set's key is a hash of its shingles."""
    n_slices = 1 << slice_bits
    salt = np.uint64(0xA5A5A5A5A5A5A5A5)
    turn = np.uint64(seed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for block in tb.blocks(batch.column("text"), GROUP_BYTES):
                sent = _Sent()
                doc, hashes = shingle_sets(block, size)
                at = _starts(doc)
                here = doc[at]
                counts = np.diff(np.append(at, len(doc)))
                ones = np.zeros(block.n, np.uint64)
                twos = np.zeros(block.n, np.uint64)
                if len(at):
                    length = counts.astype(np.uint64)
                    ones[here] = tb.mix(np.add.reduceat(tb.mix(hashes + turn), at) + length)
                    twos[here] = tb.mix(np.add.reduceat(tb.mix(hashes ^ salt), at) - length)
                n = np.zeros(block.n, np.int32)
                n[here] = counts
                signs = np.zeros((block.n, SIGNATURE_BITS // 8), np.uint8)
                for part in range(0, block.n, 2000):
                    rows = (doc >= part) & (doc < part + 2000)
                    size_ = min(2000, block.n - part)
                    signs[part : part + size_] = _signatures(doc[rows] - part, hashes[rows], size_)
                to = (ones % np.uint64(n_slices)).astype(np.int64)
                block_ids = ids[block.first : block.first + block.n]
                for s in np.unique(to):
                    x = to == s
                    sent.add(s, DOC, ones[x], block_ids[x], twos[x], n[x], signs[x])
                if len(at):
                    _send_shingles(sent, doc, hashes, ones, slice_bits)
                yield sent.batch()

    return docs.mapInArrow(tb.given_back(work), SENT)


def _send_shingles(sent, doc, hashes, ones, slice_bits) -> None:
    n_slices = 1 << slice_bits
    # Equal sets of this block are one set.
    _, first_with = np.unique(ones, return_index=True)
    chosen = np.zeros(len(ones), bool)
    chosen[first_with] = True
    keep = chosen[doc]
    doc, hashes = doc[keep], hashes[keep]
    order = np.argsort(hashes, kind="stable")
    doc, hashes = doc[order], hashes[order]
    at = _starts(hashes)
    held = np.diff(np.append(at, len(hashes)))
    key = np.add.reduceat(ones[doc], at)
    # Sets that share a shingle inside this block travel as one local class.
    shared = np.flatnonzero(held > 1)
    if len(shared):
        _, pick = np.unique(key[shared], return_index=True)
        group = shared[pick]
        to = (key[group] % np.uint64(n_slices)).astype(np.int64)
        for s in np.unique(to):
            g = group[to == s]
            sizes = held[g]
            rows = np.arange(sizes.sum()) + np.repeat(at[g] - (np.cumsum(sizes) - sizes), sizes)
            sent.add(s, MEMBER, np.repeat(key[g], sizes), ones[doc[rows]])
    # One row for each slice: its shingles in order as differences, each with the place of
    # its holder in a short table.
    value = hashes[at]
    cuts = np.searchsorted(value, np.arange(n_slices, dtype=np.uint64) << np.uint64(64 - slice_bits)) if slice_bits else [0]
    for s, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(value)])):
        if a == b:
            continue
        holders, pick, place = np.unique(key[a:b], return_index=True, return_inverse=True)
        steps = np.diff(value[a:b], prepend=np.uint64(0))
        sent.add(s, REPLY, holders, held[a:b][pick].astype(np.int32), None, tb.planes(place.astype(_places(len(holders)))), tb.planes(steps))


def _places(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _told(slice_, kind, key, a, b, n, sig=None) -> pa.RecordBatch:
    size = len(key)

    def long(x):
        return pa.array(np.ascontiguousarray(x).view(np.int64)) if x is not None else pa.nulls(size, pa.int64())

    columns = [
        pa.array(np.broadcast_to(np.asarray(kind, np.int32), size).copy()),
        long(key),
        long(a),
        long(b),
        pa.array(np.asarray(n, np.int32)) if n is not None else pa.nulls(size, pa.int32()),
        tb.binary(sig.reshape(-1), np.arange(size + 1) * sig.shape[1]) if sig is not None else pa.nulls(size, pa.binary()),
        pa.array(np.full(size, slice_, np.int32)),
    ]
    return pa.record_batch(columns, names=[c.split()[0] for c in TOLD.split(", ")])


def _answer(sent: DataFrame) -> DataFrame:
    """Classes of the shingles of each slice, told to the sets that hold them."""

    def work(slice_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dfs, places, values = [], [], [], []
        n_keys = 0
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            cells = {c: batch.column(c) for c in ("key", "a", "b", "n", "hashes")}

            def cell(name, i, dtype):
                return np.frombuffer(cells[name][i].as_buffer(), dtype)

            for i, kind in enumerate(kinds):
                key = cell("key", i, np.uint64)
                if kind == DOC:
                    sig = cell("hashes", i, np.uint8).reshape(len(key), -1)
                    yield _told(slice_, DOC, key, cell("a", i, np.int64), cell("b", i, np.uint64), cell("n", i, np.int32), sig)
                elif kind == MEMBER:
                    yield _told(slice_, MEMBER, key, cell("a", i, np.uint64), None, None)
                else:
                    keys.append(key.copy())
                    dfs.append(cell("a", i, np.int32).copy())
                    places.append(tb.unplanes(cell("n", i, np.uint8), _places(len(key))).astype(np.int32) + n_keys)
                    values.append(np.cumsum(tb.unplanes(cell("hashes", i, np.uint8), np.uint64)))
                    n_keys += len(key)
        if not keys:
            return
        one, df = np.concatenate(keys), np.concatenate(dfs)
        one, pick, same = np.unique(one, return_index=True, return_inverse=True)
        df = df[pick].astype(np.int64)
        who = same.astype(np.int32)[np.concatenate(places)]
        value = np.concatenate(values)
        del keys, dfs, places, values, same
        order = np.argsort(value)
        value = value[order]
        at = _starts(value)
        del value
        many = np.diff(np.append(at, len(order)))
        code = np.repeat(np.arange(len(at), dtype=np.int32), many)
        who = who[order]
        del order
        # A shingle that one set alone holds is in no overlap.
        keep = (many[code] > 1) | (df[who] > 1)
        key = code[keep].astype(np.uint64) << np.uint64(32) | who[keep].astype(np.uint64)
        del code, who, keep, at, many
        if not len(key):
            return
        key.sort()
        key = key[_starts(key)]
        who = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = _starts(key >> np.uint64(32))
        del key
        many = np.diff(np.append(at, len(who)))
        keep = np.add.reduceat(df[who], at) > 1
        at, many = at[keep], many[keep]
        if not len(at):
            return
        rows = np.arange(many.sum()) + np.repeat(at - (np.cumsum(many) - many), many)
        who = who[rows]
        begins = np.cumsum(many) - many
        unique, code = np.unique(np.add.reduceat(one[who], begins), return_inverse=True)
        pair = who.astype(np.uint64) * np.uint64(len(unique)) + np.repeat(code, many).astype(np.uint64)
        pair, count = np.unique(pair, return_counts=True)
        w = (pair // np.uint64(len(unique))).astype(np.int64)
        c = (pair % np.uint64(len(unique))).astype(np.int64)
        for a in range(0, len(w), 100_000):
            x, y = w[a : a + 100_000], c[a : a + 100_000]
            yield _told(slice_, np.where(df[x] > 1, SEVERAL, REPLY), one[x], unique[y], None, count[a : a + 100_000])

    def one_slice(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        yield from work(key[0].as_py(), batches)
        tb.give_back()  # what the slice held is gone by now

    return sent.groupBy("slice").applyInArrow(one_slice, TOLD)


def _enough(total: str, n: str, percent: int):
    return F.col(total) * 100 >= F.col(n) * percent


def _listed(parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, n, sig, classes``: sets whose classes of two or more can reach the share."""
    lists = parts.groupBy("key").agg(F.collect_list(F.struct("cls", "cnt")).alias("classes"), F.sum("cnt").alias("total"))
    return lists.join(sets, "key").where(_enough("total", "n", percent)).select("node", "n", "sig", "classes")


PACKED = "node long, n int, sig binary, central double, ids binary, cnts binary"


def _packed(ranked: DataFrame) -> DataFrame:
    """Sets with their sorted arrays as bytes: differences of class numbers, and counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("classes")
            offsets = lists.offsets.to_numpy()
            ids, cnts = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("id", "cnt"))
            parts = [(np.diff(ids[a:b], prepend=0), cnts[a:b].astype(np.int32)) for a, b in zip(offsets, offsets[1:])]
            cells = [pa.array([tb.planes(p[i]).tobytes() for p in parts], pa.binary()) for i in (0, 1)]
            yield pa.record_batch([*(batch.column(c) for c in ("node", "n", "sig", "central")), *cells], names=[c.split()[0] for c in PACKED.split(", ")])

    return ranked.select("node", "n", "sig", "central", "classes").mapInArrow(tb.given_back(work), PACKED)


def _arrays(batch: pa.RecordBatch | pa.Table, i: int, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Class numbers and counts of a row."""
    ids, cnts = (np.frombuffer(batch.column(c + side)[i].as_buffer(), np.uint8) for c in ("ids", "cnts"))
    return np.cumsum(tb.unplanes(ids, np.int64)), tb.unplanes(cnts, np.int32)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``cls, node, n, central``: the rarest classes of a set, up to where the rest is too small.

    Classes are numbered by ascending frequency, one order for all sets.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, n in enumerate(batch.column("n").to_pylist()):
                ids, cnts = _arrays(batch, i)
                rest = np.cumsum(cnts[::-1])[::-1]
                kept.append(ids[rest * 100 >= n * percent])
            rows = pa.array(np.repeat(np.arange(len(kept)), [len(k) for k in kept]))
            yield pa.record_batch(
                [pa.array(np.concatenate(kept)), *(batch.column(c).take(rows) for c in ("node", "n", "central"))], names=["cls", "node", "n", "central"]
            )

    return sets.select("node", "n", "central", "ids", "cnts").mapInArrow(tb.given_back(work), "cls long, node long, n int, central double")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose exact intersection reaches the share of the union."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "ids", "cnts")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                left, cnts = _arrays(batch, i, "_a")
                right, _ = _arrays(batch, i, "_b")
                hit = right[np.minimum(np.searchsorted(right, left), len(right) - 1)] == left
                both[i] = cnts[hit].sum()
            sizes = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            keep = pa.array(100 * both >= percent * (sizes - both))
            yield pa.record_batch([batch.column(s).filter(keep) for s in "ab"], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tb.given_back(work), "a long, b long")


def _overlaps(cls: np.ndarray, cnt: np.ndarray, offsets: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Size of the intersection of set ``i`` with each of ``others``, on the sorted arrays."""
    mine = cls[offsets[i] : offsets[i + 1]]
    sizes = offsets[others + 1] - offsets[others]
    ends = np.cumsum(sizes)
    rows = np.arange(ends[-1]) + np.repeat(offsets[others] - (ends - sizes), sizes)
    theirs = cls[rows]
    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
    return np.add.reduceat(np.where(hit, cnt[rows], 0), ends - sizes)


def tile_links(table: pa.Table, percent: int) -> pa.Table:
    """Links of a tile that join components: fewer than it has members.

    Pairs that size, component and signatures leave possible are compared exactly; once
    two components are joined, no pair of them is looked at again.
    """
    table = table.combine_chunks()
    col = {c: table.column(c).to_numpy() for c in ("node", "n", "root", "side")}
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(col["n"]), -1)
    arrays = [_arrays(table, i) for i in range(table.num_rows)]
    offsets = np.cumsum([0] + [len(x) for x, _ in arrays])
    cls, cnt = (np.concatenate(x) for x in zip(*arrays))
    label = np.unique(col["root"], return_inverse=True)[1]
    left, right = np.flatnonzero(col["side"] != 2), np.flatnonzero(col["side"] != 1)
    within = table.column("same")[0].as_py()
    m = col["n"][right].astype(np.int64)
    found = []
    for i in left:
        n = int(col["n"][i])
        ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (label[right] != label[i])
        if within:
            ok &= col["node"][right] > col["node"][i]
        j = right[ok]
        if not len(j):
            continue
        differ = np.bitwise_count(sig[j] ^ sig[i]).sum(axis=1, dtype=np.int64)
        both = (n + m[ok] - differ) // 2  # the overlap is at most this
        j = j[100 * both >= percent * (n + m[ok] - both)]
        if not len(j):
            continue
        both = _overlaps(cls, cnt, offsets, i, j)
        for k in j[100 * both >= percent * (n + col["n"][j] - both)]:
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                found.append((min(col["node"][i], col["node"][k]), max(col["node"][i], col["node"][k])))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _tile_links(rows: DataFrame, percent: int) -> DataFrame:
    def tile(table: pa.Table) -> pa.Table:
        return tile_links(table, percent)

    return rows.groupBy("cls", "band", "one", "next", "two").applyInArrow(tile, "a long, b long")


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """Rows of ``members (cls, node, n, root, sig, ids, cnts)`` once for each tile they take part in."""
    banded = members.withColumn("band", F.floor(F.log("n") / F.lit(-float(np.log(BAND)))).cast("int"))
    room = F.greatest(F.count("*") / tile, F.sum(F.length("cnts") / 4) / TILE_CLASSES)
    sizes = staged(banded.groupBy("cls", "band").agg(F.ceil(room).cast("int").alias("cuts")), "cuts")
    after = sizes.select("cls", (F.col("band") - 1).alias("band"), F.col("cuts").alias("after"))
    before = sizes.select("cls", (F.col("band") + 1).alias("band"), F.col("cuts").alias("before"))
    plan = staged(sizes.join(after, ["cls", "band"], "left").join(before, ["cls", "band"], "left"), "plan")
    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    rows = banded.join(plan, ["cls", "band"]).withColumn("cut", cut)
    within = rows.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    ).select(
        "cls", "node", "n", "root", "sig", "ids", "cnts", "band", F.least("cut", "other").alias("one"),
        F.lit(0).alias("next"), F.greatest("cut", "other").alias("two"),
        F.when(F.col("cut") == F.col("other"), 0).when(F.col("cut") < F.col("other"), 1).otherwise(2).alias("side"),
        (F.col("cut") == F.col("other")).alias("same"),
    )
    upper = rows.where("after is not null").select(
        "cls", "node", "n", "root", "sig", "ids", "cnts", "band", F.col("cut").alias("one"), F.lit(1).alias("next"),
        F.explode(F.sequence(F.lit(0), F.col("after") - 1)).alias("two"), F.lit(1).alias("side"), F.lit(False).alias("same"),
    )
    lower = rows.where("before is not null").select(
        "cls", "node", "n", "root", "sig", "ids", "cnts", (F.col("band") - 1).alias("band"),
        F.explode(F.sequence(F.lit(0), F.col("before") - 1)).alias("one"), F.lit(1).alias("next"),
        F.col("cut").alias("two"), F.lit(2).alias("side"), F.lit(False).alias("same"),
    )
    return within.unionAll(upper).unionAll(lower)


def jaccard_components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, tile: int = TILE
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the least ``doc_id`` reachable by links."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slice_bits = max(0, int(size // SLICE_TEXT_BYTES)).bit_length()
    seed = 0
    while True:
        told = staged(_answer(_send(docs, slice_bits, shingle, seed)), "told")
        rows = told.where(F.col("kind") == DOC)
        sets = rows.where("n > 0").groupBy("key").agg(
            F.min("a").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("b").alias("b1"), F.max("b").alias("b2")
        )
        sets = staged(sets, "sets")
        if sets.where("b1 != b2").isEmpty():
            break
        seed += 1  # two sets with one key: other keys

    # A set of several blocks is told the count of a slice once for each of its local
    # classes there, always the same: it counts once a slice.
    member = staged(told.where(F.col("kind") == MEMBER).select("key", F.col("a").alias("member")).distinct(), "members")
    several = told.where(F.col("kind") == SEVERAL).join(member, "key")
    parts = (
        told.where(F.col("kind") == REPLY)
        .select("key", F.col("a").alias("cls"), "slice", "n")
        .unionAll(several.select(F.col("member").alias("key"), F.col("a").alias("cls"), "slice", "n"))
        .repartition("key")  # once for all that follows by set
        .groupBy("key", "cls", "slice")
        .agg(F.max("n").alias("n"))
        .groupBy("key", "cls")
        .agg(F.sum("n").alias("cnt"))
    )
    listed = staged(_listed(parts, sets.drop("b1", "b2"), percent), "listed")

    # Among what is left, classes are smaller: only those of two sets or more still count.
    # They are numbered by frequency, so sorted arrays are short differences.
    exploded = listed.select("node", F.explode("classes").alias("x")).select("node", "x.cls", "x.cnt")
    left = staged(exploded.groupBy("cls").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    classes = staged(numbered(left, [F.col("df"), F.col("cls")]), "classes")
    ranked = (
        exploded.join(classes, "cls")
        .groupBy("node")
        .agg(
            F.sort_array(F.collect_list(F.struct("id", "cnt"))).alias("classes"),
            F.sum("cnt").alias("total"),
            F.sum(F.col("cnt") * F.col("df")).alias("met"),
        )
        .join(listed.select("node", "n", "sig"), "node")
        .where(_enough("total", "n", percent))
        .withColumn("central", F.col("met") / F.col("n"))
    )
    packed = staged(_packed(ranked), "packed")
    prefixes = staged(_prefixes(packed, percent), "prefixes")

    # First each group against one member, the one whose shingles most others hold; then
    # tiles where components still meet. What is joined by class is written before, so that
    # Spark can split a hot class.
    chosen = F.max(F.struct("central", (-F.col("node")).alias("node"), "n")).alias("x")
    heads = prefixes.groupBy("cls").agg(chosen).select("cls", (-F.col("x.node")).alias("a"), F.col("x.n").alias("n_a"))
    heads = staged(heads, "heads")
    close = F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent
    first_pairs = prefixes.join(heads, "cls").where("node != a").where(close).select("a", F.col("node").alias("b")).distinct()
    first_links = staged(_links(first_pairs, packed, percent), "first_links")
    roots = staged(components(first_links), "first_roots")

    placed = staged(prefixes.join(roots, "node", "left").select("cls", "node", "n", F.coalesce("root", "node").alias("root")), "placed")
    mixed = staged(placed.groupBy("cls").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("cls"), "mixed")
    meeting = placed.join(mixed, "cls").join(packed.select("node", "sig", "ids", "cnts"), "node")
    more = _tile_links(_tiles(staged(meeting, "meeting"), tile), percent)
    found = components(staged(first_links.unionAll(more), "all_links"))

    named = rows.join(sets.select("key", "node"), "key", "left")
    return (
        named.join(found, "node", "left")
        .groupBy(F.col("a").alias("doc_id"))
        .agg(F.sum("n").cast("long").alias("n_shingles"), F.min(F.coalesce("root", "node", "a")).alias("component_id"))
    )
