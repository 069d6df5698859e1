"""Personal data in whole texts: fixed patterns, and what a trained tagger finds beside them.

1. Base spans: e-mail addresses, IP addresses, card and phone numbers by pattern, leftmost
   and not overlapping within a kind. Every search is linear in the text.
2. A character tagger (bidirectional LSTM with CRF transitions, ``char_tagger``) learns
   from labelled spans, in the texts and in disguise (``a at b dot c``, ``1[.]2[.]3[.]4``,
   numbers with other separators), so it marks forms that no pattern names.
3. Texts are cut into overlapping windows, whatever their length. Each window is decoded;
   two neighbours change over where both see no data, as near to the middle of what they
   share as can be, and the runs of equal tags over the whole document are the tagger's
   spans. A span counts if its kind's check holds (parts of an address, number of digits,
   Luhn) and it overlaps no base span.

The tagger is fitted on a bounded sample: at most ``SAMPLE_SPANS`` labelled passages of
each kind and as many without a span, picked by a hash.

Rows: a null text counts as empty and has no spans. Repeated rows and rows with equal ids
each get a row. Places count code points, ends are exclusive. Without any labelled span
only base spans are given. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .staging import ship, staged
from .char_tagger import PAD, Decoder, Weights, symbols, train

KINDS = ("email", "ip", "card", "phone")
SAMPLE_SPANS = 400
SAMPLE_DOCS = 40_000
AROUND = 40
TRAIN_WINDOW = 120
STEPS = 400
WINDOW = 640
OVERLAP = 64
BLOCK_BYTES = 1 << 20
SPAN = "array<struct<kind: string, start: int, end: int, base: boolean>>"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part holds no ``@``, so each one is the run before an ``@`` with a host."""
    end, after = 0, 0
    at = text.find("@")
    while at >= 0:
        floor = max(end, after)
        run = text[floor:at]
        start = floor + len(run.rstrip(_LOCAL))
        host = _HOST.match(text, at) if start < at else None
        if host:
            yield start, host.end()
            end = host.end()
        after = at + 1
        at = text.find("@", after)


def _small(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) < 4 and int(number or "0") <= 255


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers of a chain joined by dots, from its start."""
    for chain in _NUMBERS.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts = list(_DIGITS.finditer(text, *chain.span()))
        for i in range(0, len(parts) - 3, 4):
            if all(_small(p.group()) for p in parts[i : i + 4]):
                yield parts[i].start(), parts[i + 3].end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of all pattern matches that pass, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        out += [(a, 1, b) for a, b in _addresses(text)]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and _card(m.group())]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _phone(m.group())]
    return sorted(out)


# What a span found by the tagger has to look like.
_AT = r"\s*(?:@|[(\[{<]\s*(?:at|@)\s*[)\]}>]|\s+at\s+)\s*"
_DOT = r"\s*(?:\.|[(\[{<]\s*(?:dot|\.)\s*[)\]}>]|\s+dot\s+)\s*"
_EMAIL_LIKE = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
_IP_LIKE = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.IGNORECASE)
_CARD_LIKE = re.compile(r"[0-9]+(?:[ ()./_-]{1,3}[0-9]+)*")
_PHONE_LIKE = re.compile(r"[+(]?[0-9]+(?:[ ()./-]{1,2}[0-9]+)+")


def _holds(kind: int, text: str) -> bool:
    if len(text) > OVERLAP:
        return False  # longer than what two windows share: seen whole by none for certain
    if kind == 0:
        return _EMAIL_LIKE.fullmatch(text) is not None
    if kind == 1:
        return _IP_LIKE.fullmatch(text) is not None and all(_small(n) for n in _DIGITS.findall(text))
    if kind == 2:
        return _CARD_LIKE.fullmatch(text) is not None and _card(text)
    return _PHONE_LIKE.fullmatch(text) is not None and _phone(text)


def disguised(text: str, kind: int, rng: np.random.Generator) -> str:
    """A labelled span as one may write it to escape a pattern."""

    def pick(options: Sequence[str]) -> str:
        return options[int(rng.integers(len(options)))]

    if kind == 0:
        at, dot = pick((" at ", " (at) ", "(at)", " [at] ", " @ ")), pick((" dot ", "[.]", " (dot) ", "."))
        name, _, host = text.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return text.replace(".", pick(("[.]", "(.)", " . ", " dot ")))
    digits = _digits(text)
    if kind == 2:
        mark = pick((".", "/", "_", " - ", "  "))
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    mark = pick((" ", "-", ".", "/"))
    head, rest = digits[:-10], digits[-10:]
    body = mark.join([rest[:3], rest[3:6], rest[6:]])
    return pick((f"00{head}{mark}{body}", f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"+{head}/{body.replace('.', '/')}"))


Passage = tuple[str, list[tuple[int, int, int]]]


def labelled_passages(docs: DataFrame, sample: int = SAMPLE_SPANS, sample_docs: int = SAMPLE_DOCS) -> list[Passage]:
    """Texts around base spans and around other digits, at most ``sample`` of each kind.

    Taken from about ``sample_docs`` documents, picked by a hash of their texts; never more
    than ``5 * sample`` short passages reach the driver.
    """
    ship(docs.sparkSession)
    rows = docs.where("text is not null").select("text")
    n = rows.count()
    if n > sample_docs:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) < sample_docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, passages, spans = [], [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text)
                for a, kind, b in found:
                    if b - a <= TRAIN_WINDOW // 2:
                        kinds.append(kind)
                        first = max(0, a - AROUND)
                        passages.append(text[first : b + AROUND])
                        spans.append([(s - first, k, e - first) for s, k, e in found if first <= s and e <= b + AROUND])
                # The first place free of spans, with a digit where the text has one.
                other = next((m.start() for m in _DIGITS.finditer(text) if not any(s <= m.start() < e for s, _, e in found)), 0)
                first = max(0, other - AROUND)
                if not any(s < other + AROUND and first < e for s, _, e in found):
                    kinds.append(len(KINDS))
                    passages.append(text[first : other + AROUND])
                    spans.append([])
            cells = [[{"s": s, "k": k, "e": e} for s, k, e in x] for x in spans]
            span = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
            yield pa.record_batch(
                [pa.array(kinds, pa.int32()), pa.array(passages, pa.string()), pa.array(cells, span)], names=["kind", "passage", "spans"]
            )

    schema = "kind int, passage string, spans array<struct<s: int, k: int, e: int>>"
    found = staged(rows.mapInArrow(work, schema), "passages").dropDuplicates(["kind", "passage"])
    first = None
    for kind in range(len(KINDS) + 1):
        part = found.where(F.col("kind") == kind).orderBy(F.xxhash64("passage"), "passage").limit(sample)
        first = part if first is None else first.unionAll(part)
    rows = sorted(first.collect(), key=lambda r: (r["kind"], r["passage"]))
    return [(r["passage"], [(x["s"], x["k"], x["e"]) for x in r["spans"]]) for r in rows]


def fit(passages: list[Passage], steps: int = STEPS, seed: int = 7) -> Weights | None:
    """A tagger for ``passages``: texts with ``(start, kind number, end)`` of their spans."""
    if not any(spans for _, spans in passages):
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for text, spans in passages:
        for hide in (False, True) if spans else (False,):
            chars: list[str] = []
            tags: list[int] = []
            last = 0
            for a, kind, b in sorted(spans):
                if a < last:
                    continue
                cell = disguised(text[a:b], kind, rng) if hide else text[a:b]
                chars += [text[last:a], cell]
                tags += [0] * (a - last) + [kind + 1] * len(cell)
                last = b
            chars.append(text[last:])
            tags += [0] * (len(text) - last)
            row, tag = np.full(TRAIN_WINDOW, PAD), np.zeros(TRAIN_WINDOW, np.int64)
            points = symbols(np.array([ord(c) for c in "".join(chars)[:TRAIN_WINDOW]], np.int64))
            row[: len(points)] = points
            tag[: len(points)] = tags[: len(points)]
            x.append(row)
            y.append(tag)
    return train(np.array(x), np.array(y), len(KINDS) + 1, steps, seed=seed)


def window_tags(codes: np.ndarray, bounds: np.ndarray, decoder: Decoder, window: int = WINDOW, overlap: int = OVERLAP) -> np.ndarray:
    """Tags of all characters of a block of documents.

    ``codes`` are the characters' numbers end to end, document ``i`` from ``bounds[i]``.
    Windows begin every ``window - overlap`` characters of a document.
    """
    stride = window - overlap
    lengths = np.diff(bounds)
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - window) // stride)), 0)
    doc = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start, stop = bounds[:-1][doc] + number * stride, bounds[1:][doc]
    held = np.minimum(stop - start, window)
    found = np.zeros((len(doc), window), np.uint8)
    # Windows of like length together, so that short texts do not pay for long ones.
    order = np.argsort(held, kind="stable")
    for first in range(0, len(order), 2048):
        rows = order[first : first + 2048]
        longest = int(held[rows].max())
        places = start[rows][None, :] + np.arange(longest)[:, None]
        x = np.where(places < stop[rows], codes[np.minimum(places, len(codes) - 1)], PAD)
        found[rows, :longest] = decoder.decode(x).T
    begin, end = np.zeros(len(doc), np.int64), held.copy()
    before = np.flatnonzero(number[1:] > 0)
    given = _handover(found[before, stride:], found[before + 1, :overlap])
    end[before], begin[before + 1] = stride + given, given
    sizes = end - begin
    shift = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    tags = np.zeros(len(codes), np.uint8)
    tags[np.repeat(start + begin, sizes) + shift] = found[np.repeat(np.arange(len(doc)), sizes), np.repeat(begin, sizes) + shift]
    return tags


def _handover(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where two windows that share a stretch change over, so that no span is cut.

    The place nearest to the middle where both see no data, else where both see the same,
    else the middle.
    """
    size = left.shape[1]
    far = np.abs(np.arange(size) - size // 2)
    cost = far + size * (left != 0) + 4 * size * (left != right)
    best = cost.argmin(axis=1)
    agree = left[np.arange(len(best)), best] == right[np.arange(len(best)), best]
    return np.where(agree, best, size // 2)


def _runs(tags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one tag other than 0, inside one document."""
    new = np.ones(len(tags) + 1, bool)
    new[1:-1] = tags[1:] != tags[:-1]
    new[bounds] = True
    edges = np.flatnonzero(new)
    keep = tags[edges[:-1]] > 0 if len(edges) > 1 else np.zeros(0, bool)
    return edges[:-1][keep], edges[1:][keep]


def find_spans(docs: DataFrame, weights: Weights | None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``spans``: kind, start, end and whether it is a base span."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = [f"_{i}" for i in range(len(keep))] + ["spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value) if sent.value is not None else None
        for batch in batches:
            for rows, texts in tb.text_slices(batch, "_text", BLOCK_BYTES):
                bounds = np.cumsum([0] + [len(t) for t in texts])
                added: dict[int, list] = {}
                if decoder is not None and bounds[-1]:
                    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                    codes = symbols(points)
                    tags = window_tags(codes, bounds, decoder)
                    for a, b in zip(*_runs(tags, bounds)):
                        i = int(np.searchsorted(bounds, a, side="right")) - 1
                        added.setdefault(i, []).append((int(a - bounds[i]), int(tags[a]) - 1, int(b - bounds[i])))
                cells = []
                for i, text in enumerate(texts):
                    base = base_spans(text)
                    extra = _added(text, added[i], base) if i in added else []
                    found = sorted([(*s, True) for s in base] + [(*s, False) for s in extra])
                    cells.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for a, k, b, is_base in found])
                struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
                yield pa.record_batch([*(rows.column(c) for c in range(len(keep))), pa.array(cells, pa.list_(struct))], names=names)

    # Kept columns may be called like the new ones, so they go by number in between.
    kinds = [f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.select(*keep).schema)]
    numbered = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    return numbered.mapInArrow(work, ", ".join([*kinds, f"spans {SPAN}"])).toDF(*keep, "spans")


def _trimmed(text: str, a: int, kind: int, b: int) -> tuple[int, int, int] | None:
    """The tagger's span without signs at its edges, if its kind's check holds."""
    while a < b and not (text[a].isalnum() or text[a] in "+(" and kind == 3):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    # A span that ends inside a word or number is part of something else.
    alone = not text[max(0, a - 1) : a].isalnum() and not text[b : b + 1].isalnum()
    return (a, kind, b) if a < b and alone and _holds(kind, text[a:b]) else None


def _added(text: str, spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the tagger's spans that hold and lie beside all base spans."""
    taken = np.zeros(len(text), bool)
    for a, _, b in base:
        taken[a:b] = True
    trimmed = (_trimmed(text, *s) for s in spans)
    return [s for s in trimmed if s and not taken[s[0] : s[2]].any()]


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, base spans counted by kind and hashed, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(counted, KINDS),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
