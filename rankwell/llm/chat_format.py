"""Chat formatting: recover the turns of plain transcripts and render them in one form.

A transcript is lines of text. Each line shows a speaker marker (of a known role, of an
unknown speaker, or none) and a few line features. A hidden Markov model whose states are
(role, first line of a turn or a later one) explains the lines; Viterbi finds the likeliest
states, which give the turns. Turns are then rendered canonically.

Transitions between roles and turn lengths are counted over all turns of a conversation
table; the emissions of markers are fixed values, those of line features are counted.

Rows: a null transcript has no turns; one without any marker is told by line features and
the order of roles alone. Very long conversations are cut into transcripts of ``SEGMENT``
turns. Turns with null role teach nothing; null text is an empty turn; equal turn numbers
are ordered by role and text. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import ship


ROLES = ("system", "user", "assistant")
SEGMENT = 200
# Words that name a role in a marker.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "q", "question", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent"),
}
# How transcripts write a turn's first line; by style, for each role.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions\n", "user": "### Human\n", "assistant": "### Assistant\n"},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
    {"system": "- ", "user": "- ", "assistant": "- "},
)
_MARK = re.compile(
    r"^\s*(?:#{1,6}\s*(?P<head>[A-Za-z]+)\s*:?\s*$|\[(?P<box>[A-Za-z]+)\]\s?|<\|?(?P<tag>[A-Za-z]+)\|?>\s?"
    r"|\**(?P<name>[A-Za-z]+)\**\s*:\s?|(?P<dash>[-*>•])\s+)"
)
OTHER, NONE = len(ROLES), len(ROLES) + 1  # a marker of an unknown speaker; no marker
# Probability of a marker on a turn's first line: its own role, another role, unknown, none.
FIRST_LINE = {"own": 0.80, "wrong": 0.01, "other": 0.13, "none": 0.05}
LATER_LINE = {"named": 0.002, "other": 0.014, "none": 0.98}
N_FEATURES = 8


def marker(line: str) -> tuple[int, str]:
    """Kind of a line's marker (a role's number, OTHER or NONE), and the line without it."""
    found = _MARK.match(line)
    if not found:
        return NONE, line
    rest = line[found.end() :]
    if found["dash"]:
        return OTHER, rest
    word = (found["head"] or found["box"] or found["tag"] or found["name"]).lower()
    for i, role in enumerate(ROLES):
        if word in NAMES[role]:
            return i, rest
    return NONE, line


def feature(line: str, after_blank: bool) -> int:
    """Bucket of a line without its marker: its length, a question, a blank line before."""
    size = len(line)
    return (0 if size < 40 else 1 if size < 160 else 2 if size < 480 else 3) + 4 * (
        line.rstrip().endswith("?") or after_blank
    )


class Hmm(NamedTuple):
    start: np.ndarray  # roles
    turn: np.ndarray  # role x role: the next turn's role
    stay: np.ndarray  # role: that a turn has another line
    line: np.ndarray  # role x feature


def fit(turns: DataFrame) -> Hmm:
    """Count role order, turn lengths and line features over all of ``conv_id, turn, role, text``."""
    k = len(ROLES)
    number = F.when(F.lit(False), -1)
    for i, role in enumerate(ROLES):
        number = number.when(F.lower("role") == role, i)
    known = turns.select("conv_id", "turn", number.alias("r"), F.coalesce("text", F.lit("")).alias("text")).where("r is not null")
    order = Window.partitionBy("conv_id", F.floor(F.col("turn") / SEGMENT)).orderBy("turn", "r", "text")
    pairs = known.select("r", F.lag("r").over(order).alias("before")).groupBy("r", "before").agg(F.count("*").alias("n"))
    start, turn = np.ones(k), np.ones((k, k))
    for row in pairs.collect():
        if row["before"] is None:
            start[row["r"]] += row["n"]
        else:
            turn[row["before"], row["r"]] += row["n"]
    lines = known.select("r", F.split("text", "\n").alias("lines"))
    sizes = lines.groupBy("r").agg(F.count("*").alias("turns"), F.sum(F.size("lines")).alias("n")).collect()
    stay = np.full(k, 0.5)
    for row in sizes:
        stay[row["r"]] = min(max(1 - row["turns"] / row["n"], 0.01), 0.99)
    each = lines.select("r", F.explode("lines").alias("x"))
    size = F.length("x")
    bucket = F.when(size < 40, 0).when(size < 160, 1).when(size < 480, 2).otherwise(3) + F.when(F.rtrim("x").endswith("?"), 4).otherwise(0)
    line = np.ones((k, N_FEATURES))
    for row in each.groupBy("r", bucket.alias("f")).agg(F.count("*").alias("n")).collect():
        line[row["r"], row["f"]] += row["n"]
    return Hmm(start / start.sum(), turn / turn.sum(axis=1, keepdims=True), stay, line / line.sum(axis=1, keepdims=True))


def parse(text: str | None, model: Hmm) -> list[tuple[str, str]]:
    """Turns ``(role, text)`` of a transcript, by Viterbi over its lines."""
    if not text:
        return []
    k = len(ROLES)
    lines = text.split("\n")
    kinds, rests, kept = [], [], []
    emit = np.empty((len(lines), 2 * k))
    blank = True
    for i, line in enumerate(lines):
        kind, rest = marker(line)
        first, later = np.empty(k), np.empty(k)
        for r in range(k):
            first[r] = FIRST_LINE["own" if kind == r else "other" if kind == OTHER else "none" if kind == NONE else "wrong"]
            later[r] = LATER_LINE["other" if kind == OTHER else "none" if kind == NONE else "named"]
        f = model.line[:, feature(rest, blank and i > 0)]
        emit[i, :k], emit[i, k:] = np.log(first * f), np.log(later * f)
        kinds.append(kind)
        rests.append(rest)
        kept.append(line)
        blank = not line.strip()
    # States: k first lines, then k later lines.
    step = np.full((2 * k, 2 * k), -np.inf)
    for r in range(k):
        for s in (r, k + r):
            step[s, k + r] = np.log(model.stay[r])
            step[s, :k] = np.log((1 - model.stay[r]) * model.turn[r])
    value = np.concatenate([np.log(model.start), np.full(k, -np.inf)]) + emit[0]
    back = np.zeros((len(lines), 2 * k), np.int64)
    for i in range(1, len(lines)):
        reach = value[:, None] + step
        back[i] = reach.argmax(axis=0)
        value = reach.max(axis=0) + emit[i]
    state = int(value.argmax())
    states = [state]
    for i in range(len(lines) - 1, 0, -1):
        state = int(back[i, state])
        states.append(state)
    turns: list[tuple[str, list[str]]] = []
    for state, kind, rest, line in zip(reversed(states), kinds, rests, kept):
        if state < k:
            # A heading alone on its line only opens the turn.
            turns.append((ROLES[state], [rest] if rest or kind == NONE else []))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(held)) for role, held in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: each turn between a role line and an end mark."""
    return "".join(f"<|{role}|>\n{text.strip()}\n<|end|>\n" for role, text in turns)


def format_transcripts(transcripts: DataFrame, model: Hmm, key: list[str], text: str = "transcript") -> DataFrame:
    """``key``, ``n_turns``, ``roles``, ``rendered`` of each transcript."""
    ship(transcripts.sparkSession)
    sent = transcripts.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in transcripts.select(*key).schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(t, sent.value) for t in batch.column(text).to_pylist()]
            yield pa.record_batch(
                [
                    *(batch.column(k) for k in key),
                    pa.array([len(x) for x in parsed], pa.int32()),
                    pa.array([",".join(r for r, _ in x) for x in parsed], pa.string()),
                    pa.array([render(x) for x in parsed], pa.string()),
                ],
                names=[*key, "n_turns", "roles", "rendered"],
            )

    return transcripts.select(*key, text).mapInArrow(work, f"{schema}, n_turns int, roles string, rendered string")


def transcripts(turns: DataFrame, style: Column | None = None) -> DataFrame:
    """``conv_id, segment, transcript, true_roles``: conversations as plain transcripts.

    ``style``: number of a way to mark speakers, by default from a hash of ``conv_id``.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) if style is None else style
    marks = F.when(F.lit(False), F.lit(""))
    for s, table in enumerate(STYLES):
        for role, mark in table.items():
            marks = marks.when((style == s) & (F.lower("role") == role), F.lit(mark))
    line = F.concat(F.coalesce(marks, F.lit("- ")), F.coalesce("text", F.lit("")))
    cell = F.struct("turn", F.coalesce(F.lower("role"), F.lit("")).alias("role"), line.alias("line"))
    held = turns.groupBy("conv_id", F.floor(F.col("turn") / SEGMENT).cast("int").alias("segment")).agg(
        F.sort_array(F.collect_list(cell)).alias("turns")
    )
    return held.select(
        "conv_id", "segment",
        F.array_join(F.transform("turns", lambda x: x["line"]), "\n").alias("transcript"),
        F.array_join(F.transform("turns", lambda x: x["role"]), ",").alias("true_roles"),
    )
