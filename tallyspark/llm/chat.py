"""Chat formatting: transcripts are parsed by a hidden Markov model before turns are rendered.

A transcript is a run of lines.  Each line's hidden state is a role (system, user,
assistant) and whether the line begins a turn.  What is seen of a line is its
speaker marker (a known name, a mark that doesn't say who speaks, none) and its shape
(blank, question, list item, length).  Start, transition and emission chances are
counts over labelled transcripts, summed by Spark.  Viterbi recovers the likeliest
states of the whole transcript; markers are then removed, lines of a turn joined and
turns rendered in one canonical form.

A transcript may be of any length: its rows are dealt in blocks.  Tasks reduce each
block to a small matrix (best score from each state before it to each state at its
end); a pass over the matrices in order settles the state at each border; then all
blocks are decoded by themselves.  The result is that of one Viterbi pass over the
whole, and no task holds a transcript's text.

Nulls: a null chunk is an empty one; a null conversation id is a conversation of its
own; a null place counts as the first.  Empty chunks: no lines.  A conversation
without lines has no turns.  Repeated rows: their lines follow one another.  Ties in
Viterbi: the state named first.  Empty tables: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import keep, text_or_empty

ROLES = ("system", "user", "assistant")
#: States: a turn of the role begins (0, 1, 2), or goes on (3, 4, 5).
STATES = 6
#: Chunks of a transcript that one block holds.
BLOCK = 32

#: Names that transcripts give to speakers.
NAMES = {
    "system": "system sys instruction instructions context setup",
    "user": "user human q question customer client student prompt me you",
    "assistant": "assistant ai bot a answer agent model gpt chatbot helper teacher response",
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names.split()}
_name = "|".join(sorted(ROLE_OF, key=len, reverse=True))
MARKER = re.compile(
    rf"\s*(?:<\|im_start\|>\s*(?P<im>{_name})\b[ \t]*|<\|(?P<bar>{_name})\|>[ \t]*|\[(?P<box>{_name})\]:?[ \t]*|(?:\#{{1,4}}[ \t]*|\*\*)(?P<head>{_name})(?:\*\*)?[ \t]*:?(?:\*\*)?[ \t]*(?=$)"
    rf"|(?P<inst>\[INST\])[ \t]*|(?:\*\*)?(?P<plain>{_name})(?:\*\*)?[ \t]*[:>](?:\*\*)?[ \t]*|(?P<dash>(?:--|—|>>)[ \t]+))",
    re.I,
)
END = re.compile(r"[ \t]*(?:<\|im_end\|>|<\|end\|>|\[/INST\]|</s>)[ \t]*$")


def read_line(line: str) -> tuple[str, str, str]:
    """A line's marker class, shape, and text without marker and end sign."""
    m = MARKER.match(line)
    if m is None:
        marker, rest = "none", line
    else:
        group = m.lastgroup
        marker = "user!" if group == "inst" else "turn?" if group == "dash" else ROLE_OF[m[group].lower()] + ("" if group == "plain" else "!")
        rest = line[m.end() :]
    ended = END.search(rest)
    if ended:
        rest = rest[: ended.start()]
    plain = rest.strip()
    if not plain:
        shape = "end" if ended else "blank"
    elif plain.endswith("?"):
        shape = "question"
    elif re.match(r"(?:[-*•]|\d+[.)])\s", plain):
        shape = "item"
    else:
        shape = f"length {min(3, len(plain) // 60)}"
    return marker, shape, rest


@dataclass
class Model:
    """Log chances: of the first state, of state after state, and of markers and shapes in each state."""

    first: np.ndarray
    step: np.ndarray
    marker: dict[str, np.ndarray]
    shape: dict[str, np.ndarray]

    def emissions(self, read: list[tuple[str, str, str]]) -> np.ndarray:
        flat = np.zeros(STATES)
        return np.array([self.marker.get(m, flat) + self.shape.get(s, flat) for m, s, _ in read]).reshape(-1, STATES)

    def border(self, seen: np.ndarray) -> np.ndarray:
        """(before, end): the best score through a block's lines from each state before it to each at its end."""
        best = None
        for e in seen:
            best = self.step + e if best is None else (best[:, :, None] + self.step[None]).max(axis=1) + e
        return best

    def decode(self, seen: np.ndarray, before: int | None, end: int) -> list[int]:
        """The likeliest states of a block's lines, from the state before it (None: the start) to that at its end."""
        score = (self.first if before is None else self.step[before]) + seen[0]
        back = []
        for e in seen[1:]:
            ways = score[:, None] + self.step
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + e
        states = [end]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def train(labelled: DataFrame) -> Model:
    """From (conv_id, turn, role, text) whose ``text`` is a turn as it stands in a transcript; roles are known.

    The caller bounds the rows (see ``queries``).
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[str] = []
            for role, was, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if role not in ROLES:
                    continue
                now = ROLES.index(role)
                for k, line in enumerate((text or "").split("\n")):
                    marker, shape, _ = read_line(line)
                    state = now + (3 if k else 0)
                    keys += [f"m|{marker}|{state}", f"s|{shape}|{state}"]
                    if k:
                        keys.append(f"t|{now + (3 if k > 1 else 0)}|{state}")
                    elif was in ROLES:
                        keys += [f"t|{ROLES.index(was) + x}|{state}" for x in (0, 3)]
                    else:
                        keys.append(f"f|{state}")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = labelled.select("role", before.alias("was"), "text")
    n = {tuple(r["key"].split("|")): r["n"] for r in rows.mapInArrow(counts, "key string").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}

    def logs(kind: str, names: list[str]) -> dict[str, np.ndarray]:
        table = np.array([[n.get((kind, x, str(s)), 0) for s in range(STATES)] for x in names], float).reshape(-1, STATES) + 0.1
        return dict(zip(names, np.log(table / table.sum(axis=0)), strict=True))

    names = lambda kind: sorted({k[1] for k in n if k[0] == kind})
    first = np.array([n.get(("f", str(s)), 0) for s in range(STATES)], float) + np.array([0.1] * 3 + [1e-6] * 3)
    step = np.array([[n.get(("t", str(a), str(b)), 0) for b in range(STATES)] for a in range(STATES)], float)
    allowed = np.array([[b < 3 or b - 3 == a % 3 for b in range(STATES)] for a in range(STATES)])
    step = np.where(allowed, step + 0.1, 1e-12)
    return Model(np.log(first / first.sum()), np.log(step / step.sum(axis=1, keepdims=True)), logs("m", names("m")), logs("s", names("s")))


def render(role: Column, text: Column) -> Column:
    """A turn's canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>"))


def parse(chunks: DataFrame, model: Model) -> DataFrame:
    """Rows (conv_id, seq, text) -> one row per recovered turn: ``conv_id, turn, role, text, rendered``.

    ``text``: a chunk of the transcript, one or more lines; chunks follow by ``seq``
    (0, 1, ...), or there is a single one.
    """
    carried = chunks.sparkSession.sparkContext.broadcast(model)
    ordered = chunks.select("conv_id", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), text_or_empty("text").alias("text")).where("text <> ''")
    blocks = keep(
        ordered.groupBy("conv_id", F.floor(F.col("seq") / BLOCK).alias("block"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text")), "chat-blocks",
    )
    kind = dict(blocks.dtypes)["conv_id"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matrices in order -> each block's state before it (-1: the start) and at its end."""
        ids: list = []
        numbers: list[int] = []
        score, back = np.zeros(STATES), []

        def done() -> pa.RecordBatch:
            state, ends = int(score.argmax()), []
            for b in reversed(back):
                ends.append(state)
                state = int(b[state])
            ends.reverse()
            return pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(numbers, pa.int64()), pa.array([-1, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())], ["conv_id", "block", "before", "at_end"])

        for batch in batches:
            for conv, number, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                numbers_in = np.frombuffer(raw, "<f8")
                border, from_start = numbers_in[: STATES * STATES].reshape(STATES, STATES), numbers_in[STATES * STATES :]
                if ids and ids[0] != conv:
                    yield done()
                    ids, numbers, back = [], [], []
                if ids:
                    ways = score[:, None] + border
                    back.append(ways.argmax(axis=0))
                    score = ways.max(axis=0)
                else:
                    score = from_start
                    back.append(np.full(STATES, -1))
                ids.append(conv)
                numbers.append(number)
        if ids:
            yield done()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks -> their turns, or parts of turns: number in the block, whether it begins there, role, text."""
        m = carried.value
        for batch in batches:
            rows: list[tuple] = []
            for conv, number, text, before, end in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                read = [read_line(x) for x in text.split("\n")]
                states = m.decode(m.emissions(read), None if before < 0 else before, end)
                part: list[str] | None = None
                for k, ((_, _, rest), s) in enumerate(zip(read, states, strict=True)):
                    begins = s < 3 or (k == 0 and before < 0)
                    if begins or part is None:
                        part = []
                        rows.append((conv, number, len(rows), begins, ROLES[s % 3], part))
                    part.append(rest)
            columns = list(zip(*[(c, n, k, b, r, "\n".join(p)) for c, n, k, b, r, p in rows], strict=True)) or [[]] * 6
            kinds = (batch.column(0).type, pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "block", "k", "begins", "role", "text"])

    matrices = blocks.mapInArrow(_borders(carried), f"conv_id {kind}, block long, border binary")
    settled = keep(
        matrices.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(settle, f"conv_id {kind}, block long, before int, at_end int"), "chat-settled"
    )
    joined = blocks.join(
        settled.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before", "at_end"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    ).select("conv_id", "block", "text", "before", "at_end")
    parts = keep(joined.mapInArrow(decode, f"conv_id {kind}, block long, k long, begins boolean, role string, text string"), "chat-parts")
    # Turns are counted by block first, so that no task holds a transcript's text.
    begins = F.col("begins").cast("long")
    counted = parts.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(F.sum(begins).alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counted.select("c", "b", base.alias("base"))
    turn = F.col("base") + F.sum(begins).over(W.partitionBy("conv_id", "block").orderBy("k").rowsBetween(W.unboundedPreceding, 0)) - 1
    placed = parts.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    turns = placed.withColumn("turn", turn).groupBy("conv_id", "turn").agg(
        F.min(F.struct("block", "k", "role"))["role"].alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "k", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    text = F.regexp_replace("text", r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return turns.select("conv_id", F.col("turn").cast("long"), "role", text.alias("text")).withColumn("rendered", render(F.col("role"), F.col("text")))


def _borders(carried):
    """Blocks -> their matrices, and after each matrix the scores from the start (used by a transcript's first block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = carried.value
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                seen = m.emissions([read_line(x) for x in text.split("\n")])
                score = m.first + seen[0]
                for e in seen[1:]:
                    score = (score[:, None] + m.step).max(axis=0) + e
                out.append(np.concatenate([m.border(seen).ravel(), score]).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["conv_id", "block", "border"])

    return run
