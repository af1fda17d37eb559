"""Chat formatting into budgeted windows with a loss mask.

A conversation is a sequence of turns, each written as ``### Role: text</turn>`` and a line break.
Control strings inside texts (and the escape character) are escaped reversibly. Prefix sums of the
turns' tokens choose the windows: each takes as many whole turns as fit the budget next to what it
repeats, the conversation's leading system turn and a limited history of the turns before. What is
repeated is masked, so each assistant text is a target exactly once.

Conversations of any length are handled: turns are sorted over range partitions, tokens before a
turn come from two levels of sums, and windows are chosen inside blocks of BLOCK tokens, to which
the turns shortly before are copied as history.
"""

from __future__ import annotations

import hashlib
import re
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .tables import stored

BUDGET = 2048          # tokens of a window; a single longer turn makes a longer window
HISTORY = 256          # tokens of repeated turns, at most
BLOCK = 1 << 16        # tokens of a conversation that one group of rows holds
MARK_TOKENS = 6        # of a turn's marks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {label: role for role, label in _LABELS.items()}
_END = "</turn>\n"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_STOP = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n|: ")

Row = tuple[int, bool, str, str, int]          # place, fresh, role, text, tokens


def escape(text: str) -> str:
    """A backslash before every backslash, ``###`` and ``</turn>``."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    """The mark that opens a turn; roles other than the three known ones are written after ``=``."""
    return f"### {_LABELS.get(role) or '=' + escape(role).replace(':', chr(92) + ':')}: "


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out, at = [], 0
    while at < len(text):
        parts = []
        at += len("### ")
        for stop in (": ", _END):
            for found in _STOP.finditer(text, at):
                if found.group() == stop:
                    parts.append(text[at:found.start()])
                    at = found.end()
                    break
            else:
                raise ValueError("a turn has no end")
        label, body = parts
        out.append((unescape(label[1:]) if label.startswith("=") else _ROLES[label], unescape(body)))
    return out


def form(rows: list[Row], system: Row | None, budget: int, history: int) -> Iterator[tuple[int, int, int, str, list[tuple[int, int]]]]:
    """The windows of one block: (repeated turns, own turns, tokens, text, target spans)."""
    first = next((i for i, r in enumerate(rows) if r[1]), len(rows))
    upto = np.concatenate(([0], np.cumsum([r[4] for r in rows])))
    while first < len(rows):
        kept = [] if system is None or rows[first][0] == 0 else [system]
        room = budget - sum(r[4] for r in kept)
        back = int(np.searchsorted(upto, upto[first] - min(history, max(room - rows[first][4], 0))))
        if kept and rows[back][0] == 0:
            back += 1                                   # the system turn is there already
        past = rows[back:first]
        last = int(np.searchsorted(upto, upto[back] + room, side="right")) - 1
        last = max(last, first + 1)
        text, spans, size = [], [], 0
        for i, (_, _, role, body, _) in enumerate([*kept, *past, *rows[first:last]]):
            mark, inner = head(role), escape(body)
            if role == "assistant" and i >= len(kept) + len(past):
                spans.append((size + len(mark), len(inner)))
            text += [mark, inner, _END]
            size += len(mark) + len(inner) + len(_END)
        yield (len(kept) + len(past), last - first, int(upto[last] - upto[back]) + sum(r[4] for r in kept), "".join(text), spans)
        first = last


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def token_counts(path: str, texts: list[str]) -> Iterator[int]:
    """Tokens of each text; few encodings are held at a time."""
    for at in range(0, len(texts), 32):
        for found in _tokenizer(path).encode_batch_fast(texts[at:at + 32], add_special_tokens=False):
            yield len(found)


def turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, place, role, text, tokens, before): turns in order of turn, then role and text;
    null texts and roles are empty, turns without number come first, rows without conv_id make one
    conversation. ``before`` sums the tokens of the turns before."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("conv_id", "turn", "role", "tie", "row")
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, place, before = object(), 0, 0
        for batch in batches:
            made: list[list] = [[], [], []]
            for conv, size in zip(batch.column(0).to_pylist(), token_counts(tokenizer, batch.column(2).to_pylist())):
                if conv != now:
                    now, place, before = conv, 0, 0
                n = size + MARK_TOKENS
                for column, value in zip(made, (place, n, before)):
                    column.append(value)
                place, before = place + 1, before + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), *[pa.array(c, pa.int64()) for c in made]],
                                             names=["conv_id", "role", "text", "part", "place", "tokens", "before"])
    rows = stored(rows.mapInArrow(run, "conv_id long, role string, text string, part int, place long, tokens long, before long"), "turns")
    # A part's first conversation may have begun in earlier parts: one row for each part at most.
    sums = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("n").over(earlier).alias("n"),
                       F.sum("t").over(earlier).alias("t")).where("n > 0")
    return rows.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select(
        "conv_id", (F.col("place") + F.coalesce("n", F.lit(0))).alias("place"), "role", "text", "tokens",
        (F.col("before") + F.coalesce("t", F.lit(0))).alias("before"))


def windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> (conv_id, block, window, repeated, own,
    tokens, text, targets), in order of (block, window): ``repeated`` turns open the text and are
    masked, ``own`` turns follow; ``targets`` are the character spans of text under the loss mask."""
    rows = stored(turns(conversations, tokenizer), "placed").withColumn("block", F.floor(F.col("before") / block))
    past = rows.where(F.col("before") + F.col("tokens") > (F.col("block") + 1) * block - history).withColumn("block", F.col("block") + 1)
    lead = rows.where((F.col("place") == 0) & (F.col("role") == "system")).select(F.col("conv_id").alias("c"), "role", "text", "tokens")
    later = rows.where("block > 0").select("conv_id", "block").distinct()
    lead = later.join(lead, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "block", F.lit(-1).cast("long").alias("place"), F.lit(False).alias("fresh"), "role", "text", "tokens")
    columns = ("conv_id", "block", "place", "fresh", "role", "text", "tokens")
    every = rows.withColumn("fresh", F.lit(True)).select(*columns).unionByName(
        past.withColumn("fresh", F.lit(False)).select(*columns)).unionByName(lead.select(*columns))
    every = every.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            system = next((r for r in held if r[0] <= 0 and r[2] == "system"), None)
            made = list(form([r for r in held if r[0] >= 0], system, budget, history))
            n, columns = len(made), list(zip(*made)) or [[]] * 5
            spans = pa.array([[{"start": a, "length": b} for a, b in x] for x in columns[4]], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * n, pa.int64()), pa.array([now[1]] * n, pa.int64()), pa.array(range(n), pa.int64()),
                 *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), spans],
                names=["conv_id", "block", "window", "repeated", "own", "tokens", "text", "targets"])
        for batch in batches:
            for conv, number, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if now is not None and now != (conv, number):
                    yield close()
                    held = []
                now = (conv, number)
                held.append(tuple(row))
        if held:
            yield close()
    return every.mapInArrow(run, "conv_id long, block long, window long, repeated long, own long, tokens long, text string, "
                                 "targets array<struct<start: long, length: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """windows() -> (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read
    from the formatted texts alone. A digest runs over its conversation in order: windows are
    streamed past it, none is held."""
    rows = formatted.select("conv_id", "block", "window", "repeated", "text", "targets").repartition("conv_id").sortWithinPartitions(
        "conv_id", "block", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None

        def close() -> list:
            n, turns_, loss_n, loss, size = state
            return [now, n, turns_.hexdigest(), loss_n, loss.hexdigest(), size]
        for batch in batches:
            out = []
            for conv, _, _, repeated, text, targets in zip(*[c.to_pylist() for c in batch.columns]):
                if conv != now or state is None:
                    if state is not None:
                        out.append(close())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_turns(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in targets:
                    body = unescape(text[span["start"]:span["start"] + span["length"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
            yield _digests(out)
        if state is not None:
            yield _digests([close()])
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
