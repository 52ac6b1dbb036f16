"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) turns to a string. Nothing is
known about it but its outputs: successive prefixes of a conversation are rendered,
and where each output extends the one before, the extension is the new turn's span.
Where it does not, the template rewrites history: the turn is reported, and what
follows the outputs' common prefix belongs to it. A turn's text inside its span is
found by rendering the prefix once more with a sentinel in the text's place.

A template may say that it is ``local``: a turn's rendering depends on that turn
alone. Then a conversation can be cut anywhere, and prefixes are rendered inside
segments of ``SEGMENT`` turns, which bounds the quadratic cost; the segments of a
conversation of more than ``SEGMENT`` turns are rendered by many tasks. Only the
digests of such a conversation are taken in one task, by streaming over its
segments in order. Rows are streamed in sorted order, never gathered by key. A
template that is not local gets each conversation whole.

Null roles and texts are empty strings. A null conv_id is a conversation of its own.
Rows sort by turn (null first), then role, then text; repeated rows are turns of
their own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import maybe_broadcast, setup

SEGMENT = 64
SENTINEL = "\ue000\ue001\ue002"
LOSS_ROLE = "assistant"

Turn = tuple[str, str]

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_END = re.compile(r"(?<!\\)((?:\\\\)*)</turn>\n")
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


class Marked:
    """``### role: text </turn>`` and a newline per turn. A backslash stands before every
    control string and backslash of a text (in a role, before colons too)."""
    local = True

    @staticmethod
    def render(turns: list[Turn]) -> str:
        return "".join(f"### {_ROLE_CONTROL.sub(_escape, role)}: {_CONTROL.sub(_escape, text)} </turn>\n"
                       for role, text in turns)

    @staticmethod
    def unescape(text: str) -> str:
        return _ESCAPED.sub(r"\1", text)

    @classmethod
    def parse(cls, formatted: str) -> list[Turn]:
        """The turns of a rendered output; the inverse of ``render``."""
        out, at = [], 0
        for end in _END.finditer(formatted):
            head = _HEAD.match(formatted, at)
            text = formatted[head.end():end.start() + len(end[1]) - 1]
            out.append((cls.unescape(head[1]), cls.unescape(text)))
            at = end.end()
        if at != len(formatted):
            raise ValueError("not an output of this template")
        return out


def _escape(m: re.Match) -> str:
    return "\\" + m[0]


def trace(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int] | None], list[int]]:
    """(output, spans, contents, rewrites) of the conversation.

    ``spans[k]`` is turn k's part of the output, ``contents[k]`` that of its text
    (None if the template does not show it in one piece), ``rewrites`` the turns
    whose arrival changed earlier output. Spans before a rewrite end where the
    outputs stop to agree.
    """
    before, spans, contents, rewrites = render([]), [], [], []
    for k, (role, text) in enumerate(turns):
        after = render(turns[:k + 1])
        start = len(before)
        if not after.startswith(before):
            rewrites.append(k)
            start = len(os.path.commonprefix((before, after)))
            spans = [(min(a, start), min(b, start)) for a, b in spans]
            contents = [c if c is None or c[1] <= start else None for c in contents]
        probe = render([*turns[:k], (role, SENTINEL)])
        at = probe.rfind(SENTINEL)
        tail = len(probe) - at - len(SENTINEL)
        shown = at >= start and after.startswith(probe[:at]) and tail <= len(after) - at and after.endswith(probe[at + len(SENTINEL):])
        spans.append((start, len(after)))
        contents.append((at, len(after) - tail) if shown else None)
        before = after
    return before, spans, contents, rewrites


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("seq", pa.int64()), ("formatted", pa.large_string()),
                       ("turns", pa.list_(_SPAN)), ("loss", pa.list_(_SPAN)), ("rewrites", pa.list_(pa.int64()))])
_SEGMENT_DDL = ("conv_id long, block long, seq long, formatted string, turns array<struct<start:long, stop:long>>, "
                "loss array<struct<start:long, stop:long>>, rewrites array<long>")


def _segments(template):
    """Sorted (conv_id, block, role, text) rows to segments, a few at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, seq = None, [], 0

        def close() -> dict:
            out, spans, contents, rewrites = trace(template.render, turns)
            loss = [c for (role, _), c in zip(turns, contents) if role == LOSS_ROLE and c]
            return {"conv_id": key[0], "block": key[1], "seq": seq, "formatted": out, "rewrites": rewrites,
                    **{name: [{"start": a, "stop": b} for a, b in found] for name, found in (("turns", spans), ("loss", loss))}}
        for batch in batches:
            done = []
            for conv, block, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                full = template.local and len(turns) >= SEGMENT
                if turns and ((conv, block) != key or full):
                    done.append(close())
                    seq = seq + 1 if (conv, block) == key else 0
                    turns = []
                key = (conv, block)
                turns.append((role, text))
            yield pa.RecordBatch.from_pylist(done, schema=_SEGMENTS)
        if turns:
            yield pa.RecordBatch.from_pylist([close()], schema=_SEGMENTS)
    return run


def render_conversations(rows: DataFrame, template=Marked, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, block, seq, formatted, turns and loss (code point spans, in ``formatted``,
    of every turn and of the assistant's escaped texts), rewrites (turns that changed
    earlier output): the segments of every conversation; ordered by (block, seq) they
    are its output. Conversations of at most ``SEGMENT`` turns, and all
    those of a template that is not local, are one segment."""
    setup(rows.sparkSession)
    t = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                    F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    block = F.lit(0).cast("long")
    if template.local:
        long = t.groupBy("conv_id").count().where(F.col("count") > SEGMENT).select(F.col("conv_id").alias("_long"), F.lit(True).alias("_is"))
        if long.limit(1).count():
            t = t.join(maybe_broadcast(long), F.col("conv_id").eqNullSafe(F.col("_long")), "left")
            block = F.when(F.col("_is"), F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))).otherwise(0).cast("long")
    t = t.withColumn("block", block)
    dealt = t.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return dealt.select("conv_id", "block", "role", "text").mapInArrow(_segments(template), _SEGMENT_DDL)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64())])
_DIGEST_DDL = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long, rewrites long")


def _digests(template):
    """Segments in order to one row per conversation, read back from the formatted text; the state is two hashes and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if state is None or x["conv_id"] != key:
                    if state:
                        done.append(state)
                    key, state = x["conv_id"], {"conv_id": x["conv_id"], "n_turns": 0, "turns": hashlib.sha256(),
                                                "loss": hashlib.sha256(), "loss_chars": 0, "formatted_chars": 0, "rewrites": 0}
                for role, text in template.parse(x["formatted"]):
                    state["n_turns"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for span in x["loss"]:
                    text = template.unescape(x["formatted"][span["start"]:span["stop"]])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
                state["formatted_chars"] += len(x["formatted"])
                state["rewrites"] += len(x["rewrites"])
            yield _table(done)
        if state:
            yield _table([state])

    def _table(done):
        return pa.RecordBatch.from_pylist([
            {**{k: s[k] for k in ("conv_id", "n_turns", "loss_chars", "formatted_chars", "rewrites")},
             "turns_sha256": s["turns"].hexdigest(), "loss_sha256": s["loss"].hexdigest()} for s in done], schema=_DIGEST)
    return run


def digests(rows: DataFrame, template=Marked) -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewrites, all read back from the rendered segments.

    Conversations of one segment are digested where they were rendered; the segments of
    longer ones move once more, to be streamed in order."""
    conv = F.col("conv_id")
    sized = rows.groupBy("conv_id").count().where(F.col("count") > SEGMENT).select(conv.alias("_long"))
    if not template.local or not sized.limit(1).count():
        return render_conversations(rows, template).mapInArrow(_digests(template), _DIGEST_DDL)
    side = maybe_broadcast(sized)
    same = conv.eqNullSafe(F.col("_long"))
    short = render_conversations(rows.join(side, same, "left_anti"), template)
    long = render_conversations(rows.join(side, same, "left_semi"), template)
    ordered = long.repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq")
    return short.unionByName(ordered).mapInArrow(_digests(template), _DIGEST_DDL)
