"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are its context and only its
reply is trainable.  Examples of one conversation share their prefixes, so a formatted
conversation is stored once, as one segment per turn with its place in the conversation,
and an example is a row of numbers into it: it reads segments 0..turn_no, and its loss mask
is [loss_start, loss_end).  What is stored is therefore linear in the input even for a
conversation of millions of turns; :func:`expand` makes full strings of them, which
:func:`render_examples` writes and :func:`conversation_digests` reads back.

Template of a turn: ``<|turn|>`` role newline text ``<|end|>`` newline.  Inside role and
text a backslash is doubled and every control string gets a backslash after its first
character; :func:`unescape` undoes both exactly.

Scale: one shuffle by conversation with a sort inside partitions; rows then stream
through a worker, which holds one Arrow batch; expanding also holds one example or two.

Defined cases: null text and null role count as empty; rows of one turn number are
ordered by role, then text; null turns come first; null conversation ids form one
conversation; repeated rows stay repeated; other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Strings that chat templates give a meaning to.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END) + r"\n\Z", re.S)

SEGMENTS = "conv_id long, turn_no long, is_target boolean, segment string, start long, end long, loss_start long, loss_end long, example long"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    while found := _CONTROL.search(text):
        # one pass may leave a control string that overlapped another
        text = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if not found:
            break
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def format_chat(conversations: DataFrame, *, target_role: str = "assistant") -> DataFrame:
    """One row per turn: its segment, its place, and for target turns the example that ends there.

    An example's text is the segments of its conversation up to and with its own, in
    order; loss_start and loss_end are code point positions in it.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()
        turn_no = at = example = 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now or now is not None and conv is None:
                    now, turn_no, at, example = conv, 0, 0, 0
                head = f"{TURN}{escape_role(role)}\n"
                body = escape(text)
                segment = f"{head}{body}{END}\n"
                target = role == target_role
                out.append((conv, turn_no, target, segment, at, at + len(segment), at + len(head) if target else None, at + len(head) + len(body) if target else None, example if target else None))
                turn_no, at, example = turn_no + 1, at + len(segment), example + target
            columns = list(zip(*out)) if out else [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * 5]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return rows.mapInArrow(run, SEGMENTS)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _SEGMENT.match(segment)
    if not found:
        raise ValueError(f"not a formatted turn: {segment[:80]!r}")
    return unescape(found[1]), unescape(found[2])


_PLACES = ("conv_id", "turn_no", "segment", "example", "loss_start", "loss_end")


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, int | None, int | None, str]]:
    """(conv_id, example, loss_start, loss_end, text) of every target turn, text being all turns up to and with it.

    Turns behind the last target are in no example; a conversation that has some ends with its
    whole text, without a number and a loss.
    """
    now, prefix, rest = None, [], False
    for batch in batches:
        for conv, turn_no, segment, example, start, end in zip(*(batch.column(c).to_pylist() for c in _PLACES)):
            if turn_no == 0:
                if rest:
                    yield now, None, None, None, "".join(prefix)
                now, prefix = conv, []
            prefix.append(segment)
            rest = example is None
            if not rest:
                prefix = ["".join(prefix)]
                yield conv, example, start, end, prefix[0]
    if rest:
        yield now, None, None, None, "".join(prefix)


def render_examples(segments: DataFrame) -> DataFrame:
    """Full example strings: (conv_id, example, loss_start, loss_end, text).

    What is written grows with the square of a conversation, as every example has all turns
    before it; conversations are streamed, and a worker holds one prefix, never more.  An
    example of 2 GiB or more does not fit a string of Arrow.
    """
    dealt = segments.select(*_PLACES).repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    names = ["conv_id", "example", "loss_start", "loss_end", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *places, text in expand(batches):
            if places[1] is not None:
                yield pa.record_batch([*(pa.array([v], pa.int64()) for v in places), pa.array([text], pa.string())], names=names)

    return dealt.mapInArrow(run, "conv_id long, example long, loss_start long, loss_end long, text string")


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Expands every conversation, in the order :func:`format_chat` left it, and reads the examples back.

    A reply is what the loss mask of its example shows; turns are read from the part of an
    example that is not in the one before, after that one was found to be its beginning.
    Time grows with the square of a conversation, as the examples do; memory holds two of them.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, examples_chars long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()
        state: list = []
        before = ""
        out: list[tuple] = []

        def close() -> None:
            if state:
                n, turns, chars, loss, examples, total = state
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), len(before), examples, total))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for conv, example, loss_start, loss_end, text in expand(batches):
            if conv != now:
                close()
                now, state, before = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], ""
                if len(out) >= 1000:
                    yield batch_of()
                    out.clear()
            if not text.startswith(before):
                raise ValueError(f"example {example} of conversation {conv} does not begin with the one before")
            for turn in text[len(before) :].split(TURN)[1:]:
                role, said = read_segment(TURN + turn)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            before = text
            if example is not None:
                reply = unescape(text[loss_start:loss_end])
                state[2] += len(reply)
                state[3].update(reply.encode())
                state[4] += 1
                state[5] += len(text)
        close()
        yield batch_of()

    return segments.select(*_PLACES).mapInArrow(run, schema)
