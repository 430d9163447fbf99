"""Format conversations for training, with a loss flag on every segment.

A template is plain data: what stands before and after a turn of each role,
whether its text is learned, which role may follow which, and the strings that
must never appear inside a text.  Turns stream through a finite-state machine in
order; no conversation is held in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "before": "<|im_start|>{role}\n",
    "after": "<|im_end|>\n",
    "learned": ["assistant"],
    "states": {  # state -> role -> next state
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    "final": ["assistant"],
    "control": ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"],
}
SEGMENT = "conv_id long, seq long, turn long, part string, text string, loss boolean, error string"


def escaper(control: list[str]):
    """A function that makes texts free of *control* strings; :func:`unescape` undoes it.

    Backslashes are doubled; one more breaks each control string after its first
    character, overlapping ones included.
    """
    inside = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control))
    return lambda text: inside.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Segments of ``turns(conv_id, turn, role, text)``, three for each turn.

    ``part`` is ``before``, ``text`` or ``after``; ``text`` is final (escaped),
    ``loss`` says whether it is learned, ``error`` on ``before`` names a turn that
    the state machine does not accept (the turn is formatted all the same, and the
    machine goes on from that role).  A conversation that ends in a state that is
    not final has the error ``unfinished`` on its last ``after``.

    A null text is empty, a null role is the empty role, null ids form one
    conversation.  Rows are ordered by turn, then role and text, nulls first, so
    repeated rows stay and reruns agree.  Other columns are dropped.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SEGMENT))

    def run(batches):
        escape, states = escaper(template["control"]), template["states"]
        seq, state, conv, last = 0, None, object(), None
        out: list[tuple] = []

        def ended(held):
            return (*held[:6], None if state in template["final"] else "unfinished")

        for batch in batches:
            for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != conv or state is None:
                    if last:
                        out.append(ended(last))
                    conv, seq, state, last = conv_id, 0, "start", None
                elif last:
                    out.append(last)
                role, text = role or "", text or ""
                following = states.get(state, {}).get(role)
                error = None if following else f"{role or 'no role'} after {state}"
                state = following or (role if role in states else state)
                before = template["before"].format(role=escape(role))
                out.append((conv_id, seq, turn, "before", before, False, error))
                out.append((conv_id, seq + 1, turn, "text", escape(text), role in template["learned"], None))
                last = (conv_id, seq + 2, turn, "after", template["after"], False, None)
                seq += 3
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if last:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(ended(last), schema)], schema=schema)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return _by_conversation(rows, "turn", "role", "text").mapInArrow(run, SEGMENT)


def read_turns(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """``conv_id, turn_no, role, text, loss, chars``: turns taken back from formatted segments.

    Roles come from the text before a turn, texts are unescaped; ``chars`` is the
    formatted length of the turn in code points.  Rows come out in order within
    each conversation, all of a conversation in one partition.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        start, end = template["before"].split("{role}")
        conv, number, role, text, loss, chars = object(), -1, "", "", False, 0
        for batch in batches:
            out = []
            for conv_id, part, piece, learned in zip(*(c.to_pylist() for c in batch.columns)):
                if part == "before":
                    number, conv = (number + 1 if conv_id == conv else 0), conv_id
                    role, chars = unescape(piece[len(start):len(piece) - len(end)]), len(piece)
                elif part == "text":
                    text, loss, chars = unescape(piece), learned, chars + len(piece)
                else:
                    out.append((conv_id, number, role, text, loss, chars + len(piece)))
            if out:
                ids, numbers, roles, texts, losses, sizes = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(roles, pa.string()),
                     pa.array(texts, pa.string()), pa.array(losses, pa.bool_()), pa.array(sizes, pa.int64())],
                    names=["conv_id", "turn_no", "role", "text", "loss", "chars"])

    ordered = _by_conversation(segments, "seq").select("conv_id", "part", "text", "loss")
    return ordered.mapInArrow(run, "conv_id long, turn_no long, role string, text string, loss boolean, chars long")
