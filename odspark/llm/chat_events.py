r"""Conversations rebuilt from event logs and rendered for training.

An event belongs to a conversation and a message position, carries a sequence
number and one of four kinds:

    message     opens or replaces the message with its role and text
    delta       appends its text
    edit        replaces the text
    regenerate  empties the message; deltas that follow fill it again

``fold_events`` partitions the log by conversation and position, sorts by
sequence and folds each message on its own, so a conversation with a third of
all events spreads over as many tasks as it has messages; the text of one
message is the largest thing held together. ``render`` turns each message into
its piece of the formatted text; the pieces of a conversation, in order of
position, are the formatted conversation.

Template of one turn: ``<|turn|>role<|text|>text<|end|>``, and ``<|mask|>``
behind ``<|text|>`` for a turn under the loss mask (role ``assistant``).
Escaping is reversible: within role and text every ``\`` becomes ``\\``
and every control string (those of the template and of common chat formats)
gets ``\|`` behind its first character, so no control string survives in a
text and undoing both restores it.

Defined results: a null text counts as empty; a null role is kept apart from an
empty one (rendered as the escape ``\0``); events of a message that were never
opened fold like an opened one with the role of their first event; equal events
(same sequence) are ordered by kind, role and text; null sequence numbers come
first; a null conversation is a conversation of its own; an empty log gives no
turns; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MASK, END = "<|turn|>", "<|text|>", "<|mask|>", "<|end|>"
# Strings that must not survive inside a text.
CONTROL = [TURN, TEXT, MASK, END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>",
           "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LOSS_ROLES = ("assistant",)
_KINDS = ("message", "delta", "edit", "regenerate")

_CONTROL_RE = "|".join(f"({re.escape(c[0])})({re.escape(c[1:])})" for c in CONTROL)


def fold_events(events: DataFrame, conv: str = "conv_id", position: str = "position", seq: str = "seq",
                kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, role, text): the final messages of every conversation."""
    e = events.select(F.col(conv).alias("conv_id"), F.col(position).alias("position"),
                      F.struct(F.col(seq).alias("seq"), F.col(kind).alias("kind"), F.col(role).alias("role"),
                               F.coalesce(text, F.lit("")).alias("text")).alias("e"))
    restart = F.col("e.kind").isin("message", "edit", "regenerate")
    g = e.groupBy("conv_id", "position").agg(F.array_sort(F.collect_list("e")).alias("log"))
    # the last event that sets the text anew, then the deltas behind it
    last = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0)))
    tail = F.slice("log", last + 1, F.size("log"))
    body = F.array_join(F.transform(tail, lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "")
    opened = F.filter("log", lambda x: x["kind"] == "message")
    said = F.when(F.size(opened) > 0, F.element_at(opened, -1)["role"]).otherwise(F.col("log")[0]["role"])
    return g.select("conv_id", "position", said.alias("role"), body.alias("text"))


def escape(c: Column) -> Column:
    r"""Reversible: doubles ``\`` and breaks control strings behind their first character."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\|" + s[1:]))
    return out


def unescape(s: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[0] == "\\\\" else "", s)


_UNESCAPE = re.compile(r"\\\\|\\\|")


def render(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, position, piece): each turn's part of the formatted conversation."""
    head = F.concat(F.lit(TURN), F.coalesce(escape(F.col("role")), F.lit("\\0")), F.lit(TEXT),
                    F.when(F.col("role").isin(*loss_roles), MASK).otherwise(""))
    return turns.select("conv_id", "position",
                        F.concat(head, escape(F.coalesce("text", F.lit(""))), F.lit(END)).alias("piece"))


def parse_piece(piece: str) -> tuple[str | None, str, bool, str]:
    """(role, text, under the loss mask, escaped text) of one rendered turn."""
    head, _, rest = piece[len(TURN):].partition(TEXT)
    masked = rest.startswith(MASK)
    body = rest[len(MASK) * masked:-len(END)]
    return (None if head == "\\0" else unescape(head)), unescape(body), masked, body


def digest(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered pieces: counts and digests.

    Hashes run over the turns in order, batch by batch, so a task holds one
    Arrow batch however long its conversation is."""
    def run(batches):
        held, state = object(), None

        def row():
            n, h, lc, lh, fc = state
            return (held, n, h.hexdigest(), lc, lh.hexdigest(), fc)

        for b in batches:
            done = []
            for conv, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or conv != held:
                    if state is not None:
                        done.append(row())
                    held, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, masked, _ = parse_piece(piece)
                state[0] += 1
                state[1].update(f"{role or ''}\n{text}\n".encode())
                if masked:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(piece)
            if done:
                yield _rows(done, names, b.column(0).type)
            kind = b.column(0).type
        if state is not None:
            yield _rows([row()], names, kind)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = pieces.schema["conv_id"].dataType.simpleString()
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "position")
            .select("conv_id", "piece")
            .mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))


def _rows(rows, names, kind):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else None) for i, c in enumerate(cols)],
                                      names=names)
