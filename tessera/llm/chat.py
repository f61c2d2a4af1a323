"""Chat formatting: a finite-state machine over roles validates the order of turns, and a declarative template turns each
conversation into text segments with a loss flag per segment.

Template: a turn is written as ``opening + label + ": " + text + closing``. Labels, texts and roles are escaped: a
backslash goes before every backslash and before every character with which a control string of the template begins, so
no control string can arise inside a text or across its ends, and removing one backslash before each escaped character
gives the text back exactly.

Order of turns: by turn (null first), then role, then text; repeated rows are turns of their own. A null role or text is
the empty string. Roles that the template does not name are written under an escaped label of their own; the machine
rejects them, as it rejects every other move it has no transition for. Rejected conversations are still formatted:
``valid`` is false and ``first_error`` has the position (from 0) of the first turn that was not allowed, or the number of
turns if the conversation ended in a state that is not final; of valid ones it is -1. A null conv_id is a conversation of its own. An empty table
gives an empty result; further columns of the input are ignored.

Scale: one shuffle by conversation with a sort inside partitions; rows are then streamed, so that a conversation of any
length needs the memory of one batch. The digests of a conversation are sequential by definition and stay in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opening: str = "### "
    between: str = ": "
    closing: str = "</turn>\n"
    escape: str = "\\"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    #: Roles whose texts are learned.
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) to the next state.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("asked", "answered")

    def special(self) -> str:
        """Characters that are escaped inside texts and labels."""
        return "".join(sorted({self.escape, self.opening[0], self.between[0], self.closing[0]}))


class Writer:
    def __init__(self, template: Template) -> None:
        self.t = template
        self.find = re.compile("([" + re.escape(template.special()) + "])")
        self.put = template.escape.replace("\\", "\\\\") + r"\1"

    def guard(self, text: str) -> str:
        return self.find.sub(self.put, text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The texts of a turn with their loss flags."""
        label = self.t.labels.get(role)
        # "=" marks the label of a role that the template does not name
        label = label if label is not None else "=" + self.guard(role)
        return [(self.t.opening + label + self.t.between, False), (self.guard(text), role in self.t.learned), (self.t.closing, False)]


class Reader:
    def __init__(self, template: Template) -> None:
        e, special = re.escape(template.escape), re.escape(template.special())
        part = f"((?:[^{special}]|{e}.)*)"
        self.turn = re.compile(re.escape(template.opening) + part + re.escape(template.between) + part + re.escape(template.closing), re.DOTALL)
        self.plain = re.compile(e + "(.)", re.DOTALL)
        self.roles = {v: k for k, v in template.labels.items()}

    def unguard(self, text: str) -> str:
        return self.plain.sub(r"\1", text)

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """The roles and texts of whole turns; anything else in text is an error."""
        at = 0
        for m in self.turn.finditer(text):
            if m.start() != at:
                break
            at = m.end()
            label = m[1]
            yield self.roles[label] if label in self.roles else self.unguard(label[1:]), self.unguard(m[2])
        if at != len(text):
            raise ValueError(f"no turn at character {at}")


SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, state string, allowed boolean"


def format_conversations(conversations: DataFrame, template: Template | None = None, partitions: int | None = None) -> DataFrame:
    """A row for each segment, in order inside each partition: conv_id, turn_no (from 0), segment, text, loss, state, allowed.

    Text segments hold escaped text; the segments of a conversation, one after another, are its formatted text.
    """
    template = template or Template()
    turns = conversations.select(
        # as text: a null beside them would make doubles of large ids
        F.col("conv_id").cast("long").cast("string").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    by_conv = turns.repartition(partitions, "conv_id") if partitions else turns.repartition("conv_id")
    # ids need to stand together only
    ordered = by_conv.sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, at, number, state = Writer(template), (), 0, template.start
        for frame in frames:
            out: list[tuple] = []
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
                if at != (key := (None if conv is None else int(conv),)):
                    at, number, state = key, 0, template.start
                allowed = (state, role) in template.moves
                # after a turn that is not allowed, the machine goes on as if the role had just come in order
                state = template.moves.get((state, role)) or next((v for k, v in template.moves.items() if k[1] == role), state)
                out += [(at[0], number, i, t, loss, state, allowed) for i, (t, loss) in enumerate(writer.segments(role, text))]
                number += 1
            made = pd.DataFrame([x[1:] for x in out], columns=["turn_no", "segment", "text", "loss", "state", "allowed"])
            made.insert(0, "conv_id", pd.array([x[0] for x in out], "Int64"))
            yield made

    return ordered.mapInPandas(write, SEGMENTS)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "valid boolean, first_error long"
)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each conversation, from the output of format_conversations with its partitions and order as they are.

    The formatted text is parsed again, turn by turn; what stands under the loss mask is unescaped.
    """
    template = template or Template()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, now = Reader(template), None

        def done(x: dict) -> dict:
            error = x["error"] if x["error"] is not None or x["state"] in template.final else x["n"]
            return {
                "conv_id": x["conv"], "n_turns": x["n"], "turns_sha256": x["turns"].hexdigest(), "loss_chars": x["loss_chars"],
                "loss_sha256": x["loss"].hexdigest(), "formatted_chars": x["chars"], "valid": error is None, "first_error": -1 if error is None else error,
            }

        def close(x: dict, formatted: list[str]) -> None:
            for role, text in reader.turns("".join(formatted)):
                x["turns"].update(f"{role}\n{text}\n".encode())
                x["n"] += 1
            formatted.clear()

        formatted: list[str] = []
        for frame in frames:
            out = []
            columns = [frame["conv_id"], *(frame[k] for k in ("turn_no", "segment", "text", "loss", "state", "allowed"))]
            for conv, turn, segment, text, loss, state, allowed in zip(*columns, strict=True):
                conv = None if conv is None else int(conv)
                if segment == 0 and turn == 0:
                    if now:
                        close(now, formatted)
                        out.append(done(now))
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "error": None, "state": state}
                formatted.append(text)
                now["chars"] += len(text)
                now["state"] = state
                if not allowed and now["error"] is None:
                    now["error"] = int(turn)
                if loss:
                    plain = reader.unguard(text)
                    now["loss_chars"] += len(plain)
                    now["loss"].update(plain.encode())
                if segment == 2 and len(formatted) > 3_000:
                    close(now, formatted)
            yield _frame(out)
        if now:
            close(now, formatted)
            yield _frame([done(now)])

    def _frame(rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame([{k: v for k, v in x.items() if k != "conv_id"} for x in rows], columns=[x.split()[0] for x in DIGEST.split(", ")][1:])
        frame.insert(0, "conv_id", pd.array([x["conv_id"] for x in rows], "Int64"))
        return frame

    return segments.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(read, DIGEST)
