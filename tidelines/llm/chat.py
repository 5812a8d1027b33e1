"""Chat formatting in budgeted windows.

Turns become marked, escaped text. A window holds the conversation's system turn, some repeated history and new turns, as many
as its token budget allows: prefix sums of turn tokens choose the spans, always at turn boundaries. Only assistant turns that
are new in a window are under its loss mask; repeated ones are masked, so every assistant turn is a target once.

The work streams over rows sorted by conversation and turn: a task holds one window, never a whole conversation.

Defined results: null texts and roles count as empty; turns of equal number are ordered by role and text and all kept; null
turns come first; rows with a null conv_id form one conversation; a turn larger than the budget gets a window of its own and
stays whole; an empty table gives an empty result. Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches

OPEN, CLOSE = "### ", "</turn>\n"
#: What stands for the control strings inside roles and texts. The backslash goes first.
ESCAPES = (("\\", "\\s"), ("### ", "\\h"), ("</turn>", "\\c"))

WINDOW_SCHEMA = "conv_id long, window int, formatted string, repeated int, n_new int, loss_starts array<int>, loss_ends array<int>, n_tokens long"


def escape(text: str) -> str:
    for plain, code in ESCAPES:
        text = text.replace(plain, code)
    return text


def unescape(text: str) -> str:
    # codes can't overlap, and no plain form can arise from a later one's code
    for plain, code in reversed(ESCAPES):
        text = text.replace(code, plain)
    return text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and where its content starts and ends in it. Line feeds in roles are escaped as well."""
    head = OPEN + escape(role).replace("\n", "\\l") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        head, _, body = part.partition("\n")
        turns.append((unescape(head[len(OPEN) :].replace("\\l", "\n")), unescape(body)))
    return turns


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


class Windower:
    """Windows of one conversation, fed turn by turn."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: Turn | None = None
        self.turns: list[Turn] = []  # repeated history, then new turns
        self.repeated = self.index = self.seen = 0
        self.sums = [0]  # prefix sums of the tokens of self.turns

    def add(self, turn: Turn) -> Iterator[tuple]:
        room = self.budget - (self.system.tokens if self.system else 0)
        if len(self.turns) > self.repeated and self.sums[-1] + turn.tokens > room:
            yield self.window()
            self.carry(room - turn.tokens)
        if not self.seen and turn.role == "system":
            self.system = turn
        self.seen += 1
        if self.system is not turn:
            self.turns.append(turn)
            self.sums.append(self.sums[-1] + turn.tokens)

    def carry(self, room: int) -> None:
        """Keep the latest turns that fit into the history limit and leave room for the next turn."""
        limit, last = min(self.history, room), self.sums[-1]
        first = next((i for i in range(len(self.turns) + 1) if last - self.sums[i] <= max(0, limit)), len(self.turns))
        self.turns = self.turns[first:]
        self.sums = [s - self.sums[first] for s in self.sums[first:]]
        self.repeated = len(self.turns)

    def window(self) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        lead = [self.system] if self.system else []
        for i, turn in enumerate(lead + self.turns):
            piece, a, b = format_turn(turn.role, turn.text)
            if turn.role == "assistant" and i >= len(lead) + self.repeated:
                starts.append(at + a)
                ends.append(at + b)
            parts.append(piece)
            at += len(piece)
        # of the turns in the text, the first ones repeat what earlier windows hold
        known = (len(lead) if self.index else 0) + self.repeated
        out = (self.conv_id, self.index, "".join(parts), known, len(lead) + len(self.turns) - known, starts, ends, self.sums[-1] + sum(t.tokens for t in lead))
        self.index += 1
        return out

    def finish(self) -> Iterator[tuple]:
        if len(self.turns) > self.repeated or self.system and not self.index:
            yield self.window()


def format_conversations(df: DataFrame, budget: int = 1024, history: int = 256, n_tokens_col: str | None = None) -> DataFrame:
    """Windows of all conversations: conv_id, window, formatted, repeated (turns known from before), n_new, loss spans.

    budget and history are in tokens; n_tokens_col names a column with each turn's tokens, else a quarter of its characters
    and four for its marks are taken. Rows come out sorted by conversation and window within each partition.
    """
    bound_batches(df.sparkSession)
    text = F.coalesce(df["text"], F.lit(""))
    tokens = df[n_tokens_col] if n_tokens_col else F.ceil(F.length(text) / 4) + 4
    rows = df.select(df["conv_id"].cast("bigint").alias("conv_id"), df["turn"].cast("bigint").alias("turn"), F.coalesce(df["role"], F.lit("")).alias("role"), text.alias("text"), F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("tokens"))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def windows(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("repeated", pa.int32()), ("n_new", pa.int32()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())), ("n_tokens", pa.int64())])

        def pack(found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        current, found, size = None, [], 0
        for batch in batches:
            for conv_id, _, role, said, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv_id != current.conv_id:
                    found += current.finish() if current else []
                    current = Windower(conv_id, budget, history)
                for w in current.add(Turn(role, said, n)):
                    found.append(w)
                size += len(said)
                if found and (len(found) >= 500 or size > 4 << 20):
                    yield pack(found)
                    found, size = [], 0
        found += current.finish() if current else []
        if found:
            yield pack(found)

    return sorted_rows.mapInArrow(windows, WINDOW_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digest_windows(windows: DataFrame) -> DataFrame:
    """Read windows back, as they come sorted from format_conversations: a row of digests by conversation."""

    def digests(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]

        def pack(found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, zip(*found, strict=True), strict=True)], names=names)

        key, turns, loss, n, chars, formatted, count = None, None, None, 0, 0, 0, 0
        close = lambda: (key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count)
        found = []
        for batch in batches:
            columns = batch.select(["conv_id", "formatted", "repeated", "loss_starts", "loss_ends"]).columns
            for conv_id, text, repeated, starts, ends in zip(*(c.to_pylist() for c in columns), strict=True):
                if turns is None or conv_id != key:
                    found += [close()] if turns is not None else []
                    key, turns, loss, n, chars, formatted, count = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for role, said in parse_turns(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in zip(starts, ends, strict=True):
                    target = unescape(text[a:b])
                    loss.update(target.encode())
                    chars += len(target)
                formatted += len(text)
                count += 1
                if len(found) >= 2000:
                    yield pack(found)
                    found = []
        found += [close()] if turns is not None else []
        if found:
            yield pack(found)

    return windows.mapInArrow(digests, DIGEST_SCHEMA)
