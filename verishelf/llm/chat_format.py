"""Chat formatting: a role automaton checks turn order; a template gives text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A declarative template.

    A turn reads open, role, mid, text, close. Only the text of a role in `loss_roles` is under
    the loss. `moves` are the roles that may follow a state, the state being the last role or
    "" at the start; a role without an entry may not be followed.
    """

    open: str = "<|im_start|>"
    mid: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    moves: Mapping[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state, and whether the move is allowed; the automaton goes on either way."""
        return role, role in self.moves.get(state, frozenset())


_MARK = re.compile(r"<(\\*)\|")
_MARKED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No "<|" is left: a backslash goes into each "<", backslashes, "|"."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: its line feeds and backslashes are written as escapes, and then as text is."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


_SEGMENTS = "conv_id {id}, turn {turn}, seg int, segment string, loss boolean, allowed boolean"


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The formatted text of each conversation as segments with loss flags, in order.

    turns: conv_id, turn, role, text; other columns are ignored. Rows are ordered by turn, then
    role, then text; null turns come first, null roles and texts read as empty, null conv_ids
    are one conversation. Repeated rows are turns of their own; an empty table gives none. Each turn gives three segments
    (header, text, close): their concatenation is the formatted conversation, and the text
    segments with loss are what a model learns. `allowed` says whether the automaton allows the
    turn where it stands; turns that it doesn't allow are formatted nevertheless.

    Conversations are streamed through sorted partitions: a task holds a batch of rows, however
    long a conversation is. The segments of a conversation stay together and in order.
    """
    t = template or ChatTemplate()
    kinds = dict(turns.dtypes)
    ready = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, "", True
        for batch in batches:
            ids, turn_no = batch.column("conv_id"), batch.column("turn")
            segment, loss, allowed = [], [], []
            for conv, role, text in zip(ids.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if first or conv != last:
                    first, last, state = False, conv, ""
                state, ok = t.step(state, role)
                segment += [t.open + escape_role(role) + t.mid, escape(text), t.close]
                loss += [False, role in t.loss_roles, False]
                allowed += [ok] * 3
            n = len(ids)
            thrice = pa.array([i for i in range(n) for _ in range(3)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.take(thrice), turn_no.take(thrice), pa.array([0, 1, 2] * n, pa.int32()), pa.array(segment, pa.string()), pa.array(loss, pa.bool_()), pa.array(allowed, pa.bool_())],
                names=["conv_id", "turn", "seg", "segment", "loss", "allowed"],
            )

    return ready.mapInArrow(render, _SEGMENTS.format(id=kinds["conv_id"], turn=kinds["turn"]))


class _Reader:
    """Reads one conversation back from its formatted text, segment by segment."""

    def __init__(self, conv, template: ChatTemplate):
        self.conv, self.t, self.rest = conv, template, ""
        self.turns = self.allowed = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        head = re.escape(template.open) + r"([^\n]*?)" + re.escape(template.mid)
        self.turn = re.compile(f"{head}((?:(?!{re.escape(template.close)}).)*){re.escape(template.close)}", re.DOTALL)

    def feed(self, segment: str, loss: bool, allowed: bool) -> None:
        self.chars += len(segment)
        if loss:
            text = unescape(segment)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.rest += segment
        if segment == self.t.close:
            m = self.turn.fullmatch(self.rest)
            if not m:
                raise ValueError("the formatted text can't be read back")
            self.turns += 1
            self.allowed += allowed
            self.all.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            self.rest = ""


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Digests of format_chats' output: per conversation, what its formatted text says.

    Takes the segments in their order, parses each turn with the template and undoes the
    escapes. Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_allowed (turns
    that the automaton allows where they stand). An empty table gives none.
    """
    t = template or ChatTemplate()
    kind = dict(segments.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None

        def rows(done: list[_Reader], id_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r.conv for r in done], id_type),
                    pa.array([r.turns for r in done], pa.int64()),
                    pa.array([r.all.hexdigest() for r in done], pa.string()),
                    pa.array([r.loss_chars for r in done], pa.int64()),
                    pa.array([r.loss.hexdigest() for r in done], pa.string()),
                    pa.array([r.chars for r in done], pa.int64()),
                    pa.array([r.allowed for r in done], pa.int64()),
                ],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_allowed"],
            )

        id_type = pa.int64()
        for batch in batches:
            done: list[_Reader] = []
            id_type = batch.column("conv_id").type
            for conv, segment, loss, allowed in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "allowed")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now)
                    now = _Reader(conv, t)
                now.feed(segment, loss, allowed)
            if done:
                yield rows(done, id_type)
        if now is not None:
            yield rows([now], id_type)

    return segments.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_allowed long")
