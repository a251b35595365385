"""Chat formatting: token-budgeted, turn-aligned windows with a template that can be read back.

A window starts with the system turn, repeats a few turns of history, and goes on with new turns. The loss mask
covers the text of assistant turns that are new in a window; a repeated turn is masked out, so every target counts
once. Conversations stream through a task in key order, so memory holds one window, however long a conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 512  # tokens of a window, history and system turn included
HISTORY = 128  # tokens of a window that repeated turns may take

# The template: <|role|>\n text <|end|>\n. Inside texts and roles a control string gets a backslash after "<" and
# every backslash is doubled, so no text can end its turn, and reading back undoes exactly that.
END = "<|end|>\n"
_OPEN = re.compile(r"<\|((?:[^|\\]|\\.|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.S)
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.?)", lambda m: "\\" if m[1] == "\\" else m[1], text, flags=re.S)


def tokens(text: str) -> int:
    """Length of a text in tokens for the budget: words, at least one for each 6 characters, and the two marks."""
    return max(len(text.split()), -(-len(text) // 6)) + 2


@dataclass
class Formatted:
    """One window: its text, the masked ranges of the text, and the turns that are new in it."""

    text: str = ""
    mask: list[tuple[int, int]] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    new: list[bool] = field(default_factory=list)

    def add(self, role: str, text: str, new: bool) -> None:
        body = escape(text)
        self.text += f"<|{escape(role)}|>\n"
        if new and role == "assistant":
            self.mask.append((len(self.text), len(self.text) + len(body)))
        self.text += body + END
        self.roles.append(role)
        self.new.append(new)

    def read(self) -> list[tuple[str, str]]:
        """Role and text of every turn, from the text alone."""
        return [(unescape(m[1]), unescape(m[2])) for m in _OPEN.finditer(self.text)]


def windows(turns: Iterator[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[Formatted]:
    """Windows over the turns of one conversation, in order.

    With prefix sums P of turn tokens, a window that starts at turn s ends before the first turn e with
    P[e] - P[s] beyond what the system turn and the history leave of the budget; a turn that is longer than that
    is a window of its own, whole. The history is the longest run of turns before s within its limit.
    """
    system: tuple[str, str] | None = None
    past: list[tuple[str, str, int]] = []  # turns (role, text, prefix sum up to and with it) that may be repeated
    window, room, total, start = None, 0, 0, 0
    for role, text in turns:
        cost = tokens(text)
        if window is None or total + cost - start > room:
            if window is not None:
                yield window
            window, start = Formatted(), total
            spent = 0
            if system is not None:
                window.add(*system, new=False)
                spent += tokens(system[1])
            before = [t for t in past if start - t[2] + tokens(t[1]) <= history]
            for r, x, _ in before:
                window.add(r, x, new=False)
                spent += tokens(x)
            past = before
            room = max(budget - spent, 0)
        window.add(role, text, new=True)
        total += cost
        if role == "system":
            system = (role, text)
        else:
            past.append((role, text, total))
            while past and total - past[0][2] + tokens(past[0][1]) > history:
                past.pop(0)
    if window is not None:
        yield window


DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
          "formatted_chars bigint, n_windows bigint")
WINDOWS = "conv_id bigint, window_no bigint, text string, mask array<struct<start:bigint,end:bigint>>, new array<boolean>"


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id (as text), role, text with the turns of a conversation together and in order in one task."""
    slim = conversations.select(
        F.col("conv_id").cast("bigint").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    return slim.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"
    ).select("conv_id", "role", "text")


def _by_conversation(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Conversations as streams over the batches; null ids are one conversation."""
    rows = (r for f in frames for r in zip(f["conv_id"], f["role"], f["text"]))
    for key, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield (None if key is None else int(key)), ((r[1], r[2]) for r in own)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of conversations(conv_id, turn, role, text): text, masked ranges, and which turns are new.

    Turns go by turn number, nulls first, ties by role and text; repeated rows are turns of their own. Null texts
    and roles are empty. A null conv_id is a conversation. The latest system turn so far is kept in every window after
    its own. Turns are never cut. Other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for conv_id, turns in _by_conversation(frames):
            for k, w in enumerate(windows(turns, budget, history)):
                yield pd.DataFrame({
                    "conv_id": pd.array([conv_id], dtype="Int64"), "window_no": [k], "text": [w.text],
                    "mask": [[{"start": a, "end": b} for a, b in w.mask]], "new": [w.new]})

    return ordered(conversations).mapInPandas(run, WINDOWS)


def digests(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per conversation, read back from its windows: turns, masked texts, and characters of the formatted text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = []
        for conv_id, turns in _by_conversation(frames):
            n, n_windows, chars, loss_chars = 0, 0, 0, 0
            said, loss = hashlib.sha256(), hashlib.sha256()
            for w in windows(turns, budget, history):
                n_windows += 1
                chars += len(w.text)
                for (role, text), new in zip(w.read(), w.new, strict=True):
                    if new:
                        n += 1
                        said.update(f"{role}\n{text}\n".encode())
                for a, b in w.mask:
                    text = unescape(w.text[a:b])
                    loss_chars += len(text)
                    loss.update(text.encode())
            done.append((conv_id, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows))
            if len(done) == 5_000:
                yield _frame(done)
                done = []
        yield _frame(done)

    return ordered(conversations).mapInPandas(run, DIGEST)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[f.split()[0] for f in DIGEST.split(", ")])
    frame["conv_id"] = pd.array([r[0] for r in rows], dtype="Int64")
    return frame
