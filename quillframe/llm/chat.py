"""Chat formatting in budgeted windows.

Turns of a conversation are laid out in a template that marks each turn's role and end.
Prefix sums of turn tokens choose windows of whole turns: a window holds the conversation's
system turn, as many of the turns just before it as fit ``history`` tokens, and then new turns
up to ``budget`` tokens in all, one at least. The new turns of a conversation's windows are its
turns, each once, in order. Repeated turns (system and history) are marked, and the loss mask
covers just the texts of new assistant turns, so no target is learnt twice.

Texts and roles are escaped so that no control string can appear inside them: the escape
symbol is doubled, and one is put behind the first symbol of each control string. ``read``
undoes it exactly.

Conversations are dealt to partitions by id, sorted by turn and streamed: memory holds one
window, whatever the length of a conversation.

Defined results: null texts and roles are empty. Turns of one number are ordered by role, then
text, nulls first; repeated rows are further turns. Rows whose conv_id is null form one
conversation. Turns of an unknown role are laid out alike and are no targets. A turn beyond the
budget gets a window of its own with the system turn, whole. Only the named columns are used,
so names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions

ESCAPE = "\\"
START, END = "<|turn|>", "<|end|>"
#: Control strings that no text may hold, the template's own first.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_RISKY = re.compile("|".join([re.escape(ESCAPE), *map(re.escape, CONTROL)]))
_TOKEN = re.compile(r"\w+|[^\w\s]")
BUDGET, HISTORY = 512, 96


def escape(text: str) -> str:
    return _RISKY.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    """A doubled escape stands for one; a single one was put in."""
    return re.sub(r"\\(\\?)", r"\1", text)


def tokens(text: str) -> int:
    """A turn's tokens: words and signs of its text, and four for its marks."""
    return 4 + sum(1 for _ in _TOKEN.finditer(text))


@dataclass
class Window:
    repeats: int
    text: str
    spans: list[tuple[int, int]]


def laid_out(turns: list[tuple[str, str]], repeats: int) -> Window:
    out, n, spans = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = f"{START}{escape(role).replace(chr(10), ESCAPE + chr(10))}\n", escape(text)
        if i >= repeats and role == "assistant":
            spans.append((n + len(head), n + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        n += len(out[-1])
    return Window(repeats, "".join(out), spans)


@dataclass
class Windows:
    """A conversation's turns in order; push yields windows that are complete."""

    budget: int = BUDGET
    history: int = HISTORY
    system: tuple[str, str] | None = None
    past: list[tuple[str, str]] = field(default_factory=list)
    new: list[tuple[str, str]] = field(default_factory=list)
    #: Prefix sums of tokens of past + new.
    sums: list[int] = field(default_factory=lambda: [0])
    shown: bool = False

    def push(self, role: str, text: str) -> Iterator[Window]:
        n = tokens(text)
        base = tokens(self.system[1]) if self.system and self.shown else 0
        if self.new and base + self.sums[-1] + n > self.budget:
            yield self.flush()
            base = tokens(self.system[1]) if self.system else 0
            # the oldest repeated turns make way where the turn wouldn't fit
            while self.past and base + self.sums[-1] + n > self.budget:
                first = self.sums[1]
                self.past, self.sums = self.past[1:], [x - first for x in self.sums[1:]]
        if role == "system" and self.system is None:
            self.system = (role, text)
        self.new.append((role, text))
        self.sums.append(self.sums[-1] + n)

    def flush(self) -> Window:
        system = [self.system] if self.system and self.shown else []
        w = laid_out(system + self.past + self.new, len(system) + len(self.past))
        self.shown = self.system is not None
        turns, k = self.past + self.new, 0
        while k < len(turns) and (self.sums[-1] - self.sums[len(turns) - k - 1] <= self.history) and turns[len(turns) - k - 1] is not self.system:
            k += 1
        self.past, self.new = turns[len(turns) - k :], []
        base = self.sums[len(turns) - k]
        self.sums = [x - base for x in self.sums[len(turns) - k :]]
        return w

    def finish(self) -> Iterator[Window]:
        if self.new:
            yield self.flush()


def read(text: str, repeats: int) -> list[tuple[str, str]]:
    """The new turns (role, text) of a window, from its text."""
    out, at = [], 0
    while at < len(text):
        m = _turn(text, at)
        out.append((unescape(m[0]), unescape(m[1])))
        at = m[2]
    return out[repeats:]


def _turn(text: str, at: int) -> tuple[str, str, int]:
    """Role, text (both escaped) and end of the turn at a place. The end mark can't be inside: there it is broken by an escape."""
    if not text.startswith(START, at):
        raise ValueError("no turn begins here")
    a = at + len(START)
    b = text.index("\n", a)
    while (b - a - len(text[a:b].rstrip(ESCAPE))) % 2:  # an odd run of escapes: part of the role
        b = text.index("\n", b + 1)
    c = text.index(END, b + 1)
    return text[a:b], text[b + 1 : c], c + len(END) + 1


def _stream(it, budget: int, history: int):
    """Windows of each conversation of a sorted partition; columns conv, role, text."""
    conv: object = None
    windows: Windows | None = None
    number = 0
    rows: list = []

    def batch():
        c, n, w = ([r[i] for r in rows] for i in range(3))
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array([x.repeats for x in w], pa.int32()), pa.array([x.text for x in w]), pa.array([[a for a, _ in x.spans] for x in w], pa.list_(pa.int32())), pa.array([[b for _, b in x.spans] for x in w], pa.list_(pa.int32()))], names=["conv_id", "window", "repeats", "formatted", "loss_start", "loss_end"])
        rows.clear()
        return out

    for b in it:
        for c, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if windows is None or c != conv:
                if windows is not None:
                    for w in windows.finish():
                        rows.append((conv, number, w))
                conv, windows, number = c, Windows(budget, history), 0
            for w in windows.push(role or "", text or ""):
                rows.append((conv, number, w))
                number += 1
            if len(rows) >= 500:
                yield batch()
    if windows is not None:
        for w in windows.finish():
            rows.append((conv, number, w))
    if rows:
        yield batch()


def format_windows(df: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, repeats (leading turns that are repeated), formatted, loss_start and loss_end (the mask's spans, code points); a partition's rows are sorted by conv_id and window."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(lambda it: _stream(it, budget, history), "conv_id long, window int, repeats int, formatted string, loss_start array<int>, loss_end array<int>")


def _read_back(it):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
    now: list | None = None
    done: list = []
    for b in it:
        for conv, window, repeats, text, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or window == 0:
                if now is not None:
                    done.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, t in read(text, repeats):
                now[1] += 1
                now[2].update(f"{role}\n{t}\n".encode())
            for s, e in zip(starts, ends, strict=True):
                t = unescape(text[s:e])
                now[3] += len(t)
                now[4].update(t.encode())
            now[5] += len(text)
            now[6] += 1
        if done:
            yield _digests(done, schema)
            done = []
    if now is not None:
        yield _digests([now], schema)


def _digests(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in c] for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation of what format_windows' output holds; windows as they leave it, in its partitions and order."""
    return windows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    return read_back(format_windows(rows))
