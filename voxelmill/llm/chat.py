"""Chat formatting in budgeted windows.

A conversation is cut at turns. The running sum of turn tokens decides how many turns a window of ``budget``
tokens holds; a window opens with the system turn and with the last turns before it, at most ``history`` turns
and a quarter of the budget, and both are masked there: each assistant text is a target once. A turn longer
than the budget has a window to itself.

Template: ``<<SYS>>text<</SYS>>`` system, ``[INST]text[/INST]`` user, ``<s>text</s>`` assistant, and
``<<ROLE>>role<</ROLE>>text<</TURN>>`` for any other role. In texts and roles a backslash is doubled and a
control string gets a backslash after its first character; taking each backslash away restores the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import PieceTokenizer
from .words import slices

CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>")
_FORM = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_ROLE = {v[0]: (k, v[1]) for k, v in _FORM.items()}
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPE = re.compile(r"\\(.)", re.S)
WINDOWS = "conv_id {kind}, window long, text string, n_turns int, n_repeated int, tokens long, loss_from array<int>, loss_to array<int>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, str, str]:
    """(opening, escaped text, closing)."""
    if role in _FORM:
        a, b = _FORM[role]
        return a, escape(text), b
    return f"<<ROLE>>{escape(role)}<</ROLE>>", escape(text), "<</TURN>>"


def parse(window: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out, at = [], 0
    while at < len(window):
        m = _CONTROL.match(window, at)
        if m[0] in _ROLE:
            role, close = _ROLE[m[0]]
            at = m.end()
        else:
            end = window.index("<</ROLE>>", m.end())
            role, close, at = unescape(window[m.end() : end]), "<</TURN>>", end + len("<</ROLE>>")
        end = window.index(close, at)
        out.append((role, unescape(window[at:end])))
        at = end + len(close)
    return out


class _Windows:
    """Turns of one conversation in, windows out; holds one window and the turns that may be repeated."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system, self.recent, self.turns, self.fresh, self.n = None, [], [], 0, 0
        self.total = self.opened = 0  # running sums of tokens: of all turns, and where the window's own turns began

    def add(self, role: str, text: str, tokens: int):
        if self.fresh and self.repeated + self.total - self.opened + tokens > self.budget:
            yield self._close()
        if not self.fresh:
            self._open(tokens)
        turn = (role, text, tokens)
        if role == "system" and not self.recent:
            self.system = turn
        self.turns.append((role, text, True))
        self.fresh += 1
        self.total += tokens
        self.recent = [*self.recent, turn][-max(1, self.history) :]

    def _open(self, tokens: int):
        self.turns, self.repeated, self.opened = [], 0, self.total
        if self.total == 0 and not self.recent:
            return
        keep = []
        room = min(self.budget // 4, self.budget - tokens - (self.system[2] if self.system else 0))
        for turn in reversed(self.recent[-self.history :] if self.history else []):
            if turn is self.system or room < turn[2]:
                break
            room -= turn[2]
            keep.insert(0, turn)
        if self.system and self.system[2] + tokens <= self.budget:
            keep.insert(0, self.system)
        self.turns = [(r, t, False) for r, t, _ in keep]
        self.repeated = sum(k for *_, k in keep)

    def _close(self) -> tuple:
        text, at, start, stop = [], 0, [], []
        for role, body, own in self.turns:
            a, b, c = render(role, body)
            if own and role == "assistant":
                start.append(at + len(a))
                stop.append(at + len(a) + len(b))
            text += [a, b, c]
            at += len(a) + len(b) + len(c)
        out = (self.conv, self.n, "".join(text), len(self.turns), len(self.turns) - self.fresh, self.repeated + self.total - self.opened, start, stop)
        self.n, self.fresh = self.n + 1, 0
        return out

    def end(self):
        if self.fresh:
            yield self._close()


def _format(path: str, budget: int, history: int, names: list, kind: pa.DataType):
    schema = [kind, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        tokenizer, now, out = PieceTokenizer(path), None, []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(schema)], names=names)
        for batch in batches:
            for part in slices(batch, 500, 4 << 20):
                convs, roles, texts = part.column(0).to_pylist(), *([x or "" for x in part.column(c).to_pylist()] for c in (2, 3))
                sizes = [len(x) for x in tokenizer.encode(["".join(render(*x)) for x in zip(roles, texts, strict=True)])]
                for conv, role, text, tokens in zip(convs, roles, texts, sizes, strict=True):
                    if now is None or conv != now.conv:
                        if now is not None:
                            out += now.end()
                        now = _Windows(conv, budget, history)
                    out += now.add(role, text, tokens)
                if out:
                    yield pack(out)
                    out = []
        if now is not None:
            yield pack(list(now.end()))

    return run


def format_windows(turns: DataFrame, tokenizer_path: str, budget: int = 1024, history: int = 2, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows of every conversation: conv_id, window, text, n_turns, n_repeated (turns at the start that stood
    before), tokens, loss_from and loss_to (code points of the targets in text, escaped form).

    Rows are ordered by turn (nulls first), then role, then text; all rows are kept, repeated ones too. Null role or
    text: empty. Rows without a conv_id form one conversation. Tokens are those of the turns as they are written, marks and
    escapes included. A window exceeds ``budget`` only where one turn alone does; that turn then has a window of its own,
    and a system turn is left out of the windows whose first new turn leaves it no room. Other columns are ignored; no rows give no rows.
    A conversation streams through its task in sorted order; only one window of it is held.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "window", "text", "n_turns", "n_repeated", "tokens", "loss_from", "loss_to"]
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.mapInArrow(_format(tokenizer_path, budget, history, names, to_arrow_type(rows.schema["conv_id"].dataType)), WINDOWS.format(kind=kind))


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of the conversations as they stand in ``format_windows``' output, taken from its text and masks alone:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Windows must be in the order they came in."""
    kind = windows.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)
        state, out = None, []
        done = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            for conv, n, text, repeated, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "text", "n_repeated", "loss_from", "loss_to")), strict=True):
                if state is None or n == 0:
                    if state is not None:
                        out.append(done(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(starts, stops, strict=True):
                    target = unescape(text[a:b])
                    state[3] += len(target)
                    state[4].update(target.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield pack(out)
            out = []
        if state is not None:
            yield pack([done(state)])

    return windows.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
