"""Chat formatting with a template as a black box: spans from successive turn prefixes.

Prefixes of a conversation are rendered one after the other; what a rendering adds to the
one before is the turn's span, and where a rendering changes earlier output, the
template rewrites history, which the row says (``rewound`` characters are taken back before
the piece is added). A mark in place of a turn's text shows where in the span the text
stands. Whole prefixes are rendered, since a black box may look back as far as it likes: a
conversation's cost then grows with the square of its turns. A template declared
``stateless`` (the built-in one is) is rendered in whole prefixes for the first ``WHOLE`` turns; later turns
are rendered by themselves and their pieces held against the whole rendering whenever the conversation has
doubled and at its end, so a false declaration is refused at any length: rows are those of whole prefixes or there
are none, and long conversations cost little more a turn than short ones. With a ``horizon`` every turn is also rendered from the last
turns alone, and a template that looks further back is refused at the turn that shows it.

Turns are dealt by conversation and sorted; a conversation passes through one task as a
stream of turns (its digest is sequential) and is held there for its whole renderings.

Defined cases: null texts and roles are empty; conversations without an id are one. Turns with
equal numbers are ordered by role, then text; repeated rows are turns of their own. An
empty table gives an empty result. Texts and roles may hold any characters, control strings
of the template included: they are escaped and come back as they were.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MARK = "text"
WHOLE = 64               # turns of a conversation that are always rendered as whole prefixes
START, STOP = "<|im_start|>", "<|im_end|>\n"

Turn = tuple[str, str]


def escape(text: str) -> str:
    """Reversible: no control string, and no line feed in a role, is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def stateless(render: Callable) -> Callable:
    """Declares that what a turn adds to a template's output depends on no other turn."""
    render.stateless = True
    return render


@stateless
def chatml(turns: list[Turn]) -> str:
    """The built-in template: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{STOP}" for role, text in turns)


class Incremental:
    """Successive renderings of one conversation."""

    def __init__(self, render: Callable[[list[Turn]], str], horizon: int | None = None):
        self.render, self.horizon, self.before, self.turns, self.end = render, horizon, [], 0, 0
        self.declared, self.later = getattr(render, "stateless", False), []
        self.empty = self.old = render([])

    def add(self, role: str, text: str) -> dict:
        """The span of the next turn: characters taken back, the piece added, and where the text stands in it (null: nowhere)."""
        alone = self.declared and self.turns >= WHOLE
        before, old = ([], self.empty) if alone else (self.before, self.old)
        new = self.render([*before, (role, text)])
        rewound, piece = self._step(old, new)
        if self.horizon is not None and not self.declared and len(self.before) > self.horizon:
            recent = self.before[len(self.before) - self.horizon:]
            if self._step(self.render(recent), self.render([*recent, (role, text)])) != (rewound, piece):
                raise ValueError("the template's output for a turn depends on turns before its horizon")
        _, marked = self._step(old, self.render([*before, (role, MARK)]))
        head, found, tail = marked.partition(MARK)
        inside = bool(found) and not rewound and piece.startswith(head) and piece.endswith(tail) and len(piece) >= len(head) + len(tail)
        start = self.end - rewound
        self.end = start + len(piece)
        self.turns += 1
        if not alone:
            self.before.append((role, text))
            self.old = new
        else:
            self._check((role, text), rewound, piece)
        return {"turn_no": self.turns - 1, "rewound": rewound, "piece": piece, "start": start, "end": self.end,
                "text_start": start + len(head) if inside else None, "text_end": self.end - len(tail) if inside else None}

    def _check(self, turn: Turn, rewound: int, piece: str) -> None:
        """Hold the pieces of turns rendered alone against the whole rendering, each time the conversation has doubled."""
        self.before.append(turn)
        self.later.append(piece)
        if rewound or self.turns & (self.turns - 1) == 0:
            self._hold(rewound)

    def _hold(self, rewound: int = 0) -> None:
        whole = self.render(self.before)
        if rewound or whole != self.old + "".join(self.later):
            raise ValueError("the template was declared stateless, but a turn's output depends on other turns")
        self.old, self.later = whole, []

    def close(self) -> None:
        """The conversation is over: what has come since the last doubling is held against the whole rendering."""
        if self.later:
            self._hold()

    @staticmethod
    def _step(old: str, new: str) -> tuple[int, str]:
        if new.startswith(old):
            return 0, new[len(old):]
        same = len(os.path.commonprefix([old, new]))
        return len(old) - same, new[same:]


def _stream(df: DataFrame, key: str, out: T.StructType, begin: Callable, row: Callable, finish: Callable | None = None) -> DataFrame:
    """Rows that stand together by ``key`` through a state for each key: ``row(state, values)`` and ``finish(state, key)`` give output rows or nothing."""
    arrow = to_arrow_schema(out)

    def run(batches):
        state, current, rows, held = None, object(), [], 0
        for batch in batches:
            for values in batch.to_pylist():
                if state is None or values[key] != current:
                    if state is not None and finish and (last := finish(state, current)) is not None:
                        rows.append(last)
                    state, current = begin(), values[key]
                if (made := row(state, values)) is not None:
                    rows.append(made)
                    held += len(made.get("piece") or "")
                if len(rows) >= 4096 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
        if state is not None and finish and (last := finish(state, current)) is not None:
            rows.append(last)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, out)


def format_turns(conversations: DataFrame, render: Callable[[list[Turn]], str] = chatml, learn: tuple[str, ...] = ("assistant",), horizon: int | None = None) -> DataFrame:
    """One row per turn, conversations together and turns in order: conv_id, turn_no, role, rewound, piece, start, end, text_start, text_end, loss.

    The formatted conversation is the pieces in order, each after taking ``rewound`` characters back; offsets count in it."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", text("role"), text("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = T.StructType([T.StructField("conv_id", conversations.schema["conv_id"].dataType), T.StructField("turn_no", T.LongType()), T.StructField("role", T.StringType()),
                        T.StructField("rewound", T.LongType()), T.StructField("piece", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("start", "end", "text_start", "text_end")),
                        T.StructField("loss", T.BooleanType())])

    def row(state: Incremental, v: dict) -> dict:
        made = state.add(v["role"], v["text"])
        return made | {"conv_id": v["conv_id"], "role": v["role"], "loss": v["role"] in learn and made["text_start"] is not None}

    return _stream(rows, "conv_id", out, lambda: Incremental(render, horizon), row, lambda state, _: state.close())


class ReadBack:
    """Turns of the built-in template parsed from its output as it comes, and the text under the loss mask."""

    def __init__(self):
        self.rest, self.n, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, v: dict) -> None:
        if v["rewound"]:
            raise ValueError("this template takes nothing back")
        self.chars += len(v["piece"])
        if v["loss"]:
            text = unescape(v["piece"][v["text_start"] - v["start"]:v["text_end"] - v["start"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.rest += v["piece"]
        while (stop := self.rest.find(STOP)) >= 0:
            role, _, text = self.rest[len(START):stop].partition("\n")
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
            self.n, self.rest = self.n + 1, self.rest[stop + len(STOP):]


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the output of ``format_turns`` with the built-in template."""
    out = T.StructType([T.StructField("conv_id", formatted.schema["conv_id"].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    done = lambda s, key: {"conv_id": key, "n_turns": s.n, "turns_sha256": s.turns.hexdigest(), "loss_chars": s.loss_chars, "loss_sha256": s.loss.hexdigest(), "formatted_chars": s.chars}
    return _stream(formatted, "conv_id", out, ReadBack, lambda s, v: s.take(v), done)
