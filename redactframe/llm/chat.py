"""Chat formatting: a finite-state machine over roles, and a template that says which text carries loss.

Everything here is column expressions. A template names, per role, the text before and after a turn and whether the
turn's own text carries loss. Control strings of the template that occur inside a text are escaped, so a formatted
conversation reads back to exactly the turns that went in.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODES = "123456789abcdefghijklmnopqrstuvwxyz"
START = "start"


@dataclass(frozen=True)
class Mark:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, control strings, and which role may follow in which state.

    ``other`` is for roles without a mark of their own: its ``open`` stands before the role's name and
    ``other_text`` between name and text. ``turns`` maps (state, role) to the next state; a conversation is
    valid if every turn has a next state and the last one is in ``ends``.
    """

    roles: dict[str, Mark]
    controls: tuple[str, ...]
    other: Mark
    other_text: str
    turns: dict[tuple[str, str], str]
    ends: tuple[str, ...]
    escape: str = "\x10"
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "states", tuple(dict.fromkeys([START, *(s for s, _ in self.turns), *self.turns.values()])))
        marks = [x for m in (*self.roles.values(), self.other) for x in (m.open, m.close)] + [self.other_text]
        if len(self.controls) > len(_CODES) or any(self.escape in c for c in (*self.controls, *marks)):
            raise ValueError("too many control strings, or one holds the escape character")
        for mark in marks:
            # no text next to a mark may complete or extend a control string
            if not any(c in mark for c in self.controls):
                raise ValueError(f"mark {mark!r} holds no control string")
            if any(mark[0] in c[1:] or any(mark.endswith(c[:k]) for k in range(1, len(c))) for c in self.controls):
                raise ValueError(f"mark {mark!r} can run together with a text")
        if any(a[0] in b[1:] for a in self.controls for b in self.controls):
            raise ValueError("control strings overlap")

    def escaped(self, text: Column) -> Column:
        """The escape character becomes itself and 0, the k-th control string the escape character and code k."""
        pairs = [(self.escape, self.escape + "0")] + [(c, self.escape + k) for c, k in zip(self.controls, _CODES, strict=False)]
        return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)

    def unescaped(self, text: Column) -> Column:
        pairs = [(self.escape + k, c) for c, k in zip(self.controls, _CODES, strict=False)] + [(self.escape + "0", self.escape)]
        return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


INSTRUCT = Template(
    roles={
        "system": Mark("<sys> ", " </sys>"),
        "user": Mark("[INST] ", " [/INST]"),
        "assistant": Mark("<s> ", " </s>", loss=True),
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<sys>", "</sys>", "<role>", "</role>", "</turn>"),
    other=Mark("<role>", "</turn>"),
    other_text="</role>",
    turns={
        (START, "system"): "system", (START, "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    },
    ends=("assistant",),
)


def _state(turns: Column, template: Template) -> Column:
    """The machine's run: last state (-1 once a turn had no next state) and how many turns passed."""
    number = {s: i for i, s in enumerate(template.states)}

    def step(now: Column, turn: Column) -> Column:
        after = F.lit(-1)
        for (state, role), goes in template.turns.items():
            after = F.when((now["state"] == number[state]) & (turn["role"] == role), number[goes]).otherwise(after)
        return F.struct(after.cast("int").alias("state"), (now["passed"] + F.when(after >= 0, 1).otherwise(0)).cast("int").alias("passed"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("int").alias("state"), F.lit(0).cast("int").alias("passed")), step)


def format_chats(rows: DataFrame, template: Template = INSTRUCT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``id``, ``valid``, ``bad_turn``, ``segments`` (array of text and loss flag).

    The formatted text is the segments' texts joined. Turns are ordered by (turn, role, text), a null turn first;
    repeated rows are repeated turns. A null text or role is empty; rows with a null key form one conversation.
    Conversations out of order are formatted like others: ``valid`` is false and ``bad_turn`` is the place (from 0) of
    the first turn that may not follow (null if only the end is missing). A conversation becomes one text, so its
    rows meet in one task; different conversations never do.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def segments(t: Column) -> Column:
        other = F.concat(F.lit(template.other.open), template.escaped(t["role"]), F.lit(template.other_text))
        before, after, loss = other, F.lit(template.other.close), F.lit(template.other.loss)
        for name, mark in template.roles.items():
            own = t["role"] == name
            before = F.when(own, mark.open).otherwise(before)
            after = F.when(own, mark.close).otherwise(after)
            loss = F.when(own, mark.loss).otherwise(loss)
        plain = F.lit(False)
        return F.array(
            F.struct(before.alias("text"), plain.alias("loss")), F.struct(template.escaped(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(after.alias("text"), plain.alias("loss")))

    run = chats.withColumn("run", _state(F.col("turns"), template))
    ends = [i for i, s in enumerate(template.states) if s in template.ends]
    stopped = F.col("run.passed") < F.size("turns")
    return run.select(
        "id", F.col("run.state").isin(ends).alias("valid"), F.when(stopped, F.col("run.passed")).alias("bad_turn"),
        F.flatten(F.transform("turns", segments)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|<>/" else c for c in s)


def read_back(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    marks = [*template.roles.values(), template.other]
    opens, closes = ("|".join(_quoted(x) for x in xs) for xs in ([m.open for m in marks], [m.close for m in marks]))
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?:{opens}).*?(?:{closes})"), F.lit(0))

    def turn(t: Column) -> Column:
        inner = lambda m: F.substring(t, F.lit(len(m.open) + 1), F.length(t) - (len(m.open) + len(m.close)))
        other = inner(template.other)
        at = F.instr(other, template.other_text)
        role = template.unescaped(F.substring(other, F.lit(1), at - 1))
        body = F.substring(other, at + len(template.other_text), F.length(other))
        for name, mark in template.roles.items():
            own = t.startswith(mark.open)
            role, body = F.when(own, name).otherwise(role), F.when(own, inner(mark)).otherwise(body)
        return F.struct(role.alias("role"), template.unescaped(body).alias("text"))

    return F.transform(found, turn)
