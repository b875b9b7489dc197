"""Chat formatting: a finite-state machine over roles, a declarative template, and loss-flagged segments.

Everything is DataFrame functions: one grouping by conversation, then higher-order functions on its ordered turns.  The
machine reads a conversation's roles one after another; each step gives the next state and the turn's loss flag.

Control strings inside texts are told from marks by backslashes: between the first two characters of a mark a text gets
one more backslash than it has, so no mark is left and nothing is lost.  A template whose marks do not allow this is an
error.

Cases: a null role or text counts as the empty string; rows of a conversation are ordered by (turn, role, text), nulls
first, so repeated turns keep every row and have one defined order; rows with a null conversation id form one
conversation; a pair of state and role without a transition leads to ``error`` for good, its turn is formatted all the
same and bears loss as its role does elsewhere; an unknown role never bears loss; an empty table gives an empty result;
columns but the four named are ignored.  One conversation is one string, so its rows meet in one task; different
conversations share nothing, however common their first turns are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, the roles that bear loss, and the machine that checks the order of roles.

    ``transitions`` maps (state, role) to the next state; any other pair leads to ``error`` for good.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_end: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "start"
    final: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def __post_init__(self):
        behind = self.end + self.after_end
        if min(len(self.start), len(self.end)) < 2 or any(c in "\\\n%" for m in (self.start, self.end) for c in m[:2]):
            raise ValueError("marks need two characters or more, the first two no backslash, line feed or percent sign")
        overlap = (self.start[k:] for k in range(1, len(self.start)))
        if self.start in behind or any(behind.startswith(rest) or rest.startswith(behind) for rest in overlap):
            raise ValueError("a text's last characters and the end mark could be read as a start mark")

    def leads(self) -> list[str]:
        """The first two characters of each mark."""
        return sorted({m[:2] for m in (self.start, self.end)})

    def machine(self) -> dict[str, tuple[str, bool]]:
        """Next state and loss flag by state and role, for all states and all roles known."""
        states = {self.initial, "error", *self.transitions.values(), *(s for s, _ in self.transitions)}
        roles = {*self.loss_roles, *(r for _, r in self.transitions)}
        return {f"{s}\n{r}": (self.transitions.get((s, r), "error"), r in self.loss_roles) for s in sorted(states) for r in sorted(roles)}


CHATML = ChatTemplate()


def escape(text: Column, template: ChatTemplate = CHATML) -> Column:
    r"""One more backslash between the first two characters of marks: ``<|`` becomes ``<\|`` and ``<\|`` becomes ``<\\|``."""
    for a, b in template.leads():
        text = F.regexp_replace(text, rf"(?<={_quoted(a)})(\\*)(?={_quoted(b)})", r"\\$1")
    return text


def unescape(text: Column, template: ChatTemplate = CHATML) -> Column:
    for a, b in reversed(template.leads()):
        text = F.regexp_replace(text, rf"(?<={_quoted(a)})\\(\\*)(?={_quoted(b)})", "$1")
    return text


def _role_codes(template: ChatTemplate) -> list[tuple[str, str]]:
    first = sorted({template.start[0], template.end[0], "\n"})
    return [("%", "%25"), *((c, "".join(f"%{x:02X}" for x in c.encode())) for c in first)]


def escape_role(role: Column, template: ChatTemplate = CHATML) -> Column:
    """Roles stand on a line of their own: percent signs, line feeds and the first characters of marks are percent-encoded."""
    for char, code in _role_codes(template):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column, template: ChatTemplate = CHATML) -> Column:
    for char, code in reversed(_role_codes(template)):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def _steps(turns: Column, template: ChatTemplate) -> Column:
    """Struct of the machine's last state and the loss flag of each turn."""
    step = F.create_map(*[x for key, (to, loss) in template.machine().items() for x in (F.lit(key), F.struct(F.lit(to).alias("state"), F.lit(loss).alias("loss")))])
    begin = F.struct(F.lit(template.initial).alias("state"), F.array().cast("array<boolean>").alias("loss"))

    def one(now: Column, turn: Column) -> Column:
        to = F.try_element_at(step, F.concat(now["state"], F.lit("\n"), turn["role"]))
        return F.struct(F.coalesce(to["state"], F.lit("error")).alias("state"), F.concat(now["loss"], F.array(F.coalesce(to["loss"], F.lit(False)))).alias("loss"))

    return F.aggregate(turns, begin, one)


def format_chat(df: DataFrame, template: ChatTemplate = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, formatted, segments (text, loss), final_state, valid.

    The segments concatenate to ``formatted``; exactly the (escaped) texts of ``template.loss_roles`` have loss true.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = df.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    turns = turns.withColumn("_steps", _steps(F.col("_turns"), template))
    segments = F.flatten(
        F.zip_with(
            "_turns",
            "_steps.loss",
            lambda t, loss: F.array(
                piece(F.concat(F.lit(template.start), escape_role(t["role"], template), F.lit("\n")), F.lit(False)),
                piece(escape(t["text"], template), loss),
                piece(F.lit(template.end + template.after_end), F.lit(False)),
            ),
        )
    )
    out = turns.select(F.col(conv), segments.alias("segments"), F.col("_steps.state").alias("final_state"))
    return out.select(
        conv,
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        "final_state",
        F.col("final_state").isin(list(template.final)).alias("valid"),
    )


def read_turns(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """Array of (role, text) parsed back from a formatted conversation."""
    parts = F.split(formatted, _quoted(template.start))
    blocks = F.slice(parts, F.lit(2), F.size(parts) - 1)
    tail = len(template.end + template.after_end)

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        skip = F.char_length(role) + F.lit(1)
        return F.struct(unescape_role(role, template).alias("role"), unescape(F.substr(block, skip + 1, F.char_length(block) - skip - F.lit(tail)), template).alias("text"))

    return F.transform(blocks, turn)


def read_loss_text(segments: Column, template: ChatTemplate = CHATML) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
