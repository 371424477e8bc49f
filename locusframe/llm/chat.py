"""Chat formatting in DataFrame operations only: a state machine over roles and a declarative template.

Each turn becomes mark, space, text, space, mark. Control strings inside a text get a backslash in
front, which reading removes again, so a text can never close its own turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks and loss flags by role, marks for any other role, and the allowed moves of the state machine."""

    roles: dict[str, Turn] = field(
        default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)}
    )
    other: Turn = Turn("<<TURN>>", "<</TURN>>")
    role_end: str = "<<TEXT>>"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [x for t in (*self.roles.values(), self.other) for x in (t.open, t.close)] + [self.role_end]

    def pattern(self, which: list[str] | None = None) -> str:
        return "|".join(re.escape(x).replace("<", "\\<").replace(">", "\\>").replace("\\<", "<").replace("\\>", ">") for x in which or self.controls())


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"({template.pattern()})", r"\\$1")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"\\({template.pattern()})", "$1")


def _by_role(role: Column, template: Template, pick, other: Column) -> Column:
    out = other
    for name, turn in template.roles.items():
        out = F.when(role == name, pick(turn)).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, valid, segments (text, loss), formatted.

    Rows are put in order of turn, then role and text where turns tie; null turns come first, null
    roles and texts count as empty, and all rows with a null conv_id are one conversation. Order is
    judged, not repaired: valid tells whether the state machine accepts the roles. A conversation
    is one text in the end, so its rows meet in one row of the result, however many there are.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, to in template.moves.items() for b in to])
    state = F.aggregate(
        "turns", F.lit("start"), lambda s, t: F.when(F.array_contains(allowed, F.concat(s, F.lit(">"), t["role"])), t["role"]).otherwise(F.lit("invalid"))
    )

    def segments(t: Column) -> Column:
        role = t["role"]
        opening = _by_role(role, template, lambda k: F.lit(f"{k.open} "), F.concat(F.lit(f"{template.other.open} "), escape(role, template), F.lit(f" {template.role_end} ")))
        closing = _by_role(role, template, lambda k: F.lit(f" {k.close}\n"), F.lit(f" {template.other.close}\n"))
        loss = _by_role(role, template, lambda k: F.lit(k.loss), F.lit(False))
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(opening, F.lit(False)), piece(escape(t["text"], template), loss), piece(closing, F.lit(False)))

    return (
        chats.withColumn("segments", F.flatten(F.transform("turns", segments)))
        .withColumn("valid", state.isin(*template.ends))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def read_chats(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text, loss>> parsed from a formatted conversation, texts unescaped."""
    opens = template.pattern([t.open for t in (*template.roles.values(), template.other)])
    closes = template.pattern([t.close for t in (*template.roles.values(), template.other)])
    pattern = F.lit(rf"(?s)({opens}) (.*?) (?:{closes})\n")
    marks, bodies = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))

    def turn(mark: Column, body: Column) -> Column:
        role, text, loss = F.substring_index(body, f" {template.role_end} ", 1), F.regexp_replace(body, rf"(?s)\A.*? {template.pattern([template.role_end])} ", ""), F.lit(False)
        known = [(name, t) for name, t in template.roles.items()]
        for name, t in known:
            role, text, loss = F.when(mark == t.open, F.lit(name)).otherwise(role), F.when(mark == t.open, body).otherwise(text), F.when(mark == t.open, F.lit(t.loss)).otherwise(loss)
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"), loss.alias("loss"))

    return F.zip_with(marks, bodies, turn)


def digest_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests of what a formatted conversation gives back when it is read."""
    turns = chats.withColumn("back", read_chats(F.col("formatted"), template))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_replace(text, '(<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|<<TURN>>|<</TURN>>|<<TEXT>>)', '\\\\\\1', 'g') AS safe,
    CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
    ELSE 28 + length(regexp_replace(role, '(<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|<<TURN>>|<</TURN>>|<<TEXT>>)', '\\\\\\1', 'g')) END AS marks
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + marks) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
