"""Chat formatting: a declarative template, a finite-state machine over roles, and segments with loss flags. SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks the turns. opens and closes go around a role's text; other holds the pair for a role that isn't named, with {} for the role.

    moves is the machine: (state, role) gives the next state; what isn't listed leads to "invalid", which is never left.
    """

    opens: dict[str, str] = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"})
    closes: dict[str, str] = field(default_factory=lambda: {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"})
    other: tuple[str, str] = ("<|{}|>", "<|end|>")
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)


#: Every control string begins with < or [, so a text without these two holds none. The backslash marks an escape and escapes itself first.
ESCAPES = (("\\", "\\b"), ("<", "\\g"), ("[", "\\l"), ("|", "\\p"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _lookup(pairs: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key), default)


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conv_id: formatted string, segments array<struct<text, loss>> whose texts joined give formatted, state, valid.

    turns has conv_id, turn, role, text; other columns are ignored. Rows go by turn, nulls first; equal turns go by role, then text, so
    repeated rows stay and reruns agree. A null role or text counts as empty; rows without conv_id form one conversation. A turn order that
    the machine refuses is still formatted, with valid false. A conversation is one output string, so it is gathered as such by contract.
    """
    name, open_other, close_other = F.col("t.role"), *template.other
    slot = lambda s, role: F.replace(F.lit(s), F.lit("{}"), escaped(role))
    grouped = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("turns"))
    )
    step = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)])
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(_lookup(template.opens, t.role, slot(open_other, t.role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t.text).alias("text"), t.role.isin(*template.loss).alias("loss")),
                F.struct(_lookup(template.closes, t.role, slot(close_other, t.role)).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    walked = F.aggregate("turns", F.lit("start"), lambda state, t: F.coalesce(F.element_at(step, F.concat(state, F.lit(">"), t.role)), F.lit("invalid")))
    return grouped.select("conv_id", segments.alias("segments"), walked.alias("state")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments", "state", F.col("state").isin(*template.accepting).alias("valid")
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> from a formatted string alone: its markers are found, roles and texts unescaped."""
    quoted = [*(rf"\Q{x}\E" for x in template.opens.values()), r"<\|[^<\[|]*\|>"]
    pattern = F.lit(f"({'|'.join(quoted)})([^<\\[|]*)(?:{'|'.join([*(rf'\Q{x}\E' for x in template.closes.values()), r'\Q' + template.other[1] + r'\E'])})")
    roles, texts = F.regexp_extract_all(formatted, pattern, 1), F.regexp_extract_all(formatted, pattern, 2)
    named = {v: k for k, v in template.opens.items()}
    return F.zip_with(roles, texts, lambda r, t: F.struct(_lookup(named, r, unescaped(F.regexp_replace(r, r"^<\||\|>$", ""))).alias("role"), unescaped(t).alias("text")))
