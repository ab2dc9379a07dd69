"""Chat formatting with DataFrame functions only.

A declarative template gives each role its opening and closing mark and says whether its text carries loss. A
finite-state machine over the roles checks the order of the turns. Texts are escaped reversibly, so that no text can
forge a mark: each control character becomes a backslash and a letter, and the marks are made of control characters.

Defined results: a null text counts as empty; a null or unknown role gets the template's generic mark and makes the
conversation invalid; turns with equal numbers (repeated rows too) are ordered by role, then text, null first; a null
conversation id is a conversation of its own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control character -> the letter that stands for it after a backslash. The backslash must come first.
ESCAPES = {"\\": "b", "<": "l", "#": "h"}


@dataclass(frozen=True)
class Role:
    """How one role's turns are written. ``loss``: the model is trained on the text."""

    label: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles and the allowed order. ``order`` maps a state to the roles that may follow and the state each leads to."""

    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("System"), "user": Role("User"), "assistant": Role("Assistant", True)})
    open: str = "### "
    after_label: str = ": "
    generic: str = "@"
    close: str = "</turn>\n"
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"system": "system", "user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant", "user")


def escape(text: Column) -> Column:
    for char, letter in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column) -> Column:
    for char, letter in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def _label(role: Column, template: Template) -> Column:
    known = _lookup({k: v.label for k, v in template.roles.items()}, role)
    # a colon would end the label early; it is spelled with the control letter c
    generic = F.concat(F.lit(template.generic), F.replace(escape(F.coalesce(role, F.lit(""))), F.lit(":"), F.lit("\\c")))
    return F.coalesce(known, generic)


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted, valid, bad_turn (index, -1 if valid).

    Segments concatenate to the formatted text; loss is true on assistant texts only, never on a mark.
    """
    template = template or Template()
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    grouped = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    carries = [k for k, v in template.roles.items() if v.loss]

    def segments(turn: Column) -> Column:
        opening = F.concat(F.lit(template.open), _label(turn["role"], template), F.lit(template.after_label))
        loss = F.coalesce(turn["role"].isin(carries), F.lit(False))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    moves = {f"{state}>{role}": to for state, out in template.order.items() for role, to in out.items()}

    def step(acc: Column, turn: Column) -> Column:
        to = _lookup(moves, F.concat(acc["state"], F.lit(">"), F.coalesce(turn["role"], F.lit(""))))
        ok = acc["state"] != "error"
        return F.struct(
            F.when(ok, F.coalesce(to, F.lit("error"))).otherwise("error").alias("state"),
            F.when(ok & to.isNull(), acc["seen"]).otherwise(acc["bad"]).alias("bad"),
            (acc["seen"] + 1).alias("seen"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("seen"))
    machine = F.aggregate("turns", start, step)
    out = grouped.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), machine.alias("machine"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("machine.state").isin(list(template.final)).alias("valid"),
        F.col("machine.bad").alias("bad_turn"),
    )


def parse_formatted(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) read back from a formatted conversation, unescaped."""
    template = template or Template()
    back = {v.label: k for k, v in template.roles.items()}
    pieces = F.filter(F.split(formatted, template.close.replace("\n", "\\n")), lambda p: p != "")

    def turn(piece: Column) -> Column:
        label = F.substring_index(F.substr(piece, F.lit(len(template.open) + 1)), template.after_label, 1)
        text = F.substr(piece, F.lit(len(template.open) + len(template.after_label) + 1) + F.length(label))
        other = unescape(F.replace(F.substr(label, F.lit(len(template.generic) + 1)), F.lit("\\c"), F.lit(":")))
        return F.struct(F.coalesce(_lookup(back, label), other).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def chat_digest(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of the formatted conversations, each read back from the output."""
    formatted = format_conversations(rows, template)
    under_loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = formatted.select(
        "conv_id",
        parse_formatted(F.col("formatted"), template).alias("turns"),
        F.array_join(under_loss, "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
