"""Chat formatting: the turns of a conversation as one training text with a loss mask, and back, in Spark
expressions only.

A block is `<s>[INST]role[/INST]text</s>`; adjacent turns of one role share a block, with `[TURN]` between their
texts. The loss mask is a list of spans of the formatted text: the texts of assistant turns, without marks.

Texts may hold anything, marks included. A backslash is doubled, and one is put after the first character of a
mark within a text, so that an escaped text holds no mark; the formatted text can thus be cut at its marks, and
unescaping restores each text exactly.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role whose texts are learned.
LEARNED = "assistant"
#: Elements that are summed one by one before sums of such runs are; keeps running sums of long lists cheap.
RUN = 256


class Template(NamedTuple):
    """The marks. Each has two characters or more, and the first characters occur at no other place in a mark."""

    begin: str = "<s>"
    role: str = "[INST]"
    role_end: str = "[/INST]"
    between: str = "[TURN]"
    end: str = "</s>"

    def checked(self) -> Template:
        firsts = {m[:1] for m in self}
        if any(len(m) < 2 or "\\" in m or firsts & set(m[1:]) for m in self) or len(set(self)) < len(self):
            raise ValueError(f"these marks can't be told apart from escaped texts: {tuple(self)}")
        return self


def escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def running_sums(numbers: Column) -> Column:
    """What comes before each number of a list: the sum of those ahead of it."""

    def ahead(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")), lambda a: a["out"])

    cuts = F.when(F.size(numbers) > 0, F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(cuts, lambda k: F.slice(numbers, k * RUN + 1, F.lit(RUN)))
    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(runs, ahead(totals), lambda run, base: F.transform(ahead(run), lambda x: x + base)))


def blocks_of(turns: Column) -> Column:
    """Sorted turns (`role, text`) as blocks (`role, texts`): adjacent turns of a role become one."""
    indices = F.sequence(F.lit(1), F.size(turns))
    starts = F.filter(indices, lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(turns) + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.element_at(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a, b - a), lambda t: t["text"]).alias("texts")))


def formatted(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id, formatted, loss` (spans `start` from 0 and `length`, in code points) for each conversation.

    Turns come in the order of `turn`, nulls first, ties by role and text; repeated rows are turns each. A null
    text or role counts as empty. A row without conversation belongs to none: it is formatted by itself, under a
    null id. No rows give no conversations; other columns are not read. A conversation is one row of the result,
    and so bounded by what a row may hold (2 GB); no task holds more than one conversation besides what it sorts.
    """
    template = template.checked()
    lone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_col).alias("__conv"), lone.alias("__lone"), turn.alias("__turn"))
    collected = rows.groupBy("__conv", "__lone").agg(F.sort_array(F.collect_list("__turn")).alias("turns"))
    safe = collected.select("__conv", F.transform("turns", lambda t: F.struct(escaped(t["role"], template).alias("role"), escaped(t["text"], template).alias("text"))).alias("turns"))
    blocks = safe.select("__conv", blocks_of(F.col("turns")).alias("blocks"))

    def piece(text: Column, learned: Column) -> Column:
        return F.struct(text.alias("text"), learned.alias("learned"))

    def pieces_of(block: Column) -> Column:
        learned = block["role"] == LEARNED
        head = F.array(piece(F.concat(F.lit(template.begin + template.role), block["role"], F.lit(template.role_end)), F.lit(False)))
        texts = F.transform(block["texts"], lambda t, i: F.array(piece(F.when(i > 0, F.lit(template.between)).otherwise(F.lit("")), F.lit(False)), piece(t, learned)))
        return F.concat(head, F.flatten(texts), F.array(piece(F.lit(template.end), F.lit(False))))

    pieces = blocks.select("__conv", F.flatten(F.transform("blocks", pieces_of)).alias("pieces"))
    starts = running_sums(F.transform("pieces", lambda p: F.length(p["text"]).cast("long")))
    spans = F.zip_with("pieces", starts, lambda p, at: F.struct(at.alias("start"), F.length(p["text"]).cast("long").alias("length"), p["learned"].alias("learned")))
    loss = F.transform(F.filter(spans, lambda s: s["learned"] & (s["length"] > 0)), lambda s: F.struct(s["start"], s["length"]))
    return pieces.select(F.col("__conv").alias(conv_col), F.concat_ws("", F.transform("pieces", lambda p: p["text"])).alias("formatted"), loss.alias("loss"))


def read_back(text: Column, template: Template = Template()) -> Column:
    """The blocks (`role, texts`) of a formatted text, unescaped."""

    def cut(value: Column, mark: str, limit: int = -1) -> Column:
        return F.split(value, "".join(f"\\x{ord(c):02x}" if ord(c) < 256 else c for c in mark), limit)

    blocks = F.filter(cut(text, template.end), lambda b: b != "")
    opened = len(template.begin + template.role)
    parts = F.transform(blocks, lambda b: cut(F.substring(b, F.lit(opened + 1), F.length(b)), template.role_end, 2))
    return F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), F.transform(cut(p[1], template.between), unescaped).alias("texts")))


def under_mask(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(loss, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int")))))


def digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Formats conversations and tells what the result holds: `conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_blocks`, all read back from the formatted text and its mask. Turns are the rows again, as a
    block keeps them apart."""
    done = formatted(conversations, template)
    read = done.select("conv_id", read_back(F.col("formatted"), template).alias("blocks"), under_mask(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n")))))
    read = read.select("conv_id", turns.alias("turns"), F.size("blocks").cast("long").alias("n_blocks"), "learned", "formatted_chars")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", "turns"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )
