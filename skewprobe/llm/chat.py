"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, adjacent turns of
one role are merged by array aggregation, and the blocks are concatenated. Arrays are cut and
joined, never grown or sliced turn by turn, so the work is about linear in the turns.

The format of a block is ``<|role|>text<|end|>``, with ``<|next|>`` between the
texts of merged turns. Control strings inside roles and texts are escaped
reversibly, so a text can neither end its own block nor open another one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
NEXT, END = "<|next|>", "<|end|>"
# A fixed list: strings that this template or other well-known ones give a meaning.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARK = "~"
CODES = "abcdefghijklmnopqrstuvwxyz"
# Elements that running sums and cuts of a long text take together.
RUN = 256


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """``text`` without control strings: ``~`` becomes ``~0``, the k-th one ``~`` and a letter."""
    steps = [(MARK, MARK + "0"), *((c, MARK + CODES[k]) for k, c in enumerate(control))]
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), steps, text)


def unescape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    # Every mark in an escaped text starts a code, so one code cannot arise from another.
    steps = [*((MARK + CODES[k], c) for k, c in enumerate(control)), (MARK + "0", MARK)]
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), steps, text)


def format_chats(
    turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are
    not read. ``loss`` lists the spans of ``formatted`` (start from 0 and
    length, in code points) that a model is to learn: each text of the roles
    ``learn_from``, without marks. ``control`` must contain ``<|`` and ``|>``.

    Turns are put in the order of ``turn``, ties in the order of role and text,
    nulls first; a repeated row is a turn of its own. A null or empty text is an
    empty text, a null role an empty role. A null ``conv_id`` is one conversation. An empty table
    gives an empty one. The turns of one conversation, which make one output
    value, are held together in one task.
    """
    if not {OPEN, CLOSE} <= set(control):
        raise ValueError("the marks of the template must be among the control strings")
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    # Escaped first: what is merged afterwards holds marks.
    safe = F.transform(
        "turns",
        lambda t: F.struct(
            escape(t["role"], control).alias("role"),
            t["role"].isin(*learn_from).alias("learn"),
            escape(t["text"], control).alias("text"),
        ),
    )
    grouped = grouped.select("conv_id", safe.alias("turns"))
    # A turn opens a block where the role changes, and ends the one before; else it goes on with it.
    # Text pieces alternate with marks.
    turn = F.col("turns")
    pieces = F.flatten(F.transform(turn, lambda t, i: _pieces(t, F.get(turn, i - 1), i)))
    end = F.array(_piece(F.lit(END), F.lit(False)))
    blocks = grouped.select("conv_id", F.concat(pieces, end).alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.length(p["text"]))
    blocks = blocks.withColumn("starts", running_sums(lengths))
    spans = F.zip_with(
        "pieces",
        "starts",
        lambda p, at: F.when(p["learn"], F.struct(at.alias("start"), F.length(p["text"]).alias("length"))),
    )
    return blocks.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
    )


def _runs(items: Column) -> Column:
    """The array in runs of :data:`RUN`; the last may be shorter."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(items) / RUN).cast("int") - 1)
    cut = F.transform(runs, lambda i: F.slice(items, i * RUN + 1, RUN))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(cut, 1, 0))


def _sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it; for short arrays."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("sums"))
    return F.aggregate(
        numbers,
        start,
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["sums"], s["at"]).alias("sums")),
        lambda s: s["sums"],
    )


def running_sums(numbers: Column) -> Column:
    """For each number the sum of those before it: within runs, then over the sums of the runs."""
    runs = _runs(numbers)
    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x))
    inner = F.transform(runs, _sums_before)
    return F.flatten(F.zip_with(inner, _sums_before(totals), lambda sums, at: F.transform(sums, lambda x: x + at)))


def _piece(text: Column, learn: Column) -> Column:
    return F.struct(text.alias("text"), learn.alias("learn"))


def _pieces(turn: Column, last: Column, i: Column) -> Column:
    """The mark before a turn, and its text."""
    head = F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))
    mark = F.when(i == 0, head).when(turn["role"] == last["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), head))
    return F.array(_piece(mark, F.lit(False)), _piece(turn["text"], turn["learn"]))


def read_chats(formatted: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """The turns of a formatted conversation: array of ``role`` and ``text``, as they were."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, F.lit(len(OPEN) + 1), F.length(block)), CLOSE, 1)
        body = F.substring(block, F.length(role) + len(OPEN + CLOSE) + 1, F.length(block))
        return F.transform(
            F.split(body, r"<\|next\|>"),
            lambda t: F.struct(unescape(role, control).alias("role"), unescape(t, control).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """All text under the loss mask, unescaped, nothing between."""

    # A long text is cut once for each run of spans, since a cut counts characters from the start.
    def region(run: Column) -> Column:
        first, last = F.get(run, F.lit(0)), F.element_at(run, -1)
        text = F.substring(formatted, first["start"] + 1, last["start"] + last["length"] - first["start"])
        return F.struct(run.alias("run"), first["start"].alias("from"), text.alias("text"))

    def texts(part: Column) -> Column:
        cut = F.transform(
            part["run"],
            lambda s: unescape(F.substring(part["text"], s["start"] - part["from"] + 1, s["length"]), control),
        )
        return F.array_join(cut, "")

    return F.array_join(F.transform(F.transform(_runs(loss), region), texts), "")
