"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, and adjacent turns of one role are merged into one
block; blocks are joined to one string with markers. A text's control characters are escaped,
so a text that looks like a marker stays text and every turn can be read back.

    ### Assistant:\n<text></turn>\n         one block
    ### User:\n<text><next><text></turn>\n  two turns of one role, merged

Null roles and texts count as empty; rows that tie in their turn are ordered by role and text.
A null conversation id is a conversation like any other. The loss mask lists, for each turn of
the trained roles, where its escaped text begins and how long it is, in characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template.
OPEN, ROLE_END, NEXT, CLOSE = "### ", ":\n", "<next>", "</turn>\n"
#: What stands for a control character inside a text; the backslash first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
#: Lengths are summed in runs of so many turns, so that sums over a long conversation stay linear.
RUN = 128


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _sums_before(values: Column) -> Column:
    """For each value of an array of longs, the sum of those before it."""
    zero = F.lit(0).cast("long")

    def running(items: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out"))
        return F.aggregate(items, first, step, lambda acc: acc["out"])

    runs = F.transform(F.sequence(F.lit(0), F.size(values), F.lit(RUN)), lambda i: F.slice(values, i + 1, RUN))
    starts = running(F.transform(runs, lambda r: F.aggregate(r, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.transform(runs, lambda r, i: running(r, F.get(starts, i))))


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask array<struct<start, length>> (0-based)."""
    fields = [F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")]
    own = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), *fields)
    rows = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # a turn opens a block unless the one before has its role; it closes the block of the one before
    def before(x: Column, i: Column) -> Column:
        opening = F.concat(F.lit(OPEN), escape(x["role"]), F.lit(ROLE_END))
        same = F.get("turns", i - 1)["role"] == x["role"]
        return F.when(i == 0, opening).when(same, F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), opening))

    pieces = F.transform("turns", lambda x, i: F.struct(before(x, i).alias("before"), escape(x["text"]).alias("text"), x["role"].isin(*train_on).alias("train")))
    rows = rows.select("conv_id", pieces.alias("pieces"))
    lengths = F.transform("pieces", lambda x: (F.length(x["before"]) + F.length(x["text"])).cast("long"))
    rows = rows.select("conv_id", "pieces", _sums_before(lengths).alias("at"))
    spans = F.zip_with("pieces", "at", lambda x, at: F.struct(x["train"].alias("train"), (at + F.length(x["before"])).alias("start"), F.length(x["text"]).cast("long").alias("length")))
    mask = F.transform(F.filter(spans, lambda x: x["train"]), lambda x: F.struct(x["start"], x["length"]))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda x: F.concat(x["before"], x["text"])), ""), F.lit(CLOSE))
    return rows.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.split(F.substring(formatted, F.lit(1), F.length(formatted) - len(CLOSE)), CLOSE, -1)

    def turns(block: Column) -> Column:
        end = F.locate(ROLE_END, block)
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), end - len(OPEN) - 1))
        texts = F.split(F.substring(block, end + len(ROLE_END), F.length(block)), NEXT, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    A substring is found by walking from its string's start, so spans are not cut from the whole
    string one by one: runs of RUN * RUN spans are cut from it, runs of RUN from those, and
    spans from these. Up to RUN**3 spans, the walks are 3 * RUN times the string together.
    """

    def cut(text: Column, base: Column, spans: Column, depth: int) -> Column:
        place = lambda x, length: F.substring(text, (x - base + 1).cast("int"), length.cast("int"))
        if not depth:
            return F.array_join(F.transform(spans, lambda m: unescape(place(m["start"], m["length"]))), "")
        wide = RUN**depth
        runs = F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(wide)), lambda i: F.slice(spans, i + 1, wide)))

        def part(run: Column) -> Column:
            first, last = F.get(run, F.lit(0)), F.get(run, F.size(run) - 1)
            piece = place(first["start"], last["start"] + last["length"] - first["start"])
            # bound to a lambda's variable, the piece is cut once
            return F.get(F.transform(F.array(piece), lambda p: cut(p, first["start"], run, depth - 1)), F.lit(0))

        return F.coalesce(F.array_join(F.transform(runs, part), ""), F.lit(""))

    return cut(formatted, F.lit(0), mask, 2)
