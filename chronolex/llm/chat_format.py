r"""Chat formatting: turns sorted and merged as arrays, concatenated by Spark expressions alone, and read back.

A conversation becomes ``### role</role>`` + parts + ``</turn>`` newline, by block of adjacent turns of one role; the
parts of a block are its turns' texts, with ``</part>`` between them. Inside roles and texts a backslash is doubled and
``</`` is written ``<\/`` and ``##`` ``#\#``, so that no text can hold one of the marks or a header; dropping the
backslash before any character undoes it. The loss mask is given as run lengths over the formatted text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = "### "
ROLE_END = "</role>"
PART = "</part>"
TURN_END = "</turn>\n"
LOSS_ROLES = ("assistant",)
#: Runs of a mask that are cut out of one stretch of text.
BLOCK = 256


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("</"), F.lit("<\\/")), F.lit("##"), F.lit("#\\#"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """conv_id, text and mask (array<struct<chars, loss>>: run lengths that cover ``text``) of each conversation.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Turns go by number, nulls first, and
    equal numbers by role and text; repeated rows stay. Null roles and texts count as empty. Rows of a null conv_id
    are one conversation. An empty table gives an empty result. A conversation is one value, so it must fit a task.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    last = F.size("turns") - 1

    def pieces(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"])
        closes = (i == last) | (F.get(F.col("turns"), i + 1)["role"] != t["role"])
        before = F.when(opens, F.concat(F.lit(HEAD), escape(t["role"]), F.lit(ROLE_END))).otherwise(F.lit(PART))
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")),
            F.struct(F.when(closes, F.lit(TURN_END)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
        )

    cut = sorted_turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("pieces"))
    return cut.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        F.transform("pieces", lambda p: F.struct(F.length(p["text"]).alias("chars"), p["loss"].alias("loss"))).alias("mask"),
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, evaluated once; a lambda evaluates what it captures anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def under_mask(text: Column, mask: Column) -> Column:
    """All of ``text`` under the loss runs of ``mask``, as it stands.

    The text is cut twice, into stretches of BLOCK runs and each of them into its runs, so that neither finding a place
    in a text nor appending to a list costs the square of a very long conversation.
    """
    reached = F.lit(0).alias("at"), F.array().cast("array<string>").alias("got")

    def cut(acc: Column, chars: Column, whole: Column, use: Callable[[Column], Column]) -> Column:
        part = _bound(F.substring(whole, acc["at"] + 1, chars), use)
        return F.struct((acc["at"] + chars).alias("at"), F.concat(acc["got"], F.array(part)).alias("got"))

    def stretch(runs: Column) -> Callable[[Column], Column]:
        one = lambda whole: lambda acc, r: cut(acc, r["chars"], whole, lambda part: F.when(r["loss"], part).otherwise(""))
        return lambda whole: F.aggregate(runs, F.struct(*reached), one(whole), lambda acc: F.array_join(acc["got"], ""))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / BLOCK).cast("int")), lambda b: F.slice(mask, b * BLOCK + 1, F.lit(BLOCK)))
    chars = lambda runs: F.aggregate(runs, F.lit(0), lambda n, r: n + r["chars"])
    step = lambda acc, runs: _bound(chars(runs), lambda n: cut(acc, n, text, stretch(runs)))
    return F.when(F.size(mask) > 0, F.aggregate(blocks, F.struct(*reached), step, lambda acc: F.array_join(acc["got"], ""))).otherwise("")


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` (conv_id, text, mask) with turns: array<struct<role, text>> and loss: all text under the mask, unescaped."""
    blocks = F.split(F.col("text"), TURN_END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def opened(block: Column) -> Column:
        at = F.split(F.substring(block, len(HEAD) + 1, 1 << 30), ROLE_END, 2)
        role = unescape(F.get(at, F.lit(0)))
        return F.transform(F.split(F.get(at, F.lit(1)), PART, -1), lambda part: F.struct(role.alias("role"), unescape(part).alias("text")))

    turns = chats.withColumn("turns", F.flatten(F.transform(blocks, opened)))
    return turns.withColumn("loss", unescape(under_mask(F.col("text"), F.col("mask"))))


def digest(chats: DataFrame) -> DataFrame:
    """What a reader of the formatted texts finds: turns and their hash, the text under the loss mask and its hash."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )
