"""Secrets in texts: three fixed patterns and a sliding-window entropy over token-like strings.

Places of matches come from cutting the text at the pattern: the pieces between matches and the matches alternate, so
running sums of their lengths give every start. A candidate for the entropy scan is a long run of one character
class that mixes letters and digits; a window slides over it and keeps a count for each character and the running sum
of c log2 c, from which the window's entropy follows in constant time. Runs of letters alone aren't candidates: they are
words and names far more often than keys. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs shorter than the minimum hold no longer run of the same class, so the bound can stand in the pattern itself
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Candidates: runs of the base64 class, URL-safe letters included, of at least WINDOW characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: The characters of a candidate without its padding.
ALPHABET = string.ascii_letters + string.digits + "+/_-"
WINDOW = 20
#: Least entropy in bits of some window, by class: hexadecimal, alphanumeric, base64. At most log2(WINDOW) = 4.32.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Candidates that are left alone: hyphenated UUIDs, dates and ISO times; by ``joined`` also paths and words joined by one sign.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"\d{4}-\d{2}-\d{2}(?:[T_-]\d{2}-?\d{2}(?:-?\d{2}(?:-?\d{1,9})?)?Z?)?",
)
#: What paths and words joined by one sign are made of. They are cut at their signs: a pattern that repeats a group would
#: take Java's matcher a stack frame for each repetition.
JOINT, PART = "[/_-]", r"^(?:[A-Za-z]{2,}|\d{1,8})$"


_SPANS = "array<struct<start:int,end:int,hit:string>>"
#: A running sum that keeps its steps copies them at each step; in blocks of so many matches that stays cheap for texts
#: with hundreds of thousands of matches.
BLOCK = 256


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches; code points, end exclusive."""
    # a lambda evaluates what it captures anew for each element, so values used more than once are bound as elements
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = bound(whole, lambda w: F.arrays_zip(w.alias("hit"), F.slice(F.split(text, pattern, -1), 1, F.size(w)).alias("gap")))
    numbers = lambda p: F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
    zero = F.lit(0).alias("at")

    def within(block: Column) -> Column:
        """Spans relative to the block's begin, and the block's length."""

        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.length(m["gap"])
            end = start + F.length(m["hit"])
            return F.struct(end.alias("at"), F.concat(acc["got"], F.array(F.struct(start.alias("start"), end.alias("end"), m["hit"].alias("hit")))).alias("got"))

        return F.aggregate(block, F.struct(zero, F.array().cast(_SPANS).alias("got")), step)

    def behind(acc: Column, block: Column) -> Column:
        moved = F.transform(block["got"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["hit"].alias("hit")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["got"], F.array(moved)).alias("got"))

    def placed(p: Column) -> Column:
        blocks = F.transform(numbers(p), lambda b: within(F.slice(p, b * BLOCK + 1, F.lit(BLOCK))))
        spans = F.aggregate(blocks, F.struct(zero, F.array().cast(f"array<{_SPANS}>").alias("got")), behind, lambda acc: F.flatten(acc["got"]))
        return F.when(F.size(p) > 0, spans).otherwise(F.array().cast(_SPANS))

    return bound(pieces, placed)


def top_entropy(word: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits by character, of ``word``'s windows of ``window`` characters of ALPHABET.

    The fold keeps the counts of the window's characters, five bits each and twelve to a long, and the sum of c log2 c.
    A character that enters or leaves changes one count and one difference of that sum, so a step costs the same
    whatever the window; the entropy is log2(n) - sum / n. Characters outside of ALPHABET count as one and the same.
    """
    if not 0 < window < 31:
        raise ValueError("a count of the window has five bits")
    call = F.call_function
    table = F.array(*[F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(window + 2)])
    # place of a character's count: which long, and the bits below it
    number = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(len(ALPHABET) + 1)) - 1
    codes = F.transform(F.split(word, ""), number)
    moves = F.arrays_zip(codes.alias("enters"), F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), 1, F.length(word)).alias("leaves"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-(len(ALPHABET) + 1) // 12)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(float("inf")).alias("least")
    )
    long_of = lambda code: F.floor(code / 12).cast("int")
    bits_of = lambda code: F.pmod(code, F.lit(12)) * 5
    one = lambda code: call("shiftleft", F.lit(1).cast("long"), bits_of(code))
    count = lambda n, code: call("shiftright", F.get(n, long_of(code)), bits_of(code)).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def step(acc: Column, m: Column) -> Column:
        enters, leaves = m["enters"], m["leaves"]
        c = count(acc["n"], enters)
        after = acc["sum"] + F.get(table, c + 1) - F.get(table, c)
        d = count(acc["n"], leaves) + F.when(leaves == enters, 1).otherwise(0)
        after = after + F.when(leaves >= 0, F.get(table, d - 1) - F.get(table, d)).otherwise(0.0)
        n = F.transform(
            acc["n"], lambda x, k: x + F.when(k == long_of(enters), one(enters)).otherwise(F.lit(0).cast("long")) - F.when((leaves >= 0) & (k == long_of(leaves)), one(leaves)).otherwise(F.lit(0).cast("long"))
        )
        return F.struct(n.alias("n"), after.alias("sum"), (acc["seen"] + 1).alias("seen"), F.when(acc["seen"] + 1 >= window, F.least(acc["least"], after)).otherwise(acc["least"]).alias("least"))

    return F.aggregate(moves, start, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)


def joined(word: Column) -> Column:
    """Whether ``word`` is two or more PARTs with one JOINT between each two, a slash before and behind them allowed."""
    parts = F.split(F.regexp_replace(word, "^/|/$", ""), JOINT, -1)
    return (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(PART))


def _suspicious(word: Column, thresholds: dict[str, float], allowed: Sequence[str], window: int) -> Column:
    bare = F.rtrim(word, F.lit("="))
    least = (
        F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), thresholds["hex"]).when(bare.rlike("^[A-Za-z0-9]+$"), thresholds["alnum"]).otherwise(thresholds["base64"])
    )
    mixed = bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")
    known = joined(bare)
    for pattern in allowed:
        known = known | bare.rlike(f"^(?:{pattern})$")
    return mixed & ~known & (top_entropy(bare, window) >= least)


def secrets(docs: DataFrame, thresholds: dict[str, float] | None = None, allowed: Sequence[str] = ALLOWED, window: int = WINDOW) -> DataFrame:
    """doc_id and found: array<struct<start, kind, end>> of each row of ``docs`` (doc_id, text; others are ignored).

    Places are code points, ends exclusive, sorted by start, then kind in the order of KINDS. The kinds of the fixed
    patterns are complete by themselves; entropy spans come on top and may overlap them. Null text counts as empty;
    repeated rows are each returned; an empty table gives an empty result.
    """
    thresholds = THRESHOLDS | (thresholds or {})
    text = F.coalesce("text", F.lit(""))
    as_span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    value = lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= LEAST_VALUE
    candidates = F.filter(matches(text, CANDIDATE), lambda m: _suspicious(m["hit"], thresholds, allowed, window))
    found = F.concat(
        F.transform(F.filter(matches(text, ASSIGN), value), as_span(0)),
        F.transform(matches(text, ACCESS), as_span(1)),
        F.transform(matches(text, HEX), as_span(2)),
        F.transform(candidates, as_span(3)),
    )
    return docs.select("doc_id", F.array_sort(found).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by fixed kind, the hash of the fixed spans and all spans as text."""
    base = F.filter("found", lambda s: s["kind"] < 3)
    number = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), number(3).alias("n_entropy"),
    )
