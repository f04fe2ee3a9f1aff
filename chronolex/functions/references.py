"""Provision references in Korean questions, as paths such as 제3조의2/항1/호4/목가."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Numeral syllables and the signs for 1 to 20, as the paths of the source need them.
DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
UNITS = {"십": 10, "백": 100}
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
#: Articles that one range may name.
WIDEST = 20

def korean_number(word: str) -> int | None:
    """The number that digits, tens and hundreds spell; null for anything else."""
    total, open_digit = 0, None
    for c in word:
        if c in DIGITS and open_digit is None:
            open_digit = DIGITS[c]
        elif c in UNITS:
            total, open_digit = total + (1 if open_digit is None else open_digit) * UNITS[c], None
        else:
            return None
    return total + (open_digit or 0) if word else None


def _numerals_to_digits(text: str) -> str:
    """``text`` with the numeral syllables that stand between 제 and a unit sign as digits."""
    head, *rest = text.split("제")
    out = [head]
    for part in rest:
        body = part.lstrip()
        size = next((i for i, c in enumerate(body) if c not in DIGITS and c not in UNITS), len(body))
        after = body[size:].lstrip()
        number = korean_number(body[:size])
        out.append(part if number is None or after[:1] not in ("조", "항", "호") else f"{number}{after}")
    return "제".join(out)


@F.pandas_udf(StringType())
def with_arabic_numbers(texts: pd.Series) -> pd.Series:
    """NFKC text in which numerals between 제 and 조, 항 or 호 are digits; circled paragraph signs become digits too."""
    # the signs for 1 to 20 decompose to digits
    return texts.map(lambda text: None if text is None else _numerals_to_digits(unicodedata.normalize("NFKC", text)))


#: What a reader of references has in hand: the finished paths, the path being built and how deep it is (1 article,
#: 2 paragraph, 3 item, 4 subitem), the first article, a number and a syllable that wait for their sign, the token before,
#: whether a conjunction came since the last path, and the ends of a range of articles.
_STATE = {
    "done": "array<string>", "path": "string", "depth": "int", "first": "string", "number": "bigint", "syllable": "string", "before": "string", "joined": "boolean", "low": "bigint", "high": "bigint",
}
_JOINING = ("및", "또는", ",", "ㆍ")


def _read(state: Column, token: Column) -> Column:
    """The state after one more token: a number, a sign, a conjunction or any other syllable or character."""
    none = {k: F.lit(None).cast(t) for k, t in _STATE.items()}

    def now(**changes: Column) -> Column:
        changes = {"before": token, "syllable": none["syllable"], **changes}
        return F.struct(*[changes.get(k, state[k]).cast(t).alias(k) for k, t in _STATE.items()])

    finished = F.when(state["path"].isNotNull(), F.concat(state["done"], F.array(state["path"]))).otherwise(state["done"])
    closed = {"done": finished, "path": none["path"], "depth": F.lit(0), "number": none["number"]}
    counted, n = state["number"].isNotNull(), state["number"]
    deeper = lambda sign, value, depth: now(path=F.concat(state["path"], F.lit(f"/{sign}"), value), depth=F.lit(depth), number=none["number"])
    article = F.concat(F.lit("제"), n, F.lit("조"))
    branch = F.concat(state["path"], F.lit("의"), token.cast("bigint"))
    ends_range = state["low"].isNotNull() & state["high"].isNull()
    dangling = state["syllable"].isNotNull() & (token != "목")  # a syllable that was no subitem's letter ended the path
    return (
        F.when((token == "목") & state["syllable"].isNotNull() & state["depth"].between(1, 3), deeper("목", state["syllable"], 4))
        .when(token.rlike("^[0-9]") & (state["before"] == "의") & (state["depth"] == 1), now(path=branch, first=F.when(state["first"] == state["path"], branch).otherwise(state["first"])))
        .when(token.rlike("^[0-9]"), F.when(dangling, now(**{**closed, "number": token})).otherwise(now(number=token)))
        .when((token == "조") & counted, now(**{**closed, "path": article, "depth": F.lit(1), "first": F.coalesce(state["first"], article), "joined": F.lit(False), "high": F.when(ends_range, n).otherwise(state["high"])}))
        .when((token == "의") & (state["before"] == "조"), now())
        .when((token == "항") & counted & (state["depth"] == 1), deeper("항", n, 2))
        .when((token == "항") & counted & state["joined"] & state["first"].isNotNull(), now(**{**closed, "path": F.concat(state["first"], F.lit("/항"), n), "depth": F.lit(2), "joined": F.lit(False)}))
        .when((token == "호") & counted & state["depth"].between(1, 2), deeper("호", n, 3))
        .when((token == "부터") & (state["before"] == "조"), now(low=F.regexp_extract(state["path"], "[0-9]+", 0)))
        .when(token.isin(*_JOINING), now(**closed, joined=F.lit(True)))
        .when(token == "제", F.when(dangling, now(**closed)).otherwise(now(number=none["number"])))
        .when(token.rlike("^[가-힣]$") & ~dangling & ~counted, now(syllable=token))
        .otherwise(now(**closed, joined=F.lit(False)))
    )


def references(text: Column) -> Column:
    """struct<paths, invalid>: distinct paths that ``text`` (with_arabic_numbers) names, or why its range is refused.

    The text is read token by token. Signs deepen the path that is being built; anything else ends it. A range of
    articles stands for all of them. A paragraph after a conjunction belongs to the first article.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+|부터|또는|\S"), F.lit(0))
    start = {k: F.lit(None) for k in _STATE} | {"done": F.array(), "depth": F.lit(0), "joined": F.lit(False)}
    fold = F.aggregate(F.concat(tokens, F.array(F.lit("."))), F.struct(*[v.cast(_STATE[k]).alias(k) for k, v in start.items()]), _read)
    # as the element of an array the fold's end is evaluated once
    return F.get(F.transform(F.array(fold), _answer), F.lit(0))


def _answer(end: Column) -> Column:
    low, high = end["low"], end["high"]
    ranged = low.isNotNull() & high.isNotNull()
    invalid = F.when(ranged & (high < low), "descending_range").when(ranged & (high - low >= WIDEST), "range_too_wide")
    articles = F.transform(F.sequence(low, F.greatest(low, F.least(high, low + WIDEST))), lambda n: F.concat(F.lit("제"), n, F.lit("조")))
    paths = F.when(invalid.isNotNull(), F.array().cast("array<string>")).when(ranged, articles).otherwise(F.array_distinct(end["done"]))
    return F.struct(paths.alias("paths"), invalid.alias("invalid"))


#: Fixed value: what stands before the number of an article as the title of a document, known or not.
TITLE = r"([0-9A-Za-z가-힣ㆍ·()]+(?:\s+[0-9A-Za-z가-힣ㆍ·()]+){0,5}(?:법|령|규칙|기준))\s*(?:의|에서)?\s*(?:제\s*)?\d+\s*조"


def unknown_title(text: Column) -> Column:
    """The words before the first article number of ``text`` (with_arabic_numbers) that look like a title, or null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, TITLE, 1), r"\s+", " ")), F.lit(""))


def storage_variants(path: Column) -> Column:
    """A path and its spelling with signs: circled paragraph numbers, a point after items and subitems."""
    signs = F.array(*[F.lit(c) for c in CIRCLED])
    n = F.nullif(F.regexp_extract(path, r"/항(\d+)", 1), F.lit("")).cast("int")
    signed = F.when(n.between(1, len(CIRCLED)), F.regexp_replace(path, F.lit(r"/항\d+"), F.concat(F.lit("/항"), F.get(signs, n - 1)))).otherwise(path)
    pointed = F.regexp_replace(F.regexp_replace(signed, r"/호(\d+)", "/호$1."), r"/목([가-힣])", "/목$1.")
    return F.array_sort(F.array_distinct(F.array(path, pointed)))
