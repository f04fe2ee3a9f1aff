"""Scalar text functions as Spark expressions; Arrow functions only where no expression exists."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def compact_date(c: Column) -> Column:
    """The date that the digits of ``c`` spell as yyyymmdd; null unless there are eight that do."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))


def title_of(question: Column, most: int = 120) -> Column:
    return F.substring(collapse_whitespace(question), 1, most)


def ellipsize(c: Column, most: int) -> Column:
    """``c`` if it has at most ``most`` code points, else its start without trailing space and an ellipsis, in as many."""
    cut = F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def passage(*parts: Column, trim: bool = True) -> Column:
    """Parts that aren't blank, one to a line; ``trim`` False keeps their white space and skips empty ones only."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p) if trim else p, F.lit("")) for p in parts])


def keep_alphanumeric(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def strip_endings(word: Column, endings: Sequence[str], least: int = 2) -> Column:
    """``word`` without the first of ``endings``, in their order, that leaves at least ``least`` characters."""
    out = F.when(F.lit(False), word)
    for ending in endings:
        out = out.when(word.endswith(ending) & (F.length(word) - len(ending) >= least), F.substring(word, F.lit(1), F.length(word) - len(ending)))
    return out.otherwise(word)


def terms(text: Column, stop: Sequence[str] = (), endings: Sequence[str] = (), most: int = 5, least: int = 2) -> Column:
    """The first ``most`` distinct terms of ``text``: alphanumeric runs, lower case, endings off, short and stop words out."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = F.transform(words, lambda w: strip_endings(w, endings)) if endings else words
    kept = F.filter(words, lambda w: (F.length(w) >= least) & (~w.isin(*stop) if stop else F.lit(True)))
    return F.slice(F.array_distinct(kept), 1, most)


def expand_aliases(found: Column, aliases: dict[str, Sequence[str]]) -> Column:
    """Terms and, after them, the synonyms of each that aren't there yet."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    more = F.flatten(F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(found, more))


def matching(found: Column, text: Column) -> Column:
    """The terms that ``text`` contains."""
    return F.filter(found, lambda t: F.contains(text, t))


def trigrams(text: Column) -> Column:
    """Distinct three-character substrings of the text without white space."""
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(F.length(bare) < 3, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 2, F.lit(1))), lambda i: F.substring(bare, i, F.lit(3))))
    )


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    """A third of each run of printable ASCII, rounded up, and one for every other character but white space."""
    runs = F.regexp_extract_all(text, F.lit(r"[!-~]+"), F.lit(0))
    ascii_tokens = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.ceil(F.length(r) / 3))
    return ascii_tokens + F.length(F.regexp_replace(text, r"[!-~\s]", "")).cast("long")


def approximate_tokens(chars: Column) -> Column:
    return F.bround(chars / F.lit(2.2), 0).cast("long")


def article_root(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


@F.pandas_udf(StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding, for which Spark has no expression."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def nfkc_compact(c: Column) -> Column:
    """Folded text with letters and digits alone, of any script."""
    return F.regexp_replace(nfkc_casefold(c), r"[^\p{L}\p{N}]", "")


@F.pandas_udf(StringType())
def nfkc_lower(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def compact_text(c: Column) -> Column:
    """Digits, Latin letters and Hangul syllables of the compatibility form in lower case."""
    return F.regexp_replace(nfkc_lower(c), "[^0-9a-z가-힣]", "")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of pairs that cheaper bounds have let through."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def allowed_url(url: Column, domains: Sequence[str]) -> Column:
    """https, a listed domain or a host under it, no credentials, no port but 443."""
    host = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    name = F.lower(F.regexp_replace(host, r":443$", ""))
    listed = F.lit(False)
    for domain in domains:
        listed = listed | (name == domain) | name.endswith("." + domain)
    return F.coalesce(listed & ~host.rlike("[@:].*[@:]|@"), F.lit(False))
