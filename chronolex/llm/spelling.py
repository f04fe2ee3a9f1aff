"""Spelling variants: words one edit apart, by forward and backward minimal acyclic automata that number their words.

Of two words one edit apart, the longer one of m code points, the halves of m // 2 code points at one end are equal. So
words meet in Spark by either half, and each task builds an automaton over the words it holds: read forward for equal first
halves, read backward for equal last ones. A word walks through its half exactly and through the rest with one
replaced or skipped code point; the word number found at the end is the partner's row. What both directions would find
is given by the forward one alone. An inserted code point is the partner's skipped one, so only the longer word asks.

A half that very many words share is split further: the rest of such words again agrees in half of it at one end.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm import textarrays as T
from chronolex.llm.durable import keep

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Every so many of the (document, word) hashes lose a code point; shortest words; fewest occurrences; a form's share.
MODULUS, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Distinct words whose counts a worker holds before it gives them away.
HELD = 200_000
#: A group of more words is split by further letters; 8,190 words of two free letters of 90 always fit.
MOST_WORDS, MOST_CELLS = 1 << 16, 1 << 23
#: Cells of one automaton's letter matrix, unless one group has more; words that ask at once.
CELLS, ASKING = 1 << 21, 1 << 13
NO_LIMIT = 1 << 30
_LOWER = bytes(T.LOWER.tolist())


def occurrences(docs: DataFrame, modulus: int = MODULUS, least: int = LEAST_LENGTH, held: int = HELD) -> DataFrame:
    """(word, n): partial counts of the words of ``docs`` (doc_id, text), summed up by whoever reads them.

    Runs of letters are lower-cased in A-Z alone. Where ``modulus`` divides the crc32 of "doc_id:run", the run loses
    its code point number crc32 % length. Null texts have no runs; a null doc_id is written as nothing.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(RUN.findall(text.encode().translate(_LOWER).decode())).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % modulus == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            total[word] += n
                    if len(total) > held:
                        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                        total.clear()
            elif total:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(each, "word string, n long")


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Automaton:
    """The minimal acyclic automaton of sorted words in sorted groups; a word's number is its row.

    States are sets of endings: nodes of the trie are merged by a 64-bit hash of theirs, from the last level to the first.
    An edge knows how many words of its state come before it, so the edges of a path add up to the word's number.
    """

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, group: np.ndarray):
        n, width = letters.shape
        same = np.zeros((n, width), bool)
        same[1:] = letters[1:] == letters[:-1]
        shared = np.where(same.all(axis=1), width, same.argmin(axis=1)) if width else np.zeros(n, np.int64)
        shared[np.concatenate(([True], group[1:] != group[:-1]))] = -1
        first = [np.flatnonzero((lengths >= d) & (shared < d)) for d in range(width + 1)]
        base = np.cumsum([0, *map(len, first)])
        hashes = np.zeros(base[-1], np.uint64)
        edges = []
        with np.errstate(over="ignore"):
            for d in range(width, -1, -1):
                own = (lengths[first[d]] == d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                if d < width and len(first[d + 1]):
                    child = first[d + 1]
                    parent = np.searchsorted(first[d], child, side="right") - 1
                    symbol = letters[child, d].astype(np.int64)
                    below = hashes[base[d + 1] : base[d + 2]]
                    one = T.mix(below * np.uint64(0xC2B2AE3D27D4EB4F) + T.mix(symbol.astype(np.uint64) + np.uint64(77)))
                    begin = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
                    own[parent[begin]] += np.add.reduceat(one, begin)
                    edges.append((base[d] + parent, symbol, base[d + 1] + np.arange(len(child)), child - first[d][parent]))
                hashes[base[d] : base[d + 1]] = T.mix(own + np.uint64(1))
        _, kept, state = np.unique(hashes, return_index=True, return_inverse=True)
        stands = np.zeros(len(hashes), bool)
        stands[kept] = True
        parent, symbol, child, before = (np.concatenate(c) for c in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 4
        held = stands[parent]
        key = (state[parent[held]] << 21) | symbol[held]
        order = np.argsort(key)
        self.key, self.symbol = key[order], symbol[held][order]
        self.to, self.before = state[child[held]][order], before[held][order]
        self.begin = np.searchsorted(self.key >> 21, np.arange(len(kept) + 1))
        level = np.searchsorted(base, kept, side="right") - 1
        self.final = lengths[np.concatenate(first)[kept]] == level
        self.root = state[: len(first[0])]
        self.root_row = first[0]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next states and words before them where there is an edge, and where that is."""
        if not len(self.key):
            return state[:0], state[:0], np.zeros(0, np.int64)
        at, found = _lookup(self.key, (state << 21) | symbol)
        where = np.flatnonzero(found)
        return self.to[at[where]], self.before[at[where]], where

    def near(self, letters: np.ndarray, asks: np.ndarray, group: np.ndarray, m: np.ndarray, p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (asking, found) of words one replaced or skipped code point from each row in ``asks``.

        The error lies behind the first ``p`` and before the last ``s`` of the asking word's ``m`` code points.
        """
        found = []
        exact = self.root[group[asks]], self.root_row[group[asks]]
        q, live = asks, np.arange(len(asks))
        eq, es, en = (np.zeros(0, np.int64),) * 3
        for i in range(int(m[asks].max(initial=0))):
            here = m[q] > i
            q, live, exact = q[here], live[here], (exact[0][here], exact[1][here])
            symbol = letters[q, i].astype(np.int64)
            to, before, where = self.step(es, letters[eq, i].astype(np.int64))
            parts = [(eq[where], to, en[where] + before)]
            free = (p[q] <= i) & (i < m[q] - s[q])
            fq, fs, fn = q[free], exact[0][free], exact[1][free]
            parts.append((fq, fs, fn))
            sizes = self.begin[fs + 1] - self.begin[fs]
            at = np.repeat(self.begin[fs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            other = self.symbol[at] != np.repeat(symbol[free], sizes)
            at = at[other]
            parts.append((np.repeat(fq, sizes)[other], self.to[at], np.repeat(fn, sizes)[other] + self.before[at]))
            eq, es, en = (np.concatenate(c) for c in zip(*parts, strict=True))
            over = m[eq] == i + 1
            ended = over & self.final[es]
            found.append(np.column_stack((eq[ended], en[ended])))
            eq, es, en = eq[~over], es[~over], en[~over]
            to, before, where = self.step(exact[0], symbol)
            q, live, exact = q[where], live[where], (to, exact[1][where] + before)
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def _ends(letters: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many code points the words of rows ``a`` and ``b`` share from their beginnings and from their ends."""
    least = np.minimum(lengths[a], lengths[b])
    out = []
    for back in (False, True):
        n, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(open_):
            open_ = open_[n[open_] < least[open_]]
            x, y, k = a[open_], b[open_], n[open_]
            alike = letters[x, lengths[x] - 1 - k if back else k] == letters[y, lengths[y] - 1 - k if back else k]
            open_ = open_[alike]
            n[open_] += 1
        out.append(n)
    return out[0], out[1]


_GROUP = "m int, p int, s int, before int, behind int, backward boolean, key string"
_NAMES = ["m", "p", "s", "before", "behind", "backward", "key", "word", "n"]


def _found(most_words: int, cells: int):
    """A function over rows (m, p, s, before, behind, backward, key, word, n) sorted by m, key and word: (word, n, near, near_n).

    Rows of groups that are too large come back as (word, null, null, null) with the columns of their group.
    """
    names = ["word", "n", "near", "near_n", "group"]

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, words, n = rows["key"].to_numpy(), rows["word"].to_pylist(), rows["n"].to_numpy()
        m, p, s, before, behind = (rows[c].to_numpy().astype(np.int64) for c in _NAMES[:5])
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        array = np.array(words)
        letters = array.view(np.uint32).reshape(len(words), -1)
        lengths = np.array(list(map(len, words)), np.int64)
        automaton = Automaton(letters, lengths, group)
        asking = np.flatnonzero(lengths == m)
        for lo in range(0, len(asking), ASKING):
            a, b = automaton.near(letters, asking[lo : lo + ASKING], group, m, p, s)
            start, end = _ends(letters, lengths, a, b)
            ok = (start + end >= m[a] - 1) & (start < before[a]) & (end < behind[a])
            a, b = a[ok], b[ok]
            short = lengths[b] < m[b]  # a shorter word doesn't ask itself
            a, b = np.concatenate((a, b[short])), np.concatenate((b, a[short]))
            backward = rows["backward"].to_numpy()
            said = lambda at: pa.array([words[k][::-1] if backward[k] else words[k] for k in at.tolist()], pa.string())  # noqa: B023, E731
            if len(a):
                yield pa.RecordBatch.from_arrays([said(a), pa.array(n[a]), said(b), pa.array(n[b]), pa.nulls(len(a), _group_type())], names=names)

    def large(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in _NAMES[:6]], fields=list(_group_type()))
        nothing = pa.nulls(len(rows), pa.string())
        yield pa.RecordBatch.from_arrays([rows["word"].combine_chunks(), rows["n"].combine_chunks(), nothing, pa.nulls(len(rows), pa.int64()), group], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        too_large = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                if too_large is not None:  # the group found too large goes on
                    changes = np.flatnonzero(_changes(new))
                    goes_on = 0 if new["key"][0].as_py() != too_large else int(changes[0]) if len(changes) else len(new)
                    if goes_on:
                        yield from large(new.slice(0, goes_on))
                        new = new.slice(goes_on)
                    if len(new):
                        too_large = None
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not len(held):
                continue
            begin = np.concatenate(([0], np.flatnonzero(_changes(held)), [len(held)]))
            m = held["m"].to_numpy()
            done = lo = 0
            for k in range(len(begin) - 1):
                s, e = int(begin[k]), int(begin[k + 1])
                over = e - s > most_words or (e - s) * int(m[s]) > MOST_CELLS
                last = k == len(begin) - 2 and batch is not None
                if over and int(m[s]) - int(held["p"][s].as_py()) - int(held["s"][s].as_py()) > 2:
                    if s > lo:
                        yield from block(held.slice(lo, s - lo))
                    yield from large(held.slice(s, e - s))
                    too_large = held["key"][s].as_py() if last else None
                    lo = done = e
                    continue
                if (s - lo) * int(m[s]) > cells:
                    yield from block(held.slice(lo, s - lo))
                    lo = s
                done = lo if last else e
            if batch is None and len(held) > lo:
                yield from block(held.slice(lo))
                done = len(held)
            elif batch is not None:
                done = lo
            held = held.slice(done).combine_chunks()

    return each


def _changes(rows: pa.Table) -> np.ndarray:
    """Whether a row's key differs from the one before; the first one's doesn't."""
    key = rows["key"].to_numpy()
    return np.concatenate(([False], key[1:] != key[:-1]))


def _group_type() -> pa.DataType:
    return pa.struct([*[(c, pa.int32()) for c in _NAMES[:5]], ("backward", pa.bool_())])


def _halves(m: Column, p: Column, s: Column, before: Column, behind: Column, backward: Column, word: Column) -> Column:
    """Both readings of a word in a group whose words share the first ``p`` and last ``s`` code points: half of what is left
    is fixed behind the first, or, read the other way, before the last. Pairs alike in the first are left out of the second."""
    more = p + F.floor((m - p - s) / 2).cast("int")
    other = s + F.floor((m - p - s) / 2).cast("int")
    shape = lambda p, s, before, behind, backward, word: F.struct(
        m.alias("m"), p.alias("p"), s.alias("s"), before.alias("before"), behind.alias("behind"), backward.alias("backward"),
        F.concat_ws(" ", m, p, s, before, behind, backward, F.left(word, p), F.right(word, s)).alias("key"), word.alias("word"),
    )
    return F.array(shape(more, s, before, behind, backward, word), shape(other, p, behind, F.least(before, more), ~backward, F.reverse(word)))


def near_words(words: DataFrame, most_words: int = MOST_WORDS, cells: int = CELLS) -> DataFrame:
    """(word, n, near, near_n): every two of the distinct ``words`` (word, n) one edit apart, in both directions.

    Words of any length stand; null words and empty ones have no part. An empty table gives an empty result.
    """
    zero, none = F.lit(0), F.lit(NO_LIMIT)
    words = words.where(F.length("word") > 0)
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    rows = words.select("word", "n", lengths).select(F.explode(_halves(F.col("m"), zero, zero, none, none, F.lit(False), F.col("word"))).alias("g"), "n")
    out = None
    while True:
        dealt = rows.select("g.*", "n").repartition("key").select(*_NAMES).sortWithinPartitions("m", "key", "word")
        schema = "word string, n long, near string, near_n long, group struct<m: int, p: int, s: int, before: int, behind: int, backward: boolean>"
        found = keep(dealt.mapInArrow(_found(most_words, cells), schema), "near")
        pairs = found.where("near is not null").select("word", "n", "near", "near_n")
        out = pairs if out is None else out.unionByName(pairs)
        left = found.where("near is null")
        if left.isEmpty():
            return out
        g = [F.col(f"group.{c}") for c in _NAMES[:6]]
        rows = left.select(F.explode(_halves(*g, F.col("word"))).alias("g"), "n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) over (word, form): the last word that is reached. Each round doubles the steps; chains have no rings."""
    now = keep(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = keep(now.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(
    docs: DataFrame, modulus: int = MODULUS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, most_words: int = MOST_WORDS, cells: int = CELLS, held: int = HELD
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text; others ignored) that is frequent enough.

    A word's form is its most frequent near word (ties: the first in code-point order) if that has at least ``ratio`` times
    its occurrences. The last three set what a task holds at once, not what comes out. Null and empty texts have no words; repeated rows count again; an empty table gives an empty result.
    """
    words = keep(occurrences(docs, modulus, least_length, held).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")
    near = near_words(words, most_words, cells)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b"))
    enough = -F.col("b.minus") >= F.col("n") * ratio
    whole = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.minus")).alias("form_n")
    )
    whole = keep(whole, "variants")
    ended = roots(whole.where("form is not null"))
    return whole.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
