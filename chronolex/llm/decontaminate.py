"""Benchmark passages in documents by q-gram lemma filtering and banded alignment.

Texts are compared in a plain form: lower case, one space for what isn't a letter, digit or non-ASCII character, as
UTF-8 bytes. If an item of m bytes occurs with at most k edits, then at least m - q + 1 - k q of its q-grams occur in
the document on diagonals (place in the document less place in the item) at most k apart. So shared q-grams are
counted in diagonal bands of width 2 k that overlap by k; a band with fewer of them than the bound is dropped, and
what is left is verified by an alignment that stays inside the band. Items for which the bound of 8-grams says too
little have 4-grams; items of fewer than SHORT plain bytes are looked for as whole words, without edits.

A document is gone through from front to back: hits are counted some millions at a time, and a band is settled as soon
as the text is past it. Regions of a document that are equal byte by byte are aligned once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm import textarrays as T
from chronolex.llm.durable import keep, plainly_named

#: Lengths of grams, the longer one where at least LEAST_GRAMS shared grams are asked for.
Q, Q_SMALL, LEAST_GRAMS = 8, 4, 4
#: Plain bytes below which an item has to occur exactly and as whole words.
SHORT = 8
#: Edits allowed, as a share of an item's length in bytes.
EDITS = 0.1
#: Bytes of benchmark text that the driver and the tasks hold at once; a larger benchmark is gone through in slices.
SLICE_BYTES = 8 << 20
#: Gram hits counted in one numpy pass, and cells of one alignment pass.
HITS, CELLS = 1 << 21, 1 << 22

_PLAIN = np.where(T.LETTERS, T.LOWER, 0x20).astype(np.uint8)
_HASH = np.uint64(0x9E3779B97F4A7C15)


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of texts and their offsets; spaces at a text's ends go."""
    out = _PLAIN[data]
    if not len(out):
        return out, offsets
    second = np.zeros(len(out), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[second] += 0x20  # capital Latin-1 letters
    space = out == 0x20
    begins = np.zeros(len(out), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    drop = space.copy()
    drop[1:] &= space[:-1] | begins[1:]
    drop[begins & space] = True
    kept = np.concatenate(([0], np.cumsum(~drop)))
    own = kept[offsets]
    out = out[~drop]
    # a space that ends a text
    ends = own[1:][np.diff(own) > 0] - 1
    ends = ends[out[ends] == 0x20]
    if len(ends):
        gone = np.zeros(len(out), bool)
        gone[ends] = True
        own = np.concatenate(([0], np.cumsum(~gone)))[own]
        out = out[~gone]
    return out, own


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """The ``q`` (4 or 8) bytes from each place on, as one number."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), f"<u{q}", np.ascontiguousarray(text).tobytes(), strides=(1,)).astype(np.uint64)


def least_edits(item: np.ndarray, regions: np.ndarray, most: int) -> np.ndarray:
    """For each row of ``regions`` the fewest edits, more than ``most`` if it takes more, that turn ``item`` into a part of it.

    A row starts where the band's lowest diagonal begins and is as long as the item and the band's diagonals together;
    bytes zero stand for what lies outside of the text and equal no byte of an item.
    """
    m = len(item)
    width = regions.shape[1] - m + 1
    out = np.full(len(regions), most + 1)
    rows, own = np.arange(len(regions)), np.zeros((len(regions), width), np.int32)
    step = np.arange(width, dtype=np.int32)
    for j in range(m):
        new = own + (regions[rows, j : j + width] != item[j])
        new[:, :-1] = np.minimum(new[:, :-1], own[:, 1:] + 1)  # a byte of the item left out
        # a byte of the text skipped moves to the next diagonal at the same item byte
        own = np.minimum.accumulate(new - step, axis=1) + step
        if j % 8 == 7:
            fits = own.min(axis=1) <= most
            if not fits.all():
                rows, own = rows[fits], own[fits]
                if not len(rows):
                    return out
    out[rows] = np.minimum(own.min(axis=1), most + 1)
    return out


class Grams:
    """Items of one gram length: plain texts, edit budgets, gram bounds and the sorted grams with their places."""

    def __init__(self, q: int, texts: list[np.ndarray], number: np.ndarray, budget: np.ndarray):
        self.q, self.texts, self.number, self.budget = q, texts, number, budget
        size = np.array([len(t) for t in texts], np.int64)
        self.bound = np.maximum(size - q + 1 - q * budget, 1)
        self.width = np.maximum(budget, 1)
        self.longest = int(size.max()) if len(size) else 0
        parts = [grams(t, q) for t in texts]
        code = np.concatenate([np.zeros(0, np.uint64), *parts])
        item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        place = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(p), dtype=np.int32) for p in parts]])
        order = np.argsort(code, kind="stable")
        self.code, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.code * _HASH) >> np.uint64(44)] = True

    def found(self, text: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text number, item number, edits) of all items that occur in the plain texts."""
        code = grams(text, self.q)
        if not len(code) or not len(self.code):
            return []
        at = np.flatnonzero(self.filter[(code * _HASH) >> np.uint64(44)])
        slot = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        ok = self.code[slot] == code[at]
        at, slot = at[ok], slot[ok]
        doc = np.searchsorted(offsets, at, side="right") - 1
        ok = at + self.q <= offsets[doc + 1]
        at, slot, doc = at[ok], slot[ok], doc[ok]
        many = self.first[slot + 1] - self.first[slot]
        total = np.cumsum(many)
        best: dict[tuple[int, int], int] = {}
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        span = int(np.diff(offsets).max(initial=0) + 2 * self.longest) + 3
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS, side="right")))
            new, n = self._cells(offsets, at[begin:end], slot[begin:end], doc[begin:end], many[begin:end], span)
            key, of = np.unique(np.concatenate((key, new)), return_inverse=True)
            count = np.bincount(of, weights=np.concatenate((count, n))).astype(np.int64)
            key, count = self._settle(text, offsets, key, count, span, (int(doc[end]), int(at[end])) if end < len(at) else None, best)
            begin = end
        return [(d, int(self.number[i]), e) for (d, i), e in best.items()]

    def _cells(self, offsets, at, slot, doc, many, span):
        """Cells (document, item, diagonal over width) of the hits, and how many hits are in each."""
        hit = np.repeat(self.first[slot] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item = self.item[hit].astype(np.int64)
        diagonal = np.repeat(at - offsets[doc], many) - self.place[hit]
        cell = (diagonal + self.longest) // self.width[item]
        return np.unique((np.repeat(doc, many) * len(self.texts) + item) * span + cell, return_counts=True)

    def _settle(self, text, offsets, key, count, span, next_hit, best):
        """Align in the bands that no hit can be added to any more, and return the cells of the others."""
        item = key // span % len(self.texts)
        doc = key // span // len(self.texts)
        low = key % span * self.width[item] - self.longest
        follows = np.zeros(len(key), np.int64)
        follows[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        done = np.ones(len(key), bool)
        if next_hit is not None:
            d, at = next_hit
            done = (doc < d) | (offsets[doc] + low + 2 * self.width[item] + self.longest < at)
        # a band is a cell and the next; a cell without one before it is also the upper half of a band
        kept = np.flatnonzero(done & (count + follows >= self.bound[item]))
        kept = kept[np.argsort(item[kept], kind="stable")]
        for a, b in _runs(item[kept]):
            self._align(text, offsets, int(item[kept[a]]), doc[kept[a:b]], low[kept[a:b]], best)
        return key[~done], count[~done]

    def _align(self, text, offsets, i, doc, low, best):
        """The least edits of item ``i`` in the bands that begin at the diagonals ``low``; what is found goes to ``best``."""
        own, budget = self.texts[i], int(self.budget[i])
        length = len(own) + 2 * int(self.width[i]) + 2 * budget
        for lo in range(0, len(doc), max(1, CELLS // length)):
            d = doc[lo : lo + max(1, CELLS // length)]
            at = (offsets[d] + low[lo : lo + len(d)] - budget)[:, None] + np.arange(length)
            inside = (at >= offsets[d][:, None]) & (at < offsets[d + 1][:, None])
            regions = np.where(inside, text[np.where(inside, at, 0)], 0).astype(np.uint8)
            different, of = np.unique(regions.view(np.dtype((np.void, length))).ravel(), return_inverse=True)
            edits = least_edits(own, different.view(np.uint8).reshape(-1, length), budget)[of]
            for k in np.flatnonzero(edits <= budget):
                pair = int(d[k]), i
                best[pair] = min(best.get(pair, budget), int(edits[k]))


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_values):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)]))
        yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


class Items:
    """A slice of the benchmark: its plain texts by way of search."""

    def __init__(self, ids: list[int], texts: list[str], share: float = EDITS):
        data, offsets = plain(*T.flat(pa.array(texts, pa.large_string())))
        size = np.diff(offsets)
        self.ids = np.array(ids, np.int64)
        self.texts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.budget = np.where(size >= SHORT, (size * share).astype(np.int64), 0)
        long = size - Q + 1 - Q * self.budget >= LEAST_GRAMS
        of = lambda q, which: Grams(q, [self.texts[i] for i in which], which, self.budget[which])
        self.by_grams = [g for g in (of(Q, np.flatnonzero(long & (size >= SHORT))), of(Q_SMALL, np.flatnonzero(~long & (size >= SHORT)))) if g.texts]
        self.words = [(i, b" " + self.texts[i].tobytes() + b" ") for i in np.flatnonzero((size > 0) & (size < SHORT))]

    def _words(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) if self.words else ():
            own = b" " + text[a:b].tobytes() + b" "
            yield from ((d, int(i), 0) for i, word in self.words if word in own)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text number, item number, edits) of all items that occur in ``texts``."""
        data, offsets = T.flat(texts)
        out = []
        for lo, hi in T.passes(offsets):
            own = offsets[lo : hi + 1]
            part = plain(data[own[0] : own[-1]], own - own[0])
            for hits in (*[g.found(*part) for g in self.by_grams], self._words(*part)):
                out += [(lo + d, i, e) for d, i, e in hits]
        return out


class Slice:
    """What a task is sent of a slice: ids and texts; the index is built in the Python worker and kept there for one slice."""

    held: tuple[str, Items] | None = None

    def __init__(self, ids: list[int], texts: list[str], share: float):
        self.name, self.ids, self.texts, self.share = uuid.uuid4().hex, ids, texts, share

    def items(self) -> Items:
        if Slice.held is None or Slice.held[0] != self.name:
            Slice.held = (self.name, Items(self.ids, self.texts, self.share))
        return Slice.held[1]


def slices(benchmark: DataFrame, share: float = EDITS, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[Slice, bool]]:
    """The benchmark (item_id, text) in slices of about ``slice_bytes``, one after the other, and whether each is the only one.

    Null texts and ids hold nothing to find.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / slice_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Slice([r["item_id"] for r in rows], [r["text"] for r in rows], share), n == 1


def contaminations(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id and edits of each item found in a row of ``docs`` (doc_id, text), at most ``share`` edits by byte.

    ``edits`` is the least number that makes the item a part of the text. Items of fewer than SHORT plain bytes have to
    occur exactly, as whole words; items without a plain byte and null texts hold nothing. doc_id keeps its type.
    Repeated documents have rows each; items that share an id are found each. Other columns are ignored. Empty tables
    give an empty result. A benchmark of several slices takes a pass for each, whose result is written before the next.
    """
    docs = docs.select("doc_id", "text")
    schema = T.schema_of(docs, "doc_id", item_id="long", edits="long")
    out = None
    for part, only in slices(benchmark, share, slice_bytes):

        def each(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            items = part.items()
            for batch in batches:
                hits = items.search(batch.column(1))
                where = pa.array([d for d, _, _ in hits], pa.int64())
                arrays = [batch.column(0).take(where), pa.array([int(items.ids[i]) for _, i, _ in hits], pa.int64()), pa.array([e for _, _, e in hits], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "edits"])

        found = docs.mapInArrow(each, schema)
        if not only:
            found = keep(found, "found")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with the columns of ``docs``."""
    text, names = docs.columns.index("text"), docs.columns
    docs = plainly_named(docs)
    for part, only in slices(benchmark, share, slice_bytes):

        def each(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            items = part.items()
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[d for d, _, _ in items.search(batch.column(text))]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(each, docs.schema)
        if not only:
            docs = keep(docs, "clean")
    return docs.toDF(*names)
