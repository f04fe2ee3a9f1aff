"""Near duplicates by SimHash: fingerprints, a grid range-join on per-segment bit counts, exact check, components.

A 64-bit fingerprint is cut into 32 segments of two bits; the count of ones in each segment is its coordinate. The
Manhattan distance of two such points never exceeds the Hamming distance of the fingerprints. The coordinates are two
halves of 16. Of points at a Manhattan distance of at most 4, one half is at most 2 apart, so some cell of the grid over
that half, whose cells are one unit wide, is at most 1 from either point. Each point is therefore put in its own cell
and in those next to it, in both halves, and the points that meet in a cell are held against the Manhattan bound over
all 32 coordinates, then against the exact Hamming distance.

Only connectivity is emitted, never all pairs of a cell: each cell yields a spanning star of each group linked
inside it. Cells with more than CELL fingerprints are cut into chunks and handled chunk pair by chunk pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronolex.llm import textarrays as T
from chronolex.llm.components import connected, spread_join
from chronolex.llm.durable import free_name, keep

WORDS = 4
SEED = 42
BITS = 4
SEGMENTS, HALVES = 32, 2
#: Cells of up to so many fingerprints are compared pair by pair, all of them at once.
SMALL = 16
#: Fingerprints of one grid cell that a single numpy pass handles; larger cells are cut into chunks.
CELL = 4096

_LOW = 0x5555555555555555


def fingerprints(texts: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of each text: bit i is one if more than half of the shingles' XXH64 values have it; no word: zero."""
    data, offsets = T.flat(texts)
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in T.passes(offsets):
        part = T.LOWER[data[offsets[lo] : offsets[hi]]]
        own = offsets[lo : hi + 1] - offsets[lo]
        starts, ends, at = T.word_spans(part, own)
        if not len(starts):
            continue
        lengths = ends - starts
        moved = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int(moved[-1] + lengths[-1] + 1), 0x20, np.uint8)
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[np.repeat(moved, lengths) + place] = part[np.repeat(starts, lengths) + place]
        text = joined.tobytes()
        counts = np.diff(at)
        shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        first = np.cumsum(shingles) - shingles
        which = np.repeat(np.arange(len(counts)), shingles)
        begin = at[:-1][which] + np.arange(int(shingles.sum())) - first[which]
        last = np.minimum(begin + words, at[1:][which]) - 1
        begin, end = moved[begin].tolist(), (moved[last] + lengths[last]).tolist()
        h = np.fromiter((digest(text[s:e], seed) for s, e in zip(begin, end, strict=True)), np.uint64, len(begin))
        full = np.flatnonzero(shingles)
        ones = np.zeros((len(full), 64), np.int64)
        step = max(1, (1 << 22) // 64)
        bounds = np.append(first[full], len(h))
        # a slice of texts at a time keeps the unpacked bits small; a very long text is summed piece by piece
        k = 0
        while k < len(full):
            stop = max(k + 1, int(np.searchsorted(bounds, bounds[k] + step, side="right")) - 1)
            a, b = bounds[k], bounds[stop]
            if stop == k + 1:
                for p in range(a, b, step):
                    ones[k] += np.unpackbits(h[p : min(b, p + step)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            else:
                bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[k:stop] = np.add.reduceat(bits, bounds[k:stop] - a, axis=0, dtype=np.int64)
            k = stop
        over = (ones * 2 > shingles[full][:, None]).astype(np.uint8)
        out[lo + full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(docs: DataFrame, text: str, name: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` and a long column ``name`` with the fingerprint of ``text`` (64 bits, read as signed)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(batch.schema.get_field_index(text)), words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, name])

    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField(name, LongType())]))


def embedding(fp: str):
    """Counts of ones in the 32 two-bit segments, two bits each, as one long."""
    x, half = F.col(fp), F.shiftrightunsigned(fp, 1)
    low, high = x.bitwiseXOR(half).bitwiseAND(F.lit(_LOW)), x.bitwiseAND(half).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


def segment_counts(x: np.ndarray) -> np.ndarray:
    low = np.uint64(_LOW)
    half = x >> np.uint64(1)
    return ((x ^ half) & low) | (((x & half) & low) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two packed count vectors: a field of a ^ b is 0, 1, 2 or 3 for 0, 1, 2 or 1 counts apart."""
    x = a ^ b
    one = x & np.uint64(_LOW)
    two = (x >> np.uint64(1)) & np.uint64(_LOW) & ~one
    return np.bitwise_count(one).astype(np.int64) + 2 * np.bitwise_count(two)


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints differ in at most ``bits`` bits: the counts' bound first, the exact distance on what is left."""
    found = manhattan(segment_counts(x), segment_counts(y)) <= bits
    kept = np.flatnonzero(found)
    x, y = np.broadcast_arrays(x, y)
    found[kept] = np.bitwise_count(x[kept] ^ y[kept]) <= bits
    return found


def stars(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that join exactly what is linked among the distinct fingerprints ``x``."""
    left, members, roots = np.unique(x), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            hit = near(left, np.full(1, frontier.pop(), np.uint64), bits)
            if hit.any():
                new = left[hit]
                members.append(new)
                roots.append(np.full(len(new), root, np.uint64))
                frontier.extend(new)
                left = left[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _cells(bits: int, cell: int):
    """Over rows (key, fp) sorted by key: edges (null, a, b); the rows of cells that are too large as (key, fp, null)."""

    def pack(key, a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key) if key is not None else pa.nulls(n, pa.int64()),
                pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)) if b is not None else pa.nulls(n, pa.int64()),
            ],
            names=["key", "a", "b"],
        )

    def small(key, fp):
        same = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin = np.concatenate(([0], same))
        length = np.diff(np.concatenate((begin, [len(key)])))
        a, b = [], []
        few = length <= SMALL
        for k in range(1, SMALL):  # small cells: every pair, offset by offset
            has = few & (length > k)
            if not has.any():
                break
            sizes = length[has] - k
            at = np.repeat(begin[has], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ok = near(fp[at], fp[at + k], bits)
            a.append(fp[at][ok])
            b.append(fp[at + k][ok])
        for s, n in zip(begin[~few], length[~few], strict=True):
            x, y = stars(fp[s : s + n], bits)
            a.append(x)
            b.append(y)
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
                fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
                if not len(key):
                    continue
            if large is not None and len(key):  # the cell that was found too large goes on
                n = int(np.searchsorted(key, large, side="right"))
                if n:
                    yield pack(key[:n], fp[:n], None)
                    key, fp = key[n:], fp[n:]
                if len(key):
                    large = None
            if not len(key):
                continue
            done = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            if batch is not None and len(key) - done > cell:  # the last cell, not at its end, is too large already
                large = key[-1]
                yield pack(key[done:], fp[done:], None)
                key, fp, done = key[:done], fp[:done], done
            k, f = key[:done], fp[:done]
            key, fp = key[done:], fp[done:]
            if not len(k):
                continue
            begin = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
            length = np.diff(np.concatenate((begin, [len(k)])))
            over = np.repeat(length > cell, length)
            if over.any():
                yield pack(k[over], f[over], None)
                k, f = k[~over], f[~over]
            if len(k):
                a, b = small(k, f)
                if len(a):
                    yield pack(None, a, b)

    return each


def cells_near(e: Column, bits: int) -> Column:
    """The grid cells, by half, at a Manhattan distance of at most half of a half's share of ``bits`` from the counts ``e``.

    A cell is the half's sixteen counts, two bits each, and the number of the half above them.
    """
    reach = -(-(bits // HALVES) // 2)
    if not 0 <= reach <= 1:
        raise ValueError("the cells next to a point cover up to 5 bits")
    width = 64 // HALVES
    steps = F.array(*[F.lit(1 << s) for s in range(0, width, 2)]).cast("array<bigint>")
    out = []
    for half in range(HALVES):
        own = F.shiftrightunsigned(e, half * width).bitwiseAND(F.lit((1 << width) - 1))
        cells = F.array(own)
        if reach:
            field = lambda s: own.bitwiseAND(s * 3)  # noqa: B023, E731
            more = F.transform(F.filter(steps, lambda s: field(s) < s * 2), lambda s: own + s)  # noqa: B023
            less = F.transform(F.filter(steps, lambda s: field(s) > 0), lambda s: own - s)  # noqa: B023
            cells = F.concat(cells, more, less)
        out.append(F.transform(cells, lambda c: c + F.lit(half << width)))  # noqa: B023
    return F.concat(*out)


def links(fps: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) whose components are those of "differ in at most ``bits`` bits" over distinct ``fps`` (fp: long).

    No pair of linked fingerprints ends in two components; edges lead from a fingerprint to the smallest of its group in
    a cell, so their number doesn't grow with a group's square.
    """
    points = fps.select("fp", embedding("fp").alias("e"))
    rows = points.select(F.explode(cells_near(F.col("e"), bits)).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = keep(rows.mapInArrow(_cells(bits, cell), "key long, a long, b long"), "cells")
    edges = found.where("key is null").select("a", "b")
    hot = found.where("key is not null").select("key", F.col("a").alias("fp"))
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(cell / 2)).cast("int").alias("n"))
    chunked = hot.join(sizes, "key").select("key", "fp", "n", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("own"))
    paired = chunked.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        "key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    )

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = stars(pdf["fp"].to_numpy().view(np.uint64), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return edges.unionByName(paired.groupBy("key", "lo", "hi").applyInPandas(chunk, "a long, b long"))


def classes(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) of the distinct ``fps`` (fp); root: the same for all that ``edges`` (a, b) connect."""
    roots = keep(connected(edges), "roots")
    return fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, words: int = WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text; others ignored).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Texts with fewer words than a
    shingle have one shingle, the whole sequence. Repeated rows are each returned. A component's id is its smallest
    doc_id that isn't null. An empty table gives an empty result.
    """
    rows = keep(with_fingerprints(docs.select("doc_id", "text"), "text", "fp", words, seed).select("doc_id", "fp"), "fingerprints")
    by_fp = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    tagged = keep(classes(by_fp.select("fp"), links(by_fp.select("fp"), bits)).join(by_fp, "fp"), "tagged")
    ids = tagged.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keep(spread_join(tagged, ids, "root").select("fp", "component_id"), "named")
    return spread_join(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay if of each component only the one with the smallest doc_id does.

    Columns are those of ``docs``, whatever their names. Of rows equal in doc_id and text one stays; of those equal in
    doc_id alone the one with the smallest fingerprint. A null doc_id counts as the largest.
    """
    rows = keep(with_fingerprints(marked(docs), "text", "fp", words, seed).drop("text"), "fingerprints")
    fps = rows.select("fp").distinct()
    return first_of_each(docs, rows, classes(fps, links(fps, bits)))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 64-bit hash of the text by which a row is found again."""
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


def first_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first of their class: ``rows`` has (doc_id, hash, fp) of each, ``roots`` (fp, root).

    What stays is decided on those narrow tables. The texts are then filtered by it without a shuffle as long as Spark
    may broadcast the decisions, by their written size; only rows repeated with id and text are shuffled.
    """
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "fp", "hash", "n")
    by_fp = rows.groupBy("doc_id", "hash", "fp").agg(F.count("*").alias("n")).groupBy("fp").agg(F.min(order).alias("w"))
    best = by_fp.join(roots, "fp").groupBy("root").agg(F.min("w").alias("w"))
    own, mark, told = free_name(docs, "own"), free_name(docs, "mark"), free_name(docs, "told")
    best = keep(best.select(F.col("w.doc_id").alias(own), F.col("w.hash").alias(mark), F.col("w.n").alias("n")), "first")
    hashed = docs.withColumn(told, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(told) == F.col(mark))
    once = hashed.join(best.where("n = 1"), same, "left_semi")
    repeated = hashed.join(best.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", told])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
