"""Near copies by SimHash links and by a Jaccard similarity of five-word shingles of at least 0.8.

No Hamming radius bounds a Jaccard similarity, so similar texts meet on bands of least hashes instead: two texts share
each of a band's ROWS least hashes with the probability of their similarity, so of BANDS bands none is shared by texts
0.8 similar once in 1.4e9 times. A text has BANDS rows whatever its length, a passage that many texts share brings
together only those that it makes similar, and nothing depends on the size or a sample of the corpus. Pairs that meet
have to stand a bound on how far apart the counts of their shingles by bin may be; what is left is compared in full,
over whole texts.

Only connectivity is wanted: pairs that are connected already aren't compared. A group of more than GROUP texts on one
band is first held against PIVOTS of its texts; what they don't connect is then compared pair by pair, bins first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm import simhash_dedup
from chronolex.llm import textarrays as T
from chronolex.llm.components import connected
from chronolex.llm.durable import keep

WORDS = 5
#: Similarity of at least 4 / 5.
NUM, DEN = 4, 5
BANDS, ROWS = 40, 4
GROUP, PIVOTS = 8, 2
#: Bins over which the shingles of a text are counted, a power of two.
BINS = 128
#: Pairs that one numpy pass makes.
PAIRS = 1 << 18


def shingles(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges [lo, hi) of texts: distinct hashes, sorted in each text, and the text (from lo) each belongs to.

    Words are as in the fingerprints. A text of fewer words than a shingle has one, the whole sequence; a blank one none.
    """
    data, offsets = T.flat(texts)
    factors = T.powers(words + 1)
    for lo, hi in T.passes(offsets):
        part = T.LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, at = T.word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        w = T.word_hashes(part, starts, ends)
        counts = np.diff(at)
        n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        which = np.repeat(np.arange(hi - lo), n)
        begin = at[:-1][which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        h = np.zeros(len(which), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words):
                inside = begin + k < at[1:][which]
                h[inside] += T.mix(w[begin[inside] + k] + np.uint64(k + 1)) * factors[k + 1]
            h = T.mix(h)
        order = np.lexsort((h, which))
        h, which = h[order], which[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
        yield lo, hi, h[new], which[new]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _sign(h: np.ndarray, which: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for each whole set, whatever its order; none: zero."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = T.mix(np.add.reduceat(T.mix(h + np.uint64(0x9E37)), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64))
    return out


def _sketch(h: np.ndarray, which: np.ndarray, texts: int) -> np.ndarray:
    """How many shingles of each text fall in each of BINS bins, by their hashes."""
    counts = np.bincount(which * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=texts * BINS)
    return np.minimum(counts, np.iinfo(np.uint16).max).astype(np.uint16).reshape(texts, BINS)


def _bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BANDS keys of each text that has shingles; ``h`` are the shingles' hashes, ``n`` how many each text has."""
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    out = np.zeros((len(starts), BANDS), np.uint64)
    k = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        turn, times = T.mix(k * np.uint64(0x9E3779B97F4A7C15)), T.mix(k * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        for band in range(BANDS if len(starts) else 0):
            key = np.full(len(starts), band + 1, np.uint64)
            for i in range(band * ROWS, (band + 1) * ROWS):
                key = T.mix(key * times[0] + np.minimum.reduceat((h ^ turn[i]) * times[i], starts))
            out[:, band] = key
    return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (doc_id, text, hash): id and hash, the fingerprint, and of the shingle set its sig, size n, bins and band keys."""
    for batch in batches:
        fp = pa.array(simhash_dedup.fingerprints(batch.column(1)).view(np.int64))
        for lo, hi, h, which in shingles(batch.column(1)):
            n = np.bincount(which, minlength=hi - lo)
            own = batch.slice(lo, hi - lo)
            bins = pa.array([row.tobytes() for row in _sketch(h, which, hi - lo)], pa.binary())
            columns = [own.column(0), own.column(2), fp.slice(lo, hi - lo), pa.array(_sign(h, which, n).view(np.int64)), pa.array(n), bins, _lists(_bands(h, n).ravel(), BANDS * (n > 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "fp", "sig", "n", "bins", "keys"])


def _near(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles with the bins ``x`` and ``y`` may be similar.

    What the bins differ by is no more than what the sets differ by, which in similar sets is at most a ninth of both.
    """
    return np.abs(x.astype(np.int64) - y).sum(axis=-1) * (NUM + DEN) <= (n + m) * (DEN - NUM)


def _unpacked(bins: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bins.to_pylist()), np.uint16).reshape(-1, BINS)


def _pairs(every: bool):
    """Over rows (key, sig, root, n) sorted by key: pairs (null, a, b) that may be similar and aren't connected.

    Groups of more than GROUP rows give the pairs with their first PIVOTS rows and themselves as (key, sig, null). With
    ``every`` rows have their bins too and groups give all pairs that stand the bound on them.
    """

    def fits(g, i, j):
        sig, root, n = g[1:4]
        ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * DEN >= np.maximum(n[i], n[j]) * NUM)
        if every:
            i, j = np.broadcast_to(i, ok.shape)[ok], j[ok]
            ok = _near(n[i], n[j], g[4][i], g[4][j])
        a, b = np.broadcast_to(sig[i], ok.shape)[ok], sig[j][ok]
        return np.minimum(a, b), np.maximum(a, b)

    def group(g):
        size = len(g[0])
        by = np.argsort(g[3] if every else g[1], kind="stable")
        g = [c[by] for c in g]
        if every:  # by size, so that each row meets only those of up to 5 / 4 of its own
            end = np.searchsorted(g[3], g[3] * DEN // NUM, side="right")
            for i in range(size):
                for lo in range(i + 1, int(end[i]), PAIRS // BINS):
                    yield fits(g, np.int64(i), np.arange(lo, min(int(end[i]), lo + PAIRS // BINS)))
        elif size > GROUP:
            for p in range(PIVOTS):
                yield fits(g, np.int64(p), np.arange(p + 1, size))
        else:
            yield fits(g, *np.triu_indices(size, 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]] + ([_unpacked(batch.column(4))] if every else [])
                held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            key = held[0]
            done = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            rows, held = [h[:done] for h in held], [h[done:] for h in held]
            if not done:
                continue
            begin = np.concatenate(([0], np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1))
            length = np.diff(np.concatenate((begin, [done])))
            two = begin[length == 2]
            found, made = [fits(rows, two, two + 1)], 0
            for s, m in zip(begin[length > 2], length[length > 2], strict=True):
                for a, b in group([c[s : s + m] for c in rows]):
                    found.append((a, b))
                    made += len(a)
                    if made > PAIRS:
                        yield pack(found)
                        found, made = [], 0
                if m > GROUP and not every:
                    yield pa.RecordBatch.from_arrays([*[pa.array(rows[k][s : s + m]) for k in (0, 1)], pa.nulls(m, pa.int64())], names=["key", "a", "b"])
            if found:
                yield pack(found)

    def pack(found):
        ab = np.unique(np.column_stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.nulls(len(ab), pa.int64()), pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["key", "a", "b"])

    return each


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, n, m, x, y) the pairs whose bins x and y, of n and m shingles, are near enough for similar sets."""
    for batch in batches:
        n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        kept = pa.array(_near(n, m, _unpacked(batch.column(4)), _unpacked(batch.column(5))))
        yield pa.RecordBatch.from_arrays([c.filter(kept) for c in batch.columns[:2]], names=["a", "b"])


def _similar(docs: DataFrame, marks: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The fingerprints (a, b) of those ``pairs`` of shingle sets that are similar, compared over the whole texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, which in shingles(batch.column(0)):
                n = np.bincount(which, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(_sign(h, which, n).view(np.int64)), _lists(h, n)], names=["sig", "set"])

    named = lambda pairs, name: keep(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(sets, "sig"), name)
    bins = marks.select("row", "bins").join(named(pairs, "asked").select("sig", "row", "n"), "row")
    of = lambda *names: bins.select(*[F.col(c).alias(d) for c, d in zip(("sig", "n", "bins"), names, strict=True)])
    near = pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    pairs = keep(near.mapInArrow(_may_be_similar, "a long, b long"), "near")
    asked = named(pairs, "asked")
    own = keep(marks.select("row", "doc_id", "hash").join(asked, "row").select(F.col("doc_id").alias("own"), F.col("hash").alias("mark")), "own")
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("mark"))
    held = simhash_dedup.marked(docs).join(own, same, "left_semi").select("text")
    whole = held.mapInArrow(each, "sig long, set array<long>").dropDuplicates(["sig"])
    whole = keep(whole.join(asked.select("sig", "node"), "sig"), "shingles")
    left = whole.select(F.col("sig").alias("a"), F.col("set").alias("x"), F.col("node").alias("fa"))
    right = whole.select(F.col("sig").alias("b"), F.col("set").alias("y"), F.col("node").alias("fb"))
    both = pairs.join(left, "a").join(right, "b")
    alike = F.size(F.array_intersect("x", "y")) * (NUM + DEN) >= (F.size("x") + F.size("y")) * NUM
    return both.where(alike).select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def _classes(docs: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """(fp, root) of the fingerprints of ``marks``; root: the same for all that are linked by bits or by shingles."""
    fps = marks.select("fp").distinct()
    of = lambda roots: fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    # one row stands for each set of shingles; what is long stays in ``marks`` and is looked up by the row's number
    sets = keep(marks.where("n > 0").groupBy("sig").agg(F.min("fp").alias("node"), F.min("row").alias("row"), F.any_value("n").alias("n")), "sets")
    # a set can have several fingerprints; they are linked, so any of them stands for the set
    same = marks.select("fp", "sig").distinct().join(sets.select("sig", "node"), "sig").where("fp <> node").select(F.col("fp").alias("a"), F.col("node").alias("b"))
    edges = keep(simhash_dedup.links(fps, bits).unionByName(same), "links")
    large = roots = None
    for every in (False, True):
        # the first time round nothing is connected yet, the second time most is
        rooted = (sets.withColumn("root", F.col("node")) if roots is None else sets.join(of(roots).withColumnRenamed("fp", "node"), "node")).select("row", "sig", "root", "n")
        if large is None:
            rows = marks.select("row", "keys").join(rooted, "row").select(F.explode("keys").alias("key"), "sig", "root", "n")
        else:
            # groups whose texts are all connected by now have nothing left to compare
            large = large.join(rooted, "sig")
            open_ = large.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
            rows = large.join(open_, "key", "left_semi").join(marks.select("row", "bins"), "row").select("key", "sig", "root", "n", "bins")
        rows = rows.repartition("key").sortWithinPartitions("key")
        found = keep(rows.mapInArrow(_pairs(every), "key long, a long, b long"), "found")
        pairs = keep(found.where("key is null").select("a", "b").distinct(), "pairs")
        edges = edges if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        if roots is None or not pairs.isEmpty():
            roots = keep(connected(edges.unionByName(_similar(docs, marks, sets, pairs))), "roots")
        large = found.where("key is not null").select("key", F.col("a").alias("sig"))
        if every or large.isEmpty():
            break
    return of(roots)


def deduplicated(docs: DataFrame, bits: int = simhash_dedup.BITS) -> DataFrame:
    """The rows of ``docs`` that stay if of each group of near copies only the one with the smallest doc_id does.

    Texts are near copies if their fingerprints differ in at most ``bits`` bits or their sets of five-word shingles are
    at least 0.8 similar; groups are the components of that. Columns, repeated rows and null ids are treated as in
    ``simhash_dedup.deduplicated``.
    """
    texts = docs.select("doc_id", "text")
    marked = simhash_dedup.marked(texts)
    schema = T.schema_of(marked, "doc_id", hash="long", fp="long", sig="long", n="long", bins="binary", keys="array<long>")
    marks = keep(marked.mapInArrow(_marks, schema).withColumn("row", F.monotonically_increasing_id()), "marks")
    return simhash_dedup.first_of_each(docs, marks.select("doc_id", "hash", "fp"), _classes(texts, marks, bits))
