"""Documents whose sets of n-word shingles have a Jaccard similarity of at least 0.85, by T-occurrence search.

Two sets of that similarity share a number T of shingles that follows from their sizes, so they share one of the
first n - T + 1 shingles of each in any one order of all shingles: only the inverted lists of those have to be
merged, and the others, the longest ones, are probed. The order puts the most frequent shingles last.

Inverted lists meet in Spark by shingle. Texts of a list that stand bounds on their sizes and on their counts of shingles
by bin, which lose no link, are near; of a list's near texts a spanning forest is passed on, and its trees over all
lists are clusters. A cluster's whole texts meet in blocks, each text once by pair of blocks, and every near pair in it is
searched for: a query text over the inverted lists of its candidates. DivideSkip sets the longest lists aside, merges
the short ones by a heap, skips what can't reach the rest of T, and probes the long lists for what can. A first round
over a few shingles of each text settles the groups of near copies, the second one goes over all lists that hold texts
of different clusters.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm import textarrays as T
from chronolex.llm.components import connected, spread_join
from chronolex.llm.durable import keep
from chronolex.llm.shingle_links import _lists, _sign, shingles

WORDS = 4
#: Similarity of at least 85 / 100.
NUM, DEN = 85, 100
#: A shingle is frequent if more than one in FREQUENT of all prefix entries are it: there are fewer than FREQUENT.
FREQUENT = 1 << 15
#: Entries of a set's prefix by which texts meet in the first round.
FIRST = 3
#: Texts of a list that are held against each other at once; texts, and shingles in them, that make a block of a cluster.
CHUNK, MEMBERS, SHINGLES = 2048, 1024, 1 << 21
#: Prefix entries that a task counts at once.
ENTRIES = 1 << 22
#: Lists of up to so many texts give all their near pairs, not a forest of them.
SMALL = 16
#: Shingles by bin, at least: where texts meet in lists, and where whole sets meet in blocks.
LIST_SHARE, BLOCK_SHARE = 16, 2
#: Groups of text hashes by which texts are sorted out before they are joined by their ids: a bound on what is broadcast.
GROUPS = 1 << 20
#: Cells of bins that one numpy pass compares.
CELLS = 1 << 21
#: Long lists: T / (WEIGHT * log2(longest) + 1) of them.
WEIGHT = 0.04


def least_overlap(n, m):
    """Shingles that sets of ``n`` and ``m`` have to share."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_size(n):
    """Entries of which similar sets share one: n - ceil(0.85 n) + 1."""
    return np.where(n > 0, n - -(-NUM * n // DEN) + 1, 0)


def _heads(h: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` of each list's ``n`` entries in ``h``."""
    start = np.cumsum(n) - n
    return h[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _frequent_behind(h: np.ndarray, n: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists with the entries of the sorted array ``last`` behind the others, and how many others each has."""
    which = np.repeat(np.arange(len(n)), n)
    if not len(last) or not len(h):
        return h, n
    at = np.minimum(np.searchsorted(last, h), len(last) - 1)
    frequent = last[at] == h
    return h[np.lexsort((h, frequent, which))], n - np.bincount(which, weights=frequent, minlength=len(n)).astype(np.int64)


def _bins(h: np.ndarray, n: np.ndarray, share: int) -> list[bytes]:
    """Shingles of each text by bin, a power of two of at least n / ``share`` bins each; what two sets' bins differ by is at most
    what the sets differ by. A text with more than 255 shingles in a bin has no bins and stands every bound."""
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(n, 1) / share)).astype(np.int64))
    start = np.concatenate(([0], np.cumsum(1 << bits)))
    which = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(start[which] + (h >> (64 - bits[which]).astype(np.uint64)).astype(np.int64), minlength=int(start[-1]))
    most = np.maximum.reduceat(counts, start[:-1]) if len(n) else counts
    flat = np.minimum(counts, 255).astype(np.uint8)
    return [flat[start[k] : start[k + 1]].tobytes() if most[k] <= 255 else b"" for k in range(len(n))]


class Bins:
    """The bins of several texts, each with a number of its own; of two numbers the larger is folded to the smaller."""

    def __init__(self, bins: list[bytes]):
        self.width = np.fromiter(map(len, bins), np.int64, len(bins))
        self.start, self.flat = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(bins), np.uint8)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What the bins of texts ``i`` and ``j`` differ by, pair by pair; nothing if one has none."""
        out, both = np.zeros(len(i), np.int64), self.width[i] * (1 << 32) + self.width[j]
        for pair in np.unique(both).tolist():
            v, w = pair >> 32, pair & 0xFFFFFFFF
            if not v or not w:
                continue
            at, least = np.flatnonzero(both == pair), min(v, w)
            for lo in range(0, len(at), max(1, CELLS // max(v, w))):
                part = at[lo : lo + max(1, CELLS // max(v, w))]
                x, y = (self.flat[self.start[k[part]][:, None] + np.arange(m)].reshape(len(part), least, m // least).sum(axis=2, dtype=np.int32) for k, m in ((i, v), (j, w)))
                out[part] = np.abs(x - y).sum(axis=1)
        return out

    def near(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether sets ``i`` and ``j``, of ``n`` shingles by text, may be similar."""
        return self.apart(i, j) * (NUM + DEN) <= (n[i] + n[j]) * (DEN - NUM)


def _marks(words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, which in shingles(batch.column(1), words):
                n = np.bincount(which, minlength=hi - lo)
                size = prefix_size(n)
                size = np.minimum(n, size + size // 4)  # some more, in case frequent ones have to go behind
                own = batch.slice(lo, hi - lo)
                columns = [own.column(0), own.column(2), pa.array(_sign(h, which, n).view(np.int64)), pa.array(n), pa.array(_bins(h, n, LIST_SHARE), pa.binary()), _lists(_heads(h, n, size), size)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "sig", "n", "bins", "prefix"])

    return each


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, lo, hi, own, n, row, cluster, bins) sorted by (key, lo, hi, n): edges (a, b) of rows, for each list a
    spanning forest of its near texts, those of one cluster counting as joined. Short lists give all near pairs.

    A list cut into chunks comes once for each two of them, lo and hi; then only texts of different chunks are near.
    """

    def trees(lo, hi, own, n, row, cluster, bins, base) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, two = np.arange(len(n)), lo[0] != hi[0]
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                joined = cluster[left] == cluster[x]
                may = ~joined & (np.minimum(n[left], n[x]) * DEN >= np.maximum(n[left], n[x]) * NUM)
                if two:
                    may &= own[left] != own[x]
                at = np.flatnonzero(may)
                hit = at[bins.apart(base + left[at], np.full(len(at), base + x)) * (NUM + DEN) <= (n[left[at]] + n[x]) * (DEN - NUM)]
                if len(hit):
                    yield np.full(len(hit), row[x]), row[left[hit]]
                joined[hit] = True
                queue.extend(left[joined].tolist())
                left = left[~joined]

    held, held_bins = None, []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            held_bins.extend(batch.column(7).to_pylist())
        if held is None or not len(held[0]):
            continue
        change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
        done = len(held[0]) if batch is None else int(change[-1]) if len(change) else 0
        if not done:
            continue
        g, held = [c[:done] for c in held], [c[done:] for c in held]
        bins, held_bins = Bins(held_bins[:done]), held_bins[done:]
        begin = np.concatenate(([0], change[change < done]))
        size = np.diff(np.concatenate((begin, [done])))
        n, row, cluster = g[4], g[5], g[6]
        found = [(row[:0], row[:0])]
        end = np.repeat(begin + size, size)
        end[np.repeat(size > SMALL, size)] = 0
        for k in range(1, SMALL):  # short lists: every pair, offset by offset over all of them
            i = np.flatnonzero(end > np.arange(done) + k)
            if not len(i):
                break
            j = i + k
            may = (cluster[i] != cluster[j]) & (n[i] * DEN >= n[j] * NUM) & ((g[1][i] == g[2][i]) | (g[3][i] != g[3][j]))
            i, j = i[may], j[may]
            hit = bins.near(i, j, n)
            found.append((row[i[hit]], row[j[hit]]))
        for s, m in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            found.extend(trees(*[c[s : s + m] for c in g[1:]], bins, s))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        pairs = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def divide_skip(lists: list[list[int]], least: int, aside: int) -> list[tuple[int, int]]:
    """(id, occurrences) of what is in at least ``least`` of the sorted ``lists``, each without repeats.

    The ``aside`` longest lists are probed by binary search; the others are merged by a heap. An id that comes up fewer
    times than the short lists must give lets the lists skip ahead to the next id that still can.
    """
    lists = sorted((x for x in lists if x), key=len)
    aside = max(0, min(aside, least - 1, len(lists)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    need = least - aside
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    place, out = [0] * len(short), []
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            n = len(popped)
            for k, x in enumerate(long):
                if n + len(long) - k < least:
                    break
                at = _place(x, top, 0)
                n += at < len(x) and x[at] == top
            if n >= least:
                out.append((top, n))
            following = top + 1
        else:
            while len(popped) < need - 1 and heap:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            following = heap[0][0]
        for k in popped:
            place[k] = _place(short[k], following, place[k])
            if place[k] < len(short[k]):
                heapq.heappush(heap, (short[k][place[k]], k))
    return out


def _place(x: list[int], value: int, lo: int) -> int:
    """The first place from ``lo`` on whose id isn't below ``value``."""
    hi = len(x)
    while lo < hi:
        mid = (lo + hi) // 2
        if x[mid] < value:
            lo = mid + 1
        else:
            hi = mid
    return lo


def similar(query: np.ndarray, held: list[np.ndarray]) -> list[int]:
    """Which of ``held`` are similar to ``query``; all are sorted sets."""
    n, sizes = len(query), np.array([len(x) for x in held], np.int64)
    flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
    at = np.minimum(np.searchsorted(query, flat), n - 1)
    mine = query[at] == flat
    entry, who = at[mine], owner[mine]
    if len(held) == 1:
        return [0] if len(entry) >= least_overlap(n, int(sizes[0])) else []
    if not len(entry):
        return []
    order = np.argsort(entry, kind="stable")
    entry, who = entry[order], who[order].tolist()
    begin = np.flatnonzero(np.diff(entry, prepend=-1)).tolist()
    lists = [who[s:e] for s, e in zip(begin, [*begin[1:], len(who)], strict=True)]
    least = int(least_overlap(n, int(sizes.min())))
    aside = int(least / (WEIGHT * math.log2(max(2, max(map(len, lists)))) + 1))
    return [k for k, shared in divide_skip(lists, least, aside) if shared >= least_overlap(n, int(sizes[k]))]


def _searched(words: int):
    """Over rows (group, lo, hi, own, row, cluster, text) sorted by group, lo, hi and row: links (a, b) of rows that join what is similar.

    Texts of one cluster aren't compared, nor texts that links of this group join already. A group of two blocks compares
    texts of different ones. Repeated rows count once.
    """

    def links(lo, hi, own, row, cluster, sets) -> Iterator[tuple[int, int]]:
        m, n = len(sets), np.array([len(x) for x in sets], np.int64)
        bins = Bins(_bins(np.concatenate(sets), n, BLOCK_SHARE))
        tree = np.arange(m)
        for q in range(m - 1):
            rest = np.arange(q + 1, m)
            may = (tree[rest] != tree[q]) & (cluster[rest] != cluster[q]) & (np.minimum(n[rest], n[q]) * DEN >= np.maximum(n[rest], n[q]) * NUM)
            if lo != hi:
                may &= own[rest] != own[q]
            rest = rest[may]
            rest = rest[bins.near(rest, np.full(len(rest), q), n)]
            if not len(rest):
                continue
            for k in similar(sets[q], [sets[i] for i in rest]):
                i = int(rest[k])
                yield row[q], row[i]
                tree[tree == tree[i]] = tree[q]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, rows = None, []
        for batch in itertools.chain(batches, [None]):
            columns = [c.to_pylist() for c in batch.columns[:6]] if batch is not None else [[None]] * 6
            sets: list[np.ndarray] = []
            for lo, hi, h, which in shingles(batch.column(6), words) if batch is not None else ():
                sets.extend(np.split(h, np.cumsum(np.bincount(which, minlength=hi - lo))[:-1]))
            found: list[tuple[int, int]] = []
            for k, (group, lo, hi, own, row, cluster) in enumerate(zip(*columns, strict=True)):
                if (group, lo, hi) != asking or batch is None:
                    if rows:
                        o, r, c, x = zip(*rows, strict=True)
                        found.extend(links(asking[1], asking[2], np.array(o), r, np.array(c), list(x)))
                    asking, rows = (group, lo, hi), []
                if batch is not None and not (rows and rows[-1][1] == row):
                    rows.append((own, row, cluster, sets[k]))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return each


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


class Join:
    """The tables of one join: ``marks`` has each row's set in short, ``sets`` one row for each distinct set."""

    def __init__(self, docs: DataFrame, words: int):
        self.words, self.docs = words, _marked(docs)
        schema = T.schema_of(self.docs, "doc_id", hash="long", sig="long", n="long", bins="binary", prefix="array<long>")
        marks = self.docs.mapInArrow(_marks(words), schema).withColumn("row", F.monotonically_increasing_id())
        self.marks = keep(marks, "marks")
        self.sets = keep(self.marks.where("n > 0").groupBy("sig").agg(F.min("row").alias("row"), F.any_value("n").alias("n")), "sets")
        self.short = keep(self.marks.join(self.sets.select("row"), "row", "left_semi").select("row", "n", "bins", "prefix"), "short")
        self._frequent_last()

    def texts(self, rows: DataFrame) -> DataFrame:
        """``rows`` (row, further columns) with the text of each row; a text that ``docs`` has several times comes as often."""
        asked = self.marks.select("row", F.col("doc_id").alias("id"), F.col("hash").alias("mark")).join(rows, "row")
        asked = keep(asked, "asked")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("mark"))
        groups = F.broadcast(asked.select(F.pmod("mark", F.lit(GROUPS)).alias("some")).distinct())
        return self.docs.join(groups, F.pmod("hash", F.lit(GROUPS)) == F.col("some"), "left_semi").join(asked, same).drop("doc_id", "hash", "id", "mark")

    def _frequent_last(self) -> None:
        """Find the frequent shingles, fewer than FREQUENT, which every task knows, and the prefixes that need the text for them.

        Each task counts what is frequent among its own entries; those counts are summed. Which shingles count as frequent
        decides the order of all shingles, and so the work to be done, but not what is found.
        """

        def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for batch in itertools.chain(batches, [None]):
                if batch is not None:
                    held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
                if held and (batch is None or sum(map(len, held)) > ENTRIES):
                    keys, n = np.unique(np.concatenate(held), return_counts=True)
                    some = n > 2 + sum(map(len, held)) // (4 * FREQUENT)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(n[some])], names=["key", "n"])
                    held = []

        total = self.short.agg(F.sum(F.size("prefix"))).first()[0] or 0
        counts = self.short.select("prefix").mapInArrow(often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        frequent = [r.key for r in counts.where(F.col("n") * FREQUENT > total + FREQUENT * 8).select("key").collect()]
        self.frequent = F.broadcast(self.docs.sparkSession.createDataFrame([(k,) for k in frequent], "key long"))
        last = np.sort(np.array(frequent, np.int64).view(np.uint64))
        words = self.words

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, held = batch.column(1).to_numpy(zero_copy_only=False), pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                h, others = _frequent_behind(batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64), held, last)
                size = prefix_size(n)
                known = (others >= size) | (held == n)
                size = np.where(known, size, 0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(_heads(h, held, size), size)], names=["row", "n", "prefix"])

        def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, h, which in shingles(batch.column(1), words):
                    n = np.bincount(which, minlength=hi - lo)
                    size = prefix_size(n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), _lists(_heads(_frequent_behind(h, n, last)[0], n, size), size)], names=["row", "n", "prefix"])

        schema = "row long, n long, prefix array<long>"
        found = self.short.select("row", "n", "prefix").mapInArrow(each, schema)
        lacking = keep(found.where(F.size("prefix") == 0).select("row"), "lacking")
        more = keep(self.texts(lacking).select("row", "text").mapInArrow(by_text, schema).dropDuplicates(["row"]), "prefixes")
        self.prefixes = found.where(F.size("prefix") > 0).unionByName(more)

    def search(self, near_edges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links (a, b) among the clusters that ``near_edges`` (a, b) make, and those clusters as (row, cluster).

        Texts of one of the ``clusters`` of before are settled and not compared again. Clusters come in blocks of about
        MEMBERS texts or SHINGLES shingles, every two blocks as a group, so a text is read once for each block of its cluster.
        """
        joined = keep(connected(near_edges), "clusters").select(F.col("node").alias("row"), F.col("root").alias("group"))
        blocks = F.greatest(F.ceil(F.count("*") / F.lit(MEMBERS)), F.ceil(F.sum("n") / F.lit(SHINGLES))).cast("int")
        sizes = keep(joined.join(self.short.select("row", "n"), "row").groupBy("group").agg(blocks.alias("blocks")), "sizes")
        member = spread_join(joined, sizes, "group").join(clusters, "row", "left").withColumn("cluster", F.coalesce("cluster", "row"))
        member = _two_by_two(member, "blocks").select("row", "group", "lo", "hi", "own", "cluster")
        rows = self.texts(member).select("group", "lo", "hi", "own", "row", "cluster", "text")
        dealt = rows.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "row")
        return keep(dealt.mapInArrow(_searched(self.words), "a long, b long"), "links"), joined.withColumnRenamed("group", "cluster")

    def edges(self) -> DataFrame:
        """Rows (a, b) whose components are those of all similar sets."""
        none = self.docs.sparkSession.createDataFrame([], "row long, cluster long")
        first = self.prefixes.select(F.explode(F.slice("prefix", 1, FIRST)).alias("key"), "n", "row", F.lit(None).cast("long").alias("cluster"))
        linked, clusters = self.search(self._near(first), none)
        # most texts are in no cluster: those are sorted out by hash groups, and only the others meet the clusters by a shuffle
        group = F.pmod(F.xxhash64("row"), F.lit(GROUPS))
        groups = F.broadcast(clusters.select(group.alias("some")).distinct())
        some = self.prefixes.join(groups, group == F.col("some"), "left_semi").join(clusters, "row", "left")
        others = self.prefixes.join(groups, group == F.col("some"), "left_anti").withColumn("cluster", F.lit(None).cast("long"))
        rows = keep(some.unionByName(others), "clustered")
        left = self._near(rows.select(F.explode("prefix").alias("key"), "n", "row", "cluster"))
        if left.isEmpty():
            return linked
        more, _ = self.search(_with_settled(left, clusters), clusters)
        return linked.unionByName(more)

    def _near(self, entries: DataFrame) -> DataFrame:
        """Edges (a, b) that join what is near and not of one cluster in some list of ``entries`` (key, n, row, cluster)."""
        met = _two_by_two(keep(self._open(entries), "open"), "chunks")
        met = met.join(self.short.select("row", "bins"), "row").select("key", "lo", "hi", "own", "n", "row", "cluster", "bins")
        dealt = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n")
        return keep(dealt.mapInArrow(_forest, "a long, b long").distinct(), "near")

    def _open(self, entries: DataFrame) -> DataFrame:
        """The ``entries`` (key, n, row, cluster) of lists that hold texts of several clusters, and in how many chunks to take each list.

        A text without a cluster, null, is one by itself and gets its row as cluster here.

        Lists of frequent shingles may be of any length: what is open there is found by a grouping and known to every task.
        All others are short and go through one window.
        """
        own = F.coalesce("cluster", "row")
        which = [F.min("cluster").alias("least"), F.max("cluster").alias("most"), F.count("*").alias("size")]
        hot = entries.join(self.frequent, "key", "left_semi").withColumn("cluster", own)
        hot = hot.join(F.broadcast(hot.groupBy("key").agg(*which)), "key")
        w = Window.partitionBy("key")
        by_size = w.orderBy("n")
        # a text whose neighbours by size are too small and too large has no partner in the list
        partner = (F.coalesce(F.lag("n").over(by_size), F.lit(0)) * DEN >= F.col("n") * NUM) | (F.col("n") * DEN >= F.coalesce(F.lead("n").over(by_size), F.lit(1 << 40)) * NUM)
        rest = entries.join(self.frequent, "key", "left_anti").withColumn("partner", partner).withColumn("cluster", own)
        rest = rest.select("*", F.min("cluster").over(w).alias("least"), F.max("cluster").over(w).alias("most"), F.count("*").over(w).alias("size")).where("partner").drop("partner")
        return hot.unionByName(rest).where("least <> most").select("key", "n", "row", "cluster", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))


def _two_by_two(rows: DataFrame, parts: str) -> DataFrame:
    """Each row once for every two parts of its group that hold it: own is its part, lo and hi are the two, equal if there is one."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _with_settled(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """``edges`` and, for the ``clusters`` (row, cluster) that they touch, edges that hold each of those together."""
    touched = edges.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(clusters, "row").select("cluster").distinct()
    held = clusters.join(touched, "cluster", "left_semi").where("row <> cluster").select(F.col("cluster").alias("a"), F.col("row").alias("b"))
    return edges.unionByName(held)


def components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text; others ignored).

    Rows link if their sets of ``words``-word shingles are at least 0.85 similar; a component's id is its smallest doc_id
    that isn't null. A text of fewer words has one shingle, the whole sequence. Null, empty and blank texts have none and
    are linked with nothing: their component is their own doc_id. Repeated rows are each returned; an empty table gives
    an empty result.
    """
    join = Join(docs, words)
    linked = keep(connected(join.edges()), "roots").withColumnRenamed("node", "row")
    firsts = join.marks.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"))
    tagged = keep(join.sets.join(linked, "row", "left").select("sig", F.coalesce("root", "row").alias("root")).join(firsts, "sig"), "tagged")
    ids = tagged.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keep(spread_join(tagged, ids, "root").select("sig", "component_id"), "named")
    rows = join.marks.select("doc_id", F.col("n").alias("n_shingles"), "sig")
    full = spread_join(rows.where("n_shingles > 0"), named, "sig").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
