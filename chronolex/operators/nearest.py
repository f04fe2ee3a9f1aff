"""Pairs of queries and passages that an exact vector top-k can hold, found without ranking all pairs.

Both ways give query_id, the passages' columns but the vector, and the exact ``score`` (cosine, not rounded): at least the
first k of each query, also of scores that are within ``slack`` of each other, and few besides. ``by_blocks`` multiplies blocks of vectors,
``by_expressions`` does without Python.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions import vectors as V

#: Vectors of a block of passages and of queries at most, block pairs that smaller inputs are dealt out to, and passages that
#: one product takes.
PASSAGES, QUERIES, PAIRS, STEP = 16_384, 4_096, 32, 2_048
#: One of so many passages gives a query's first bound; components of a vector that are columns of their own.
SHARE, COLUMNS = 16, 64


class _Vectors:
    """The rows of a list column: values, ``unit`` (length one, zero where there is no cosine), length of each row and ``norm``."""

    def __init__(self, column: pa.ChunkedArray):
        whole = pa.concat_arrays([c.cast(pa.large_list(pa.float64())) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_list(pa.float64()))
        self.size = np.asarray(whole.value_lengths().fill_null(0), dtype=np.int64)
        flat = np.asarray(whole.flatten().fill_null(math.nan), dtype=np.float64)
        self.values = np.full((len(self.size), int(self.size.max(initial=0))), 0.0)
        self.values[np.arange(self.values.shape[1]) < self.size[:, None]] = flat
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_in_order(self.values, self.values))
            self.good = np.isfinite(self.norm) & (self.norm > 0)
            self.unit = np.where(self.good[:, None], self.values / self.norm[:, None], 0.0)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products by row, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(min(a.shape[1], b.shape[1])):
        total += a[:, d] * b[:, d]
    return total


def _kth(query: np.ndarray, score: np.ndarray, k: int, m: int) -> np.ndarray:
    """The k-th largest score of each of m queries; -inf where there are fewer."""
    order = np.lexsort((-score, query))
    at = np.searchsorted(query[order], np.arange(m)) + k - 1
    found = (at < len(order)) & (query[order][np.minimum(at, max(len(order) - 1, 0))] == np.arange(m)) if len(order) else np.zeros(m, bool)
    out = np.full(m, -math.inf)
    out[found] = score[order][at[found]]
    return out


def _of_blocks(p: _Vectors, q: _Vectors, p_id: np.ndarray, q_id: np.ndarray, k: int, slack: float, same_id: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both blocks and their scores (nan: no cosine): the first k of each query in this block, and what may tie with them."""
    width = min(p.unit.shape[1], q.unit.shape[1])
    alike = len(np.unique(np.concatenate((p.size, q.size)))) == 1 and p.good.all() and q.good.all()
    least, rows, columns, near = None, [], [], []
    for lo in range(0, len(p_id), STEP):
        s = p.unit[lo : lo + STEP, :width] @ q.unit[:, :width].T
        if not alike:
            s[(p.size[lo : lo + STEP, None] != q.size) | ~p.good[lo : lo + STEP, None] | ~q.good] = -math.inf
        if least is None:
            first = s if same_id else np.where(p_id[:STEP, None] == q_id, -math.inf, s)
            least = np.partition(first, len(first) - k, axis=0)[len(first) - k] if len(first) >= k else np.full(len(q_id), -math.inf)
        i, j = np.nonzero(s >= least - slack)
        if not same_id:
            other = p_id[i + lo] != q_id[j]
            i, j = i[other], j[other]
        rows.append(i + lo), columns.append(j), near.append(s[i, j])
    i, j, s = np.concatenate(rows), np.concatenate(columns), np.concatenate(near)
    kept = s >= _kth(j, s, k, len(q_id))[j] - slack
    i, j, s = i[kept], j[kept], s[kept]
    with np.errstate(all="ignore"):
        score = np.clip(_in_order(p.values[i, :width], q.values[j, :width]) / (p.norm[i] * q.norm[j]), -1.0, 1.0)
    score[~np.isfinite(s)] = math.nan
    # of equal scores, those with the smallest ids come first, so no more than k of them count
    order = np.lexsort((p_id[i], -score, j))
    i, j, score = i[order], j[order], score[order]
    same = np.concatenate(([False], (j[1:] == j[:-1]) & ((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))))[: len(j)]
    at = np.arange(len(j))
    first = at - np.maximum.accumulate(np.where(same, 0, at)) < k
    return i[first], j[first], score[first]


def by_blocks(queries: DataFrame, passages: DataFrame, k: int, slack: float, same_id: bool = False, most: int | None = None) -> DataFrame:
    """Blocks of passages against blocks of queries as matrix products; a task holds one of each, however many there are.

    Ids have to be integers. Both inputs are counted first, for the number of blocks; ``most`` passages save their count.
    """
    if not same_id:
        queries, passages = queries.where("query_id is not null"), passages.where("vec_id is not null")
    n, m = passages.select("vec_id").count() if most is None else most, queries.select("query_id").count()
    q_blocks = max(1, math.ceil(m / QUERIES))
    p_blocks = max(1, math.ceil(n / PASSAGES), min(math.ceil(n / STEP), math.ceil(PAIRS / q_blocks)))
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = passages.select("*", block("vec_id", p_blocks).alias("_p")).select("*", every(q_blocks).alias("_q"))
    right = queries.select("query_id", F.col("embedding").alias("_v"), block("query_id", q_blocks).alias("_q")).select("*", every(p_blocks).alias("_p"))
    carried = [c for c in passages.columns if c != "embedding"]
    empty = queries.select("query_id").limit(0).crossJoin(passages.select(*carried).limit(0)).withColumn("score", F.lit(0.0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)

    def near(p: pa.Table, q: pa.Table) -> pa.Table:
        if not len(p) or not len(q):
            i = j = np.zeros(0, np.int64)
            score = np.zeros(0)
        else:
            ids = [np.asarray(c.combine_chunks().fill_null(0), dtype=np.int64) for c in (p["vec_id"], q["query_id"])]
            i, j, score = _of_blocks(_Vectors(p["embedding"]), _Vectors(q["_v"]), *ids, k, slack, same_id)
        rows, of = p.select(carried).take(pa.array(i)), q.select(["query_id"]).take(pa.array(j))
        return pa.table([of["query_id"], *rows.columns, pa.array(score, from_pandas=True)], names=["query_id", *carried, "score"])

    return left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInArrow(near, schema)


def by_expressions(queries: DataFrame, passages: DataFrame, k: int, slack: float, same_id: bool = False, most: int | None = None) -> DataFrame:
    """The same by expressions alone: a sixteenth of the passages gives each query a bound, which other pairs have to reach.

    A query's k-th best of some passages is at most its k-th best of all, so nothing that counts is left out. Components
    are columns of their own, which saves arrays by pair. The queries are broadcast.
    """
    tasks = 4 * passages.sparkSession.sparkContext.defaultParallelism

    def prepared(rows: DataFrame, c: str, key: str) -> DataFrame:
        others = [x for x in rows.columns if x != "embedding"]
        rows = rows.withColumn(f"{c}_norm", V.norm(F.col("embedding")))
        good = V.is_finite(F.col("embedding")) & (F.col(f"{c}_norm") > 0)
        rows = rows.withColumn("_unit", F.when(good, F.transform("embedding", lambda x: x / F.col(f"{c}_norm")))).repartition(tasks, key)  # so that it is worked out once, not for each column
        parts = [F.coalesce(F.get("_unit", F.lit(i)), F.lit(0.0)).alias(f"{c}{i}") for i in range(COLUMNS)]
        rest = F.when(F.size("_unit") > COLUMNS, F.slice("_unit", COLUMNS + 1, 1 << 30)).alias(f"{c}_rest")
        return rows.select(*others, f"{c}_norm", F.col("embedding").alias(f"{c}_all"), F.coalesce(F.size("_unit"), F.lit(-1)).alias(f"{c}_size"), *parts, rest)

    p = prepared(passages, "_p", "vec_id")
    q = prepared(queries.select("query_id", "embedding"), "_q", "query_id")
    dot = F.col("_p0") * F.col("_q0")
    for i in range(1, COLUMNS):
        dot = dot + F.col(f"_p{i}") * F.col(f"_q{i}")
    dot = dot + F.when(F.col("_p_size") > COLUMNS, V.dot(F.col("_p_rest"), F.col("_q_rest"))).otherwise(0.0)
    comparable = (F.col("_p_size") == F.col("_q_size")) & (F.col("_p_size") > 0)
    other = F.lit(True) if same_id else F.col("query_id") != F.col("vec_id")
    some = p.where(F.pmod(F.xxhash64("vec_id"), F.lit(SHARE)) == 0).crossJoin(F.broadcast(q)).where(other & comparable).select("query_id", dot.alias("near"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near")))).where(F.col("rank") <= k)
    bounds = ranked.groupBy("query_id").agg(F.min("near").alias("_least"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    pairs = p.crossJoin(F.broadcast(q.join(bounds, "query_id", "left"))).where(other & (F.col("_least").isNull() | (comparable & (dot >= F.col("_least") - slack))))
    c = V.dot(F.col("_p_all"), F.col("_q_all")) / F.nullif(F.col("_p_norm") * F.col("_q_norm"), F.lit(0.0))
    score = F.when(c.isNotNull() & ~F.isnan(c), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))
    return pairs.select("query_id", *[x for x in passages.columns if x != "embedding"], score.alias("score"))
