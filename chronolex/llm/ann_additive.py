"""Approximate nearest neighbours by additive quantisation, with an exact second look.

Codebooks span the full dimension and each quantises what the ones before leave over; they are fitted on a bounded
sample. Every vector is encoded by a beam search over the codebooks and stored as one byte for each, with the length
of what the codes add up to. A query's inner products with all codewords are a table in which the codes look up their
scores. The best of each block by that score are scored exactly, in double precision, on the original vectors.

Queries and candidates are cut into blocks; a task holds one block of each, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.durable import keep

BOOKS, WORDS, BEAM = 16, 256, 4
#: At most so many vectors are used to fit the codebooks.
SAMPLE = 8192
#: Vectors of a candidate block and of a query block.
BLOCK, QUERY_BLOCK = 8192, 2048
#: Candidates of a block, for each query, that are scored exactly.
SHORTLIST = 320
NEAREST = 20
SEED = 5


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """(books, words, d) codebooks: k-means on the residuals in turn, then one least-squares refit of all codewords."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    out = np.zeros((books, words, d))
    left, codes = x.copy(), np.zeros((len(x), books), np.int64)
    for m in range(books):
        c = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            near = ((c * c).sum(1)[None] - 2 * left @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, near, left)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        near = ((c * c).sum(1)[None] - 2 * left @ c.T).argmin(1)
        out[m], codes[:, m] = c, near
        left = left - c[near]
    # refit: with the codes as one-hot rows B, all codewords together minimise |x - B C|
    codes, _ = encode(x, out)
    at = codes.astype(np.int64) + np.arange(books) * words
    gram, right = np.zeros((books * words, books * words)), np.zeros((books * words, d))
    for i in range(books):
        np.add.at(right, at[:, i], x)
        for j in range(books):
            np.add.at(gram, (at[:, i], at[:, j]), 1.0)
    old = out.reshape(-1, d)
    ridge = 1.0  # what no sample vector uses stays as it was
    gram[np.diag_indices_from(gram)] += ridge
    return np.linalg.solve(gram, right + ridge * old).reshape(books, words, d)


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) by beam search for the smallest squared error, and the lengths of the sums of codewords."""
    books, words, d = codebooks.shape
    flat = codebooks.astype(np.float32)
    norms = (flat * flat).sum(2)
    codes_all, lengths = np.zeros((len(x), books), np.uint8), np.zeros(len(x))
    for lo in range(0, len(x), 2048):
        part = x[lo : lo + 2048]
        n = len(part)
        left, error = part.astype(np.float32)[:, None, :], np.zeros((n, 1), np.float32)
        codes, row = np.zeros((n, 1, 0), np.int64), np.arange(n)[:, None]
        for m in range(books):
            width = left.shape[1]
            cost = (error[:, :, None] + norms[m] - 2 * (left.reshape(-1, d) @ flat[m].T).reshape(n, width, words)).reshape(n, -1)
            k = min(beam, cost.shape[1])
            kept = np.argpartition(cost, k - 1, axis=1)[:, :k]
            error = np.take_along_axis(cost, kept, 1)
            codes = np.concatenate([codes[row, kept // words], (kept % words)[:, :, None]], axis=2)
            left = left[row, kept // words] - flat[m][kept % words]
        chosen = codes[np.arange(n), error.argmin(1)]
        codes_all[lo : lo + n] = chosen
        lengths[lo : lo + n] = np.sqrt((codebooks[np.arange(books), chosen].sum(1) ** 2).sum(1))
    return codes_all, lengths


def _vectors(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, largest first, equal ones by index."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        # of those that tie at the edge the first ones
        at = np.sort(np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)])))
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")]


def _distinct(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``x`` without those that have ``most`` equal rows before them, in order.

    Equal vectors have equal scores and ties go to the smaller id, so no other row of theirs can be an answer, and a
    vector that is repeated very often can't fill a shortlist.
    """
    if len(x) <= most:
        return np.arange(len(x))
    rows = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, of = np.unique(rows, return_inverse=True)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[place < most])


def _search(codebooks: np.ndarray, shortlist: int, nearest: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """left: a candidate block (vec_id, codes, length, embedding); right: a query block (vec_id, embedding)."""
    columns = ["query_id", "vec_id", "score"]
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype=object), "score": pd.Series(dtype=object)})
    left = left.sort_values("vec_id", kind="stable")
    x, y = _vectors(left["embedding"]), _vectors(right["embedding"])
    few = _distinct(x, nearest + 1)
    left, x = left.iloc[few], x[few]
    ids = left["vec_id"].to_numpy()
    books, words, _ = codebooks.shape
    codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(-1, books)
    # a code sum of other length than its vector's is scaled to it
    stored = left["length"].to_numpy()
    scale = np.where(stored > 0, np.sqrt((x * x).sum(1)) / np.where(stored > 0, stored, 1), 0.0).astype(np.float32)
    tables = np.einsum("qd,mwd->qmw", y, codebooks).astype(np.float32)
    rows = []
    for q, table in zip(range(len(y)), tables, strict=True):
        rough = table[0][codes[:, 0]]
        for m in range(1, books):
            rough = rough + table[m][codes[:, m]]
        short = np.sort(best(rough * scale, shortlist + 1))
        short = short[ids[short] != right["vec_id"].iat[q]]
        exact = (x[short] * y[q]).sum(1)
        top = best(exact, nearest)
        rows.append((right["vec_id"].iat[q], ids[short][top], exact[top]))
    return pd.DataFrame(rows, columns=columns)


def search(table: DataFrame, queries: DataFrame, nearest: int = NEAREST, shortlist: int = SHORTLIST, block: int = BLOCK, query_block: int = QUERY_BLOCK, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the ``nearest`` rows of ``table`` for each of ``queries`` (vec_id, embedding).

    Nearness is the inner product in double precision; ties go to the smaller vec_id. A row is no candidate of a
    query with its vec_id. Vectors that are null, zero, hold null or non-finite components, or have another
    dimension than the most frequent one, take no part, nor do rows without a vec_id. Of usable rows that share a
    vec_id one takes part, in ``table`` as in ``queries``: the one whose vector comes first in the order of arrays.
    Other columns are ignored. Without usable rows the result is empty.
    """
    spark = table.sparkSession
    usable = F.coalesce(
        (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False)
    )
    clean = lambda df: df.where("vec_id is not null").where(usable).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows, asked = clean(table), clean(queries)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows, asked = rows.where(F.size("embedding") == sizes["d"]), asked.where(F.size("embedding") == sizes["d"])
    # min() over arrays: the rows of an id meet once, whole ids apart from each other
    single = lambda df: df.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows, asked = single(rows), single(asked)
    some = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    codebooks = fit_codebooks(_vectors(some["embedding"]), seed=seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, length = encode(_vectors(batch.column(1).to_numpy(zero_copy_only=False)), codebooks)
            arrays = [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "embedding", "codes", "length"])

    index = keep(rows.mapInArrow(coded, "vec_id long, embedding array<double>, codes binary, length double"), "codes")
    n, m = index.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    block_of = lambda k, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(k)).cast("int")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = index.withColumn("b", block_of(blocks, 1)).withColumn("q", spread(query_blocks))
    right = asked.withColumn("q", block_of(query_blocks, 2)).withColumn("b", spread(blocks))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(
        partial(_search, codebooks, shortlist, nearest), "query_id long, vec_id array<long>, score array<double>"
    )
    # a list for each query and block is short; their union is sorted and cut by query
    pairs = F.flatten(F.collect_list(F.arrays_zip("score", "vec_id")))
    first = F.slice(F.array_sort(F.transform(pairs, lambda p: F.struct((-p["score"]).alias("less"), p["vec_id"].alias("vec_id")))), 1, nearest)
    best_of = found.groupBy("query_id").agg(first.alias("top"))
    return best_of.select("query_id", F.posexplode("top").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.less")).alias("score")
    )
