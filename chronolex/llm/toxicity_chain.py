"""Toxicity by a classifier chain: each category's linear model also reads the probabilities of the ones before it.

Features are the words of a text and the first bytes of its longer words, by 64-bit hash; the ones that tell toxic from
other labelled documents best are counted and chosen by Spark. In training, the earlier probabilities come out of fold:
a fold's probabilities are those of models, on features chosen and counted, that saw no document of the fold. Folds go
by text, so copies are in one. In scoring, the chain's links are applied in order.

``labels`` has one flag, toxic. The chain's first categories split it by evidence: ``insult`` if a toxic document has a
whole word that marks toxicity and is common among toxic documents, ``coded`` if it has only rarer words or beginnings
of words that do, as far as the documents of the other folds show. The last, ``toxic``, decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronolex.llm import textarrays as T
from chronolex.llm.durable import keep, plainly_named
from chronolex.llm.labelled import sample

CATEGORIES = ("insult", "coded", "toxic")
PREFIXES = (4, 6, 8)
#: At most so many label rows are used to fit, and so many features.
SAMPLE, FEATURES = 16_000, 768
#: A feature may be chosen if so many documents have it and at least so large a share of them is toxic; it marks toxicity
#: from the share MARK on, and is common if so large a share of the toxic documents has it.
SUPPORT, LEAST_SHARE, MARK, COMMON = 3, 0.3, 0.9, 0.1
FOLDS = 4
THRESHOLD = 0.5
SEED = 13


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and kind (0: whole word, 1: beginning) of all features, repeats included."""
    low = T.LOWER[data]
    starts, ends, at = T.word_spans(low, offsets, T.LETTERS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    owners, hashes, kinds = [owner], [T.word_hashes(low, starts, ends)], [np.zeros(len(owner), np.int8)]
    for k in PREFIXES:
        h = T.prefix_hashes(low, starts, ends, k)
        has = h != 0
        owners.append(owner[has])
        hashes.append(h[has])
        kinds.append(np.ones(int(has.sum()), np.int8))
    return np.concatenate(owners), np.concatenate(hashes), np.concatenate(kinds)


def _by_text(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = T.flat(batch.column(column))
    for lo, hi in T.passes(offsets):
        own = offsets[lo : hi + 1]
        yield lo, hi, *text_features(data[own[0] : own[-1]], own - own[0])


@dataclass
class Chain:
    """Sorted hashes of the features, and (weights, bias) of each category; the weights of the probabilities are last."""

    hashes: np.ndarray
    categories: tuple[str, ...] = CATEGORIES
    links: list[tuple[np.ndarray, float]] = field(default_factory=list)

    def __post_init__(self):
        # one bit for the top 20 bits of each hash lets most features go without a search
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.hashes >> np.uint64(44)] = True

    def slots(self, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        owner, hashes = owner[may], hashes[may]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        ok = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(at), bool)
        return owner[ok], at[ok]

    def matrix(self, n: int, owner: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """log2 of one more than the number of times that each text has each feature."""
        width = len(self.hashes)
        return np.log2(1 + np.bincount(owner * width + slot, minlength=n * width)).reshape(n, width).astype(np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        earlier = np.zeros((len(x), 0))
        for w, bias in self.links:
            p = logistic(x @ w[: x.shape[1]] + earlier @ w[x.shape[1] :] + bias)
            earlier = np.column_stack([earlier, p])
        return earlier


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def linear(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps, its bias from the share of ones; one class: the bias alone."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias, w = float(np.log(share / (1 - share))), np.zeros(x.shape[1], np.float32)
    if not len(y) or y.min() == y.max():
        return w, bias
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = (logistic(x @ w + bias) - y).astype(np.float32) / len(y)
        gw, gb = x.T @ g + ridge * w, float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w = w - (0.1 * (m / a) / (np.sqrt(v / b) + 1e-8)).astype(np.float32)
        bias -= 0.1 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias


def train(chain: Chain, counts: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS, columns: Sequence[np.ndarray] | None = None) -> Chain:
    """Fit the links on features, labels ``y`` (a column for each category) and the documents' folds.

    ``counts`` says how often each document has each feature. ``columns`` has the features that each fold's models may
    read, chosen without that fold, and last those of the chain itself.
    """
    columns = columns or [np.arange(counts.shape[1])] * (folds + 1)
    logs = np.log2(1 + np.arange(int(counts.max(initial=0)) + 1)).astype(np.float32)

    def inputs(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Features and earlier probabilities of some rows, in one array of their own."""
        out = np.empty((len(rows), len(of) + earlier.shape[1]), np.float32)
        for lo in range(0, len(rows), 2048):
            out[lo : lo + 2048, : len(of)] = logs[counts[np.ix_(rows[lo : lo + 2048], of)]]
        out[:, len(of) :] = earlier[rows]
        return out

    earlier = np.zeros((len(counts), 0), np.float32)
    for c in range(y.shape[1]):
        chain.links.append(linear(inputs(np.arange(len(counts)), columns[-1]), y[:, c]))
        out = np.zeros(len(counts), np.float32)
        for k in range(folds):
            own, other = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            w, bias = linear(inputs(other, columns[k]), y[other, c])
            out[own] = logistic(inputs(own, columns[k]) @ w + bias)
        earlier = np.column_stack([earlier, out])
    return chain


def _counts(some: DataFrame, folds: int) -> DataFrame:
    """hash, kind and, for each fold and as a last figure for all of them, how many texts have it and how many are toxic."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            fold = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, owner, hashes, kind in _by_text(batch, 1):
                order = np.lexsort((owner, hashes))
                h, o, k = hashes[order], owner[order], kind[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                h, o, k = h[new], o[new], k[new]
                if not len(h):
                    continue
                begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                own = fold[lo:hi][o]
                n = [np.add.reduceat((own == f).astype(np.int64), begin) for f in range(folds)]
                ones = [np.add.reduceat((own == f) * toxic[lo:hi][o], begin) for f in range(folds)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[begin].view(np.int64)), pa.array(k[begin].astype(np.int32)), *map(pa.array, n), *map(pa.array, ones)], names=["hash", "kind", *sums]
                )

    sums = [f"{c}{f}" for c in ("n", "ones") for f in range(folds)]
    found = some.mapInArrow(counted, "hash long, kind int, " + ", ".join(f"{c} long" for c in sums))
    return found.groupBy("hash").agg(F.min("kind").alias("kind"), *[F.sum(c).alias(c) for c in sums])


def _chosen(counts: DataFrame, said: Sequence[tuple[int, int]], features: int) -> pd.DataFrame:
    """The ``features`` best hashes by the counts outside each fold, and by all counts: hash, kind, without, ones, p."""
    folds = len(said)
    whole = [sum(v) for v in zip(*said, strict=True)]
    out = None
    for f in range(folds + 1):
        of = lambda c: sum((F.col(f"{c}{g}") for g in range(folds) if g != f), F.lit(0))  # noqa: B023, E731
        total, toxic = (w - (said[f][i] if f < folds else 0) for i, w in enumerate(whole))
        share = F.lit((toxic + 0.5) / (total + 1))
        n, ones = of("n"), of("ones")
        p = ones / n
        # signed log likelihood ratio of the feature's share of toxic documents against the share of all
        term = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
        gain = n * (term(p, share) + term(1 - p, 1 - share))
        best = counts.where((n >= SUPPORT) & (p >= LEAST_SHARE)).select(F.lit(f).alias("without"), "hash", "kind", ones.alias("ones"), p.alias("p"), gain.alias("gain"))
        best = best.orderBy(F.desc("gain"), "hash").limit(features)
        out = best if out is None else out.unionByName(best)
    table = out.toPandas()
    return table.assign(hash=table["hash"].to_numpy(np.int64).view(np.uint64)).sort_values(["without", "hash"])


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, features: int = FEATURES, seed: int = SEED, folds: int = FOLDS) -> Chain:
    """Learn the chain from at most ``most`` rows of ``labels`` (doc_id, toxic) and their ``docs`` (doc_id, text)."""
    some = sample(docs.select("doc_id", "text"), labels, "toxic", most, seed, "label")
    # copies of a text are in one fold
    some = keep(some.select("doc_id", "text", "label", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))), F.lit(folds)).cast("int").alias("fold")), "labelled")
    by_fold = {r["fold"]: (r["n"], r["ones"]) for r in some.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()}
    chosen = _chosen(keep(_counts(some, folds), "counts"), [by_fold.get(f, (0, 0)) for f in range(folds)], features)
    hashes = np.unique(chosen["hash"].to_numpy(np.uint64))
    everything = Chain(hashes)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, owner, found, _ in _by_text(batch, 1):
                own, slot = everything.slots(owner, found)
                x = np.bincount(own * len(hashes) + slot, minlength=(hi - lo) * len(hashes)).reshape(hi - lo, len(hashes))
                part = batch.slice(lo, hi - lo)
                slots = [np.flatnonzero(row) for row in x]
                lists = [pa.array([s.astype(np.int32) for s in slots], pa.list_(pa.int32())), pa.array([row[s].astype(np.int32) for row, s in zip(x, slots, strict=True)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *lists], names=["doc_id", "label", "fold", "slots", "values"])

    schema = T.schema_of(some, "doc_id", label="int", fold="int", slots="array<int>", values="array<int>")
    rows = some.mapInArrow(sparse, schema).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id", "slots", "values").limit(most).toPandas()
    x = np.zeros((len(rows), len(hashes)), np.uint16)
    for i, (slots, values) in enumerate(zip(rows["slots"], rows["values"], strict=True)):
        x[i, slots] = np.minimum(values, np.iinfo(np.uint16).max)
    toxic, fold = rows["label"].to_numpy(np.int64) > 0, rows["fold"].to_numpy(np.int64)
    whole, begun, columns = np.zeros(len(rows), bool), np.zeros(len(rows), bool), []
    for f in range(folds + 1):
        mine = chosen[chosen["without"] == f]
        at = np.searchsorted(hashes, mine["hash"].to_numpy(np.uint64))
        columns.append(at)
        marks = mine["p"].to_numpy(np.float64) >= MARK
        common = marks & (mine["kind"].to_numpy(np.int64) == 0) & (mine["ones"].to_numpy(np.int64) >= COMMON * toxic[fold != f].sum())
        own = np.flatnonzero((fold == f) & toxic)  # none for the last, whose features are the chain's
        whole[own] = (x[np.ix_(own, at[common])] > 0).any(axis=1)
        begun[own] = ~whole[own] & (x[np.ix_(own, at[marks])] > 0).any(axis=1)
    return train(Chain(hashes[columns[-1]]), x, np.column_stack([whole, begun, toxic]).astype(np.float32), fold, folds, columns)


def with_probabilities(docs: DataFrame, chain: Chain, names: Sequence[str], column: str = "text") -> DataFrame:
    """``docs`` and a column of each category's probability of the text in ``column``; null counts as empty."""
    text = docs.columns.index(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chain.probabilities(chain.matrix(hi - lo, *chain.slots(o, h))) for lo, hi, o, h, _ in _by_text(batch, text)]
            p = np.concatenate([np.zeros((0, len(names))), *parts]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(c)) for c in p.T]], names=[*batch.schema.names, *names])

    return docs.mapInArrow(each, StructType([*docs.schema.fields, *[StructField(c, DoubleType()) for c in names]]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category and toxic (boolean) of each row of ``docs`` (doc_id, text).

    Null and empty texts have the probabilities of a text without features. Repeated rows are each returned; other
    columns are ignored; an empty table gives an empty result. Without labels nothing is toxic.
    """
    names = [f"p_{c}" for c in CATEGORIES]
    out = with_probabilities(docs.select("doc_id", "text"), fit(docs, labels), names)
    return out.select("doc_id", *names, (F.col(names[-1]) > threshold).alias("toxic"))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with the columns of ``docs``."""
    names = [f"p_{c}" for c in CATEGORIES]
    plain = plainly_named(docs)
    out = with_probabilities(plain, fit(docs, labels), names, plain.columns[docs.columns.index("text")])
    return out.where(F.col(names[-1]) <= threshold).select(*plain.columns).toDF(*docs.columns)
