"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

The score of a document x is w0 + w.x + sum over i < j of (v_i . v_j) x_i x_j, through a logistic function. The
pairwise part is half of |sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2, so scoring takes time linear in the features. The
model is fitted on a bounded sample of labelled rows and sent to the tasks, which score whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronolex.llm import textarrays as T
from chronolex.llm.labelled import fold_of, sample

BUCKETS = 2048
FACTORS = 6
#: At most so many label rows are used to fit.
SAMPLE = 6000
SEED = 3
FOLDS, HELD_OUT = 3, 1
#: Texts of one numpy pass, which holds BUCKETS counts of each.
PASS_ROWS = 2048

_CLASSES = 9
_CLASS = np.zeros(256, np.int64)  # 0: other ASCII punctuation and control characters
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[0x20, 0x09, 0x0D, 0x0B, 0x0C]] = 4
_CLASS[0x0A] = 5
_CLASS[128:] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "#$%&*+<=>@^_`{|}~\\/[]"]] = 8
STATS = 17


def structure(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the counts of its lower-cased words by hash bucket, and STATS figures of its form and length."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    shares = np.bincount(owner * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(sizes, 1)[:, None]
    starts, ends, at = T.word_spans(data, offsets)
    counts = np.diff(at)
    word_owner = np.repeat(np.arange(n), counts)
    h = T.word_hashes(T.LOWER[data], starts, ends)
    words = np.bincount(word_owner * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    many = np.maximum(counts, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (word_owner[1:] == word_owner[:-1])
    per_word = lambda v: np.bincount(word_owner, weights=v, minlength=n) / many
    lengths = (ends - starts).astype(np.float64)
    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    figures = np.column_stack([
        shares, np.log1p(counts), per_word(lengths), per_word(same), words.max(1) / many, (words > 0).sum(1) / np.minimum(many, BUCKETS),
        per_word((last == 7) | (last == 8)), per_word(lengths == 1), np.log1p(np.maximum(n_chars, 0)),
    ])
    return words, figures


@dataclass
class Model:
    """Weights of the words, then of the standardised figures; ``prior`` alone where there was nothing to learn."""

    prior: float
    w0: float = 0.0
    w: np.ndarray | None = None
    v: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def features(self, words: np.ndarray, figures: np.ndarray) -> np.ndarray:
        present = (words > 0).astype(np.float32)
        present /= np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        return np.concatenate([present, np.clip((figures - self.mean) / self.spread, -4, 4).astype(np.float32) / np.sqrt(STATS)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        sums = x @ self.v
        return self.w0 + x @ self.w + 0.5 * (sums * sums - (x * x) @ (self.v * self.v)).sum(1)

    def score(self, words: np.ndarray, figures: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(figures), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.raw(self.features(words, figures)).astype(np.float64), -40, 40)))


def train(words: np.ndarray, figures: np.ndarray, label: np.ndarray, factors: int = FACTORS, rounds: int = 30, seed: int = SEED) -> Model:
    """Logistic loss by Adam over shuffled minibatches; one class alone or no row gives the smoothed share of ones."""
    prior = (float(label.sum()) + 1) / (len(label) + 2)
    if len(np.unique(label)) < 2:
        return Model(prior)
    model = Model(prior, mean=figures.mean(0), spread=np.maximum(figures.std(0), 1e-6))
    x, rng = model.features(words, figures), np.random.default_rng(seed)
    model.w0, model.w = float(np.log(prior / (1 - prior))), np.zeros(x.shape[1], np.float32)
    model.v = rng.normal(0, 0.05, (x.shape[1], factors)).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), model.w, model.v)]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            b, y = x[order[lo : lo + 256]], label[order[lo : lo + 256]]
            sums = b @ model.v
            raw = model.w0 + b @ model.w + 0.5 * (sums * sums - (b * b) @ (model.v * model.v)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y) / len(b)).astype(np.float32)
            gb = b * g[:, None]
            grads = [np.array([g.sum()]), gb.sum(0) + 1e-5 * model.w, gb.T @ sums - model.v * (b * gb).sum(0)[:, None] + 1e-4 * model.v]
            step += 1
            for k, grad in enumerate(grads):
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad * grad
                change = 0.02 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                if k == 0:
                    model.w0 -= float(change[0])
                elif k == 1:
                    model.w = model.w - change.astype(np.float32)
                else:
                    model.v = model.v - change.astype(np.float32)
    return model


def _figures(batch: pa.RecordBatch, text: int, chars: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = T.flat(batch.column(text))
    n_chars = batch.column(chars).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    n_chars = np.nan_to_num(n_chars, nan=0.0, posinf=0.0, neginf=0.0)
    for lo, hi in T.passes(offsets, rows=PASS_ROWS):
        own = offsets[lo : hi + 1]
        yield lo, hi, *structure(data[own[0] : own[-1]], own - own[0], n_chars[lo:hi])


def _with_metadata(docs: DataFrame) -> DataFrame:
    """The text and the one piece of metadata that may be an input, the recorded length (0 where there is none)."""
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(0.0)
    return docs.select("doc_id", "text", chars.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, seed: int = SEED) -> Model:
    """Learn ``labels.quality`` from documents whose id isn't held out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, figures in _figures(batch, 1, 2):
                lists = [pa.array([np.flatnonzero(w).astype(np.int32) for w in words], pa.list_(pa.int32())), pa.array(list(figures), pa.list_(pa.float64()))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), *lists], names=["doc_id", "label", "words", "figures"])

    train_labels = labels.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    some = sample(_with_metadata(docs), train_labels, "quality", most, seed, "label")
    rows = some.mapInArrow(each, T.schema_of(some, "doc_id", label="int", words="array<int>", figures="array<double>"))
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "figures").limit(most).toPandas()
    words = np.zeros((len(rows), BUCKETS), np.int8)
    for i, w in enumerate(rows["words"]):
        words[i, w] = 1
    figures = np.array(rows["figures"].tolist(), np.float64).reshape(len(rows), STATS)
    return train(words, figures, rows["label"].to_numpy(np.float64), seed=seed)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text, n_chars if there is one).

    Null text counts as empty and has a score like any other. A recorded length that is null, not a number or infinite
    counts as 0. Ids may have any type and keep it; a null id isn't held out. Repeated rows are each returned; other columns are ignored; an empty table gives an empty result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(words, figures) for _, _, words, figures in _figures(batch, 1, 2)]
            score = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    narrow = _with_metadata(docs)
    out = narrow.mapInArrow(each, StructType([narrow.schema["doc_id"], StructField("score", DoubleType())]))
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
