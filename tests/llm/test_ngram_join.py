"""The n-gram Jaccard join against all pairs of sets, its search against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import HARD, hard, real
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolex.llm import ngram_join, registry


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(text, n=4):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) by linking every pair."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def same(df, rows):
    assert sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == sorted(brute(rows), key=repr)


def near_copies(seed=5):
    """Groups around the threshold, chains, a passage that many texts share, texts made of common lines."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = []
    for _ in range(12):
        base = text(rng.choice([5, 8, 20, 60, 150]))
        for _ in range(rng.choice([2, 5, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w += text(rng.randrange(1, 3))
            out.append(" ".join(w))
    passage, lines = text(60), [" ".join(text(12)) for _ in range(6)]
    out += [" ".join(text(40) + passage + text(30)) for _ in range(40)]
    out += ["\n".join(rng.sample(lines, rng.randrange(1, 6))) for _ in range(60)]
    return [(k, t) for k, t in enumerate(out)]


def test_against_all_pairs(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(ngram_join.components(df), rows)


def test_same_with_frequent_shingles_and_small_chunks(spark, monkeypatch):
    rows = near_copies(8)
    monkeypatch.setattr(ngram_join, "FREQUENT", 1 << 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("a.b", F.lit(2))
    same(ngram_join.components(df), rows)
    monkeypatch.setattr(ngram_join, "FREQUENT", 20)
    monkeypatch.setattr(ngram_join, "CHUNK", 5)
    monkeypatch.setattr(ngram_join, "MEMBERS", 3)
    same(ngram_join.components(df), rows)


def test_frequent_shingles_are_put_last(spark, monkeypatch):
    rows = near_copies(9)
    monkeypatch.setattr(ngram_join, "FREQUENT", 400)

    join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    frequent = {r.key for r in join.frequent.collect()}
    assert frequent and join.prefixes.count() == join.short.count()
    for r in join.prefixes.collect():
        flags = [k in frequent for k in r.prefix]
        assert flags == sorted(flags)
        assert len(r.prefix) == r.n - -(-85 * r.n // 100) + 1


def test_hard_rows_and_types(spark):
    rows = [(r[0], r[1]) for r in HARD]
    same(ngram_join.components(hard(spark)), rows)
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = ngram_join.components(spark.createDataFrame([("b", "one two three four five"), ("a", "One two three four five")], "doc_id string, text string"))
    assert {r.component_id for r in got.collect()} == {"a"}


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in real(spark, sf_dir).select("doc_id", "text").collect()]
    same(registry.op13_ngram_join(spark, sf_dir), rows)


@pytest.mark.parametrize("share", [ngram_join.LIST_SHARE, ngram_join.BLOCK_SHARE])
def test_bins_bound_the_difference(share):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)) for n in (1, 2, 5, 40, 300, 301, 2500, 6000)]
    sets += [np.unique(np.concatenate((s[: len(s) * 4 // 5], rng.integers(0, 1 << 63, len(s) // 9 + 1, np.uint64)))) for s in sets] + [np.arange(300, dtype=np.uint64)]
    bins = ngram_join.Bins(ngram_join._bins(np.concatenate(sets), np.array(list(map(len, sets))), share))
    i, j = np.triu_indices(len(sets), 1)
    assert bins.width[-1] == 0  # 300 shingles in one bin: no bound
    assert (bins.apart(i, j) <= [len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), unique=True).map(sorted), min_size=1, max_size=9), st.integers(1, 6), st.integers(0, 6))
def test_divide_skip_counts_all(lists, least, aside):
    count = Counter(x for one in lists for x in one)
    assert sorted(ngram_join.divide_skip(lists, least, aside)) == sorted((k, n) for k, n in count.items() if n >= least)
