import random

import numpy as np
import pyarrow as pa
from helpers import hard, pairs, real

import corpus_pipeline
from chronolex.llm import shingle_links, simhash_dedup


def five(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def alike(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    """Smallest id of each component, all pairs compared; rows: (doc_id, text) with distinct ids."""
    rows = sorted(rows)
    fps, sets = simhash_dedup.fingerprints(pa.array([t for _, t in rows], pa.string())), [five(t) for _, t in rows]
    left, out = set(range(len(rows))), []
    for i in range(len(rows)):
        if i not in left:
            continue
        out.append(rows[i][0])
        left.discard(i)
        frontier = [i]
        while frontier:
            k = frontier.pop()
            hit = [j for j in left if np.bitwise_count(fps[k] ^ fps[j]) <= 4 or alike(sets[k], sets[j])]
            left -= set(hit)
            frontier += hit
    return sorted(out)


def variants(seed, n, words, changes):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for at in draw.sample(range(words), draw.randint(*changes)):
            w[at] = f"x{draw.randrange(10**9)}"
        yield " ".join(w)


def test_stage_finds_similar_texts_beyond_four_bits(spark):
    rows = list(enumerate(variants(1, 40, 120, (2, 2))))
    fps = simhash_dedup.fingerprints(pa.array([t for _, t in rows]))
    far = [(i, j) for i in range(40) for j in range(i) if alike(five(rows[i][1]), five(rows[j][1])) and np.bitwise_count(fps[i] ^ fps[j]) > 4]
    assert far
    i, j = far[0]
    docs = spark.createDataFrame([rows[i], rows[j], (77, "something else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted([min(i, j), 77])


def test_groups_match_all_pairs(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in real(spark, sf_dir).collect()]
    made = [*variants(2, 150, 200, (0, 9)), *variants(3, 50, 60, (0, 3)), *variants(4, 40, 30, (0, 1)), *variants(5, 9, 4, (0, 1))]
    made += [t.upper() + " end" for t in made[:20]]
    rows += [(100_000 + i, t) for i, t in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    for group in (shingle_links.GROUP, 3):
        monkeypatch.setattr(shingle_links, "GROUP", group)
        assert sorted(r.doc_id for r in shingle_links.deduplicated(docs).collect()) == want


def test_rows_stay_as_by_fingerprints(spark):
    docs = hard(spark)
    got = shingle_links.deduplicated(docs)
    assert got.columns == docs.columns and pairs(got, *got.columns) == pairs(simhash_dedup.deduplicated(docs), *docs.columns)
    assert shingle_links.deduplicated(docs.limit(0)).count() == 0
