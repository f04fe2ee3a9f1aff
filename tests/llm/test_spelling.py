"""Spelling variants against edits tried one by one, automata against the words they hold."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import HARD, hard, real
from pyspark.sql import functions as F

from chronolex.llm import registry, spelling


def near(word, words):
    if len(word) > 1000:  # the one run of 120,000 letters has no partner
        assert not any(abs(len(v) - len(word)) < 2 for v in words.keys() - {word})
        return set()
    letters = {c for w in words for c in w}
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out & words.keys()) - {word}


def brute(rows, modulus=199, least_length=6, least_count=5):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    partner = {w: sorted(near(w, words), key=lambda v: (-words[v], v)) for w in words}
    form = {w: p[0] if p and words[p[0]] >= 5 * words[w] else None for w, p in partner.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(partner[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def typed(seed=3, stems=40):
    """Texts of words with misspellings of misspellings, doubled letters, accents and one half that very many words share."""
    rng = random.Random(seed)
    alphabet = "abcdeéà"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 13))) for _ in range(stems)]
    rows = []
    for w in words:
        rows += [w] * rng.choice([5, 30, 200])
        for _ in range(6):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]])
            rows += [v] * rng.choice([1, 5, 6])
    hot = ["prefix" + "".join(rng.choice("ab") for _ in range(rng.choice([5, 6]))) for _ in range(60)]
    rows += [w for w in set(hot) for _ in range(rng.choice([5, 6, 40]))]
    rows += ["chainword"] * 200 + ["chainwrd"] * 30 + ["chaiwrd"] * 6 + ["chaiwrdd"] * 6
    rng.shuffle(rows)
    return [(k, " ".join(rows[i : i + 50])) for k, i in enumerate(range(0, len(rows), 50))]


def test_against_all_edits(spark):
    rows = typed()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("word", F.lit(1)).withColumn("a.b", F.lit(1))
    got = result(spelling.variants(df))
    assert got == brute(rows) and any(r[1] for r in got) and any(r[2] != (r[1] or r[0]) for r in got)


def test_split_groups_and_small_blocks(spark):
    rows = typed(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        for most_words, cells in ((9, 300), (4, 1), (20, 10_000)):
            assert result(spelling.variants(df, most_words=most_words, cells=cells, held=10)) == brute(rows)
        # a group that is too large ends at any place of a batch
        words = spark.createDataFrame([(w, 5) for w in sorted({v for _, text in rows for v in text.split()})], "word string, n long")
        whole = sorted(map(tuple, spelling.near_words(words).collect()))
        for per in (1, 2, 3, 5, 11, 23):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per)
            assert sorted(map(tuple, spelling.near_words(words, most_words=9, cells=300).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_deletions_by_hash(spark):
    rows = typed(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.variants(df, modulus=3)) == brute(rows, modulus=3)


def test_hard_rows(spark):
    rows = [(r[0], r[1]) for r in HARD] * 6
    assert result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert spelling.variants(hard(spark).limit(0)).count() == 0


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in real(spark, sf_dir).select("doc_id", "text").collect()]
    assert result(registry.op12_spelling_variants(spark, sf_dir)) == brute(rows)


def test_automaton_numbers_its_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    letters = np.array(words).view(np.uint32).reshape(len(words), -1)
    a = spelling.Automaton(letters, np.array(list(map(len, words))), np.zeros(len(words), np.int64))
    for row, w in enumerate(words):
        state, number = a.root[:1], 0
        for c in w:
            state, before, where = a.step(state, np.array([ord(c)]))
            assert len(where) == 1
            number += int(before[0])
        assert a.final[state[0]] and number == row
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(a.final) == len(endings)  # minimal
