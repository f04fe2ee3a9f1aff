"""Quality and toxicity models: held-out accuracy, identities of the scores, edge cases; the pipeline stage by stage."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import hard, real
from pyspark.sql import functions as F
from test_native import water_fill, word_count
from test_near_copies import fingerprint, least_edits, plain

import corpus_pipeline
from chronolex.llm import mixing, quality_fm, simhash_dedup, textarrays, toxicity_chain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return real(spark, SF)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    n = quality_fm.BUCKETS + quality_fm.STATS
    model = quality_fm.Model(0.5, 0.3, rng.normal(size=n), rng.normal(size=(n, 3)))
    x = np.zeros((1, n))
    at = rng.choice(n, 12, replace=False)
    x[0, at] = rng.normal(size=12)
    pairs = sum(model.v[i] @ model.v[j] * x[0, i] * x[0, j] for k, i in enumerate(at) for j in at[:k])
    assert model.raw(x)[0] == pytest.approx(0.3 + model.w @ x[0] + pairs)


def test_quality_on_held_out_rows(spark, docs, labels):
    got = quality_fm.quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc >= 0.97 and np.mean([r.predicted == r.quality for r in held]) >= 0.95


def test_quality_never_reads_ids_or_sources(spark, docs, labels):
    model = quality_fm.fit(docs, labels)
    a = {r.doc_id: r.score for r in quality_fm.scored(docs, model).collect()}
    other = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("yy").alias("source"), "n_chars")
    assert {r.doc_id - 10_000: r.score for r in quality_fm.scored(other, model).collect()} == a
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    flipped = labels.join(held.select("doc_id", F.lit(1).alias("h")), "doc_id", "left").select("doc_id", F.when(F.col("h") == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    assert {r.doc_id: r.score for r in quality_fm.scored(docs, quality_fm.fit(docs, flipped)).collect()} == a


def test_quality_edge_cases(spark, docs, labels):
    model = quality_fm.fit(docs, labels)
    rows = quality_fm.scored(hard(spark).withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == hard(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert next(r for r in rows if r.doc_id is None).held_out is False
    odd = docs.withColumn("_label", F.lit("x")).withColumn("_id", F.lit("y")).withColumn("label", F.lit("z"))
    same = lambda df: sorted((r.doc_id, r.score) for r in quality_fm.quality(df, labels).collect())
    assert same(odd) == same(docs)
    assert quality_fm.scored(docs.select("doc_id", "text"), model).count() == docs.count()
    assert quality_fm.quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_fm.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_words_hash_alike_in_any_batch():
    texts = ["Alpha beta  gamma", "beta", "", None, "x beta"]
    data, offsets = textarrays.flat(pa.array(texts))
    starts, ends, at = textarrays.word_spans(data, offsets)
    h = textarrays.word_hashes(data, starts, ends)
    assert list(np.diff(at)) == [3, 1, 0, 0, 2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 4
    p = textarrays.prefix_hashes(data, starts, ends, 4)
    assert p[0] != 0 and p[1] == 0 and p[2] != 0


def test_toxicity_on_unseen_labels(spark, docs, labels):
    known = labels.where("doc_id % 3 <> 0")
    rows = toxicity_chain.toxicity(docs, known).join(labels, "doc_id").where("doc_id % 3 = 0").select("doc_id", F.col("p_toxic"), labels["toxic"].alias("label")).collect()
    hit = [r for r in rows if r.label and r.p_toxic > 0.5]
    wrong = [r for r in rows if not r.label and r.p_toxic > 0.5]
    assert len(hit) >= 0.75 * sum(r.label for r in rows) and len(wrong) <= 0.03 * len(rows)


def test_toxicity_with_more_labels(spark):
    more = "/root/testdata/sf0.1"
    docs, labels = real(spark, more), spark.read.parquet(f"{more}/labels.parquet")
    rows = toxicity_chain.toxicity(docs, labels.where("doc_id % 3 <> 0")).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").where("doc_id % 3 = 0").collect()
    toxic, fine = [r.toxic for r in rows if r.label], [r.toxic for r in rows if not r.label]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(fine) <= 0.005 * len(fine)


def test_chain_reads_earlier_probabilities():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 6)) < 0.3).astype(np.uint16)
    first = x[:, 0] > 0
    second = first & (x[:, 1] > 0)
    chain = toxicity_chain.train(toxicity_chain.Chain(np.arange(6, dtype=np.uint64), ("a", "b")), x, np.column_stack([first, second]).astype(np.float32), np.arange(600) % 4)
    assert [len(w) for w, _ in chain.links] == [6, 7] and chain.links[1][0][6] != 0
    p = chain.probabilities(x)
    w, bias = chain.links[1]
    assert p[:, 1] == pytest.approx(toxicity_chain.logistic(x @ w[:6] + p[:, 0] * w[6] + bias))
    assert ((p[:, 0] > 0.5) == first).all()


def features(text):
    """Words and word beginnings of a text as Python strings, with their counts."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.findall(rb"[0-9a-zA-Z\x80-\xff]+", low)
    return collections.Counter([(0, w) for w in words] + [(k, w[:k]) for k in toxicity_chain.PREFIXES for w in words if len(w) > k])


def hash_of(feature):
    k, w = feature
    data = np.frombuffer(w + (b"x" if k else b""), np.uint8)
    at = np.array([0]), np.array([len(data)])
    return int(textarrays.prefix_hashes(data, *at, k)[0] if k else textarrays.word_hashes(data, *at)[0])


def test_the_chain_by_hand(spark, docs, labels):
    """The registered query's operator against a chain applied link by link to features counted in plain Python."""
    chain = toxicity_chain.fit(docs, labels)
    slot = {int(h): i for i, h in enumerate(chain.hashes)}
    some = {r.doc_id: r.text for r in docs.where("doc_id % 7 = 0").collect()}
    got = {r.doc_id: r for r in toxicity_chain.toxicity(docs, labels).collect()}
    for doc_id, text in some.items():
        x = np.zeros(len(slot))
        for f, n in features(text).items():
            if (at := slot.get(hash_of(f))) is not None:
                x[at] += n
        z, earlier = np.log2(1 + x), []
        for w, bias in chain.links:
            v = np.concatenate([z, earlier])
            earlier.append(1 / (1 + np.exp(-np.clip(float(v @ w + bias), -40, 40))))
        r = got[doc_id]
        assert [r.p_insult, r.p_coded, r.p_toxic] == pytest.approx(earlier, abs=1e-4) and r.toxic == (r.p_toxic > 0.5)


def test_a_fold_is_out_of_its_own_models():
    """Out-of-fold probabilities of one fold don't change with that fold's labels."""
    rng = np.random.default_rng(3)
    x = (rng.random((400, 8)) < 0.3).astype(np.uint16)
    y, fold = (x[:, :2] > 0).astype(np.float32), np.arange(400) % 4
    columns = [np.array([0, 1, 2, 3]), np.array([0, 1, 4]), np.arange(8), np.array([1, 2]), np.arange(6)]
    seen = []
    for flip in (False, True):
        labels = y.copy()
        if flip:
            labels[fold == 2, 0] = 1 - labels[fold == 2, 0]
        w, bias = toxicity_chain.linear(x[fold != 2][:, columns[2]].astype(np.float32), labels[fold != 2, 0])
        seen.append((w, bias))
        chain = toxicity_chain.train(toxicity_chain.Chain(np.arange(6, dtype=np.uint64)), x, labels, fold, columns=columns)
        assert [len(w) for w, _ in chain.links] == [6, 7]
    assert (seen[0][0] == seen[1][0]).all() and seen[0][1] == seen[1][1]


def test_copies_of_a_text_share_a_fold(spark, docs, labels):
    many = docs.where("doc_id < 40").unionByName(docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 5000))
    more = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 5000))
    rows = toxicity_chain.toxicity(many, more).collect()
    p = collections.defaultdict(set)
    for r in rows:
        p[r.doc_id % 5000].add(r.p_toxic)
    assert all(len(v) == 1 for v in p.values())


def test_toxicity_edge_cases(spark, docs, labels):
    odd = hard(spark).withColumn("p_toxic", F.lit("clash")).withColumn("_p_toxic", F.lit("clash"))
    rows = toxicity_chain.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and not any(r.toxic for r in rows)
    kept = toxicity_chain.not_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity_chain.toxicity(docs.limit(0), labels).count() == 0
    assert not any(r.toxic for r in toxicity_chain.toxicity(docs, labels.limit(0)).collect())


def near_copies(rows):
    """The ids that stay: the smallest of each group linked by four bits or by five-word shingles, all pairs compared."""
    ids = sorted(rows)
    prints = {d: fingerprint(rows[d]) for d in ids}
    sets = {}
    for d in ids:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[d]))
        sets[d] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            alike = min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and (n := len(x & y)) and n * 5 >= 4 * (len(x) + len(y) - n)
            if alike or (prints[a] ^ prints[b]).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {find(d) for d in ids}


def test_pipeline_stages(spark, docs, labels):
    """Each stage against what the operators' own results say about its input."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash near-dedup", "benchmark decontamination", "source mixing", "sharding"]
    now = docs.unionByName(docs.where("doc_id < 20"))
    for name, stage in corpus_pipeline.STAGES:
        out = simhash_dedup.keep(stage(spark, now, SF), "test")
        before, after = collections.Counter(r.doc_id for r in now.collect()), collections.Counter(r.doc_id for r in out.collect())
        assert after and set(after) <= set(before)
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity_chain.toxicity(now, labels).collect() if r.toxic}
            assert set(before) - set(after) == gone and all(after[k] == before[k] for k in after)
            some = {r.doc_id for r in labels.where("toxic = 1").collect()} & set(before)
            fine = {r.doc_id for r in labels.where("toxic = 0").collect()} & set(before)
            assert len(gone & some) >= 0.9 * len(some) and len(gone & fine) <= 0.01 * len(fine)
        if name == "simhash near-dedup":
            rows = {r.doc_id: r.text or "" for r in now.collect()}
            assert set(after.values()) == {1} and set(after) == near_copies(rows)
        if name == "benchmark decontamination":
            items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            texts = {r.doc_id: plain(r.text or "") for r in now.collect()}
            exact = {d for d, t in texts.items() if any(i in t for i in items)}
            gone = before.keys() - after.keys()
            assert exact and exact <= gone and all(after[k] == before[k] for k in after)
            for d in sorted(gone - exact)[:5]:
                assert any(least_edits(i, texts[d]) <= len(i) * 0.1 for i in items)
        if name == "source mixing":
            taken = collections.Counter()
            for r in mixing.mixed(now).collect():
                taken[r.doc_id] += r.times
            assert after == +taken
            words, aims = collections.Counter(), {}
            for r in now.collect():
                aims.setdefault(r.source, 0)
                aims[r.source] += word_count(r.text)
            for r in out.collect():
                words[r.source] += word_count(r.text)
            aims = water_fill(aims)
            assert all(abs(words[s] - aims[s]) <= 0.01 * aims[s] + 300 for s in aims)
        if name == "sharding":
            assert after == before and out.columns[: len(docs.columns)] == docs.columns
            slots = collections.defaultdict(list)
            for r in out.collect():
                slots[r.shard].append(r.slot)
            assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        now = out


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
