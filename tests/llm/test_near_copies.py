"""SimHash, decontamination, nearest neighbours and token counts against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import HARD, hard, real
from pyspark.sql import functions as F

from chronolex.llm import ann_additive, components, decontaminate, registry, simhash_dedup, token_count

# --- simhash


def fingerprint(text, words=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(values, bits=4):
    """Root (smallest index) of each value by linking every pair."""
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(60)) for _ in range(120)) for _ in range(25)]
    out = []
    for k, t in enumerate(base):
        for _ in range(4):
            w = t.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            out.append((k * 100 + len(out), " ".join(w)))
    return out


def test_fingerprints(spark):
    texts = [t for _, t, *_ in HARD]
    assert [int(x) for x in simhash_dedup.fingerprints(pa.array(texts))] == [fingerprint(t) for t in texts]


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    near = simhash_dedup.manhattan(simhash_dedup.segment_counts(x), simhash_dedup.segment_counts(y))
    assert (near <= np.bitwise_count(x ^ y)).all()
    plain = lambda v: np.array([[bin(int(v) >> s & 3).count("1") for s in range(0, 64, 2)] for v in v])
    assert (near == np.abs(plain(x) - plain(y)).sum(1)).all()


def test_near_points_share_a_cell(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x.view(np.int64), y.view(np.int64), strict=True)], "x long, y long")
    cells = lambda c: simhash_dedup.cells_near(simhash_dedup.embedding(c), 4)
    both = df.select(cells("x").alias("a"), cells("y").alias("b")).select("a", F.size(F.array_intersect("a", "b")).alias("shared")).collect()
    assert all(r.shared for r in both) and all(len(set(r.a)) == len(r.a) <= 66 for r in both)
    with pytest.raises(ValueError):
        simhash_dedup.cells_near(F.col("x"), 6)


def test_spread_join_of_a_hot_key(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = components.spread_join(left, right, "k")
    assert got.count() == 5000 and got.where("v <> k * 2").count() == 0


def test_components_match_all_pairs(spark, sf_dir):
    docs = spark.createDataFrame(near_texts(), "doc_id long, text string").unionByName(real(spark, sf_dir).select((F.col("doc_id") + 100_000).alias("doc_id"), "text")).unionByName(hard(spark).select((F.col("doc_id") + 900_000).alias("doc_id"), "text"))
    rows = docs.collect()
    values = [fingerprint(r.text) for r in rows]
    root = classes(values)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root[i]] = min(ids.get(root[i], r[0]), r[0])
    want = sorted(((r[0], f"{v:016x}", ids.get(root[i])) for i, (r, v) in enumerate(zip(rows, values, strict=True))), key=repr)
    got = simhash_dedup.components(docs.withColumn("fp", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({i for *_, i in want}) < len(want)
    assert simhash_dedup.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [4096, 12])
def test_large_cells_lose_no_link(spark, cell):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flip = lambda v: v ^ (np.uint64(1) << rng.integers(0, 64, len(v), dtype=np.uint64))
    x = np.unique(np.concatenate([centres, *[flip(centres) for _ in range(3)], *[flip(flip(flip(centres[:3]))) for _ in range(60)]]))
    want = classes([int(v) for v in x])
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components.connected(simhash_dedup.links(df, 4, cell)).collect()}
    groups = {}
    for v, w in zip(x.view(np.int64), want, strict=True):
        groups.setdefault(w, []).append(int(v))
    assert {k: got.get(k, k) for k in map(int, x.view(np.int64))} == {v: min(g) for g in groups.values() for v in g}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected(chain).collect()}
    assert got == {i: 0 for i in range(201)}


def test_deduplicated_keeps_one_of_each(spark):
    docs = hard(spark).withColumn("_fp", F.lit(1)).withColumn("component_id", F.lit(2))
    got = simhash_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(kept, key=repr) == sorted([1, 2, 6, 7, 8, 9, None], key=repr)  # 5 is a copy of 1; 3 and 4 are as empty as 2
    assert simhash_dedup.deduplicated(docs.limit(0)).count() == 0


# --- decontamination


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text)
    return re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", low).strip().encode()


def least_edits(item, text):
    """Fewest edits that turn ``item`` into some part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != text[j - 1]))
    return min(row)


def test_decontamination_matches_full_alignment(spark, sf_dir):
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:12] + ["tiny", "", "exactly twenty bytes", "Ünïcode tèxt with Ñ and ß that is long enough, really"]
    items = decontaminate.Items(list(range(len(bench))), bench)
    rng = random.Random(5)
    texts = []
    for r in range(60):
        u = list(plain(bench[r % 12] if r % 7 else bench[14]).decode())
        for _ in range(rng.choice([0, 1, 6, 12, 20, 30])):
            p = rng.randrange(len(u))
            u[p : p + rng.choice([0, 1, 1])] = rng.choice(["", "q", "zz"])
        texts.append("Some words before, " * rng.randrange(3) + "".join(u).upper() + " and after. " * rng.randrange(3))
    texts += ["tiny", "Not tiny? no!", "tinytiny", "exactly twenty bytes", "Say: exactly twentY bites or so", ""]
    found = {(d, int(items.ids[i])): e for d, i, e in items.search(pa.array(texts))}
    want = {}
    for k, t in enumerate(items.texts):
        for d, text in enumerate(texts):
            own = plain(text)
            if 0 < len(t) < decontaminate.SHORT:
                if b" " + t.tobytes() + b" " in b" " + own + b" ":
                    want[d, int(items.ids[k])] = 0
            elif len(t) and (e := least_edits(t.tobytes(), own)) <= int(len(t) * decontaminate.EDITS):
                want[d, int(items.ids[k])] = e
    assert found == want and len(want) > 20


def test_decontamination_reports_the_least_edits():
    item = "the quick brown fox jumps over a lazy dog near the river"
    three, two = item.replace("quick", "quack").replace("jumps", "jomps").replace("river", "rover"), item.replace("lazy", "hazy").replace("near", "neer")
    items = decontaminate.Items([1], [item])
    assert items.search(pa.array([f"{three} and later {two}", f"{two} {item} {three}"])) == [(0, 0, 2), (1, 0, 0)]


def test_decontamination_of_repeated_lines():
    """Many items that share a line, and a document that is that line over and over, stay cheap; hits are cut by number."""
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    line = words(6)
    bench = [f"{line} {words(12)}" for _ in range(60)]
    items = decontaminate.Items(list(range(60)), bench)
    text = f"{line}\n" * 300 + f"{bench[7]}\n" + f"{line}\n" * 300
    began = time.time()
    assert items.search(pa.array([text, line])) == [(0, 7, 0)] and time.time() - began < 10


def test_hits_cut_anywhere_find_the_same(monkeypatch):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))
    bench = [words(12) for _ in range(20)]
    texts = pa.array([words(30) + " " + rng.choice(bench) + " " + words(30) for _ in range(20)])
    want = sorted(decontaminate.Items(list(range(20)), bench).search(texts))
    monkeypatch.setattr(decontaminate, "HITS", 50)
    monkeypatch.setattr(decontaminate, "CELLS", 500)
    assert sorted(decontaminate.Items(list(range(20)), bench).search(texts)) == want and len(want) >= 20


def test_decontamination_tables(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(None, "x" * 50), (77, None)], "item_id long, text string"))
    leak = bench.where("item_id = 3").first().text
    docs = hard(spark).unionByName(spark.createDataFrame([(50, f"Before. {leak.upper()} After.", "en", "a", 1), (51, leak[: len(leak) // 2], "en", "a", 1), (50, leak, "en", "a", 1)], hard(spark).schema))
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminations(docs, bench).collect())
    assert got == [(50, 3, 0), (50, 3, 0)]
    few = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminations(docs, bench, slice_bytes=500).collect())
    assert few == got
    kept = decontaminate.clean(docs.withColumn("item_id", F.lit("clash")), bench)
    assert kept.columns[-1] == "item_id" and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in docs.collect() if r.doc_id != 50), key=repr)
    assert decontaminate.contaminations(docs.limit(0), bench).count() == 0 and decontaminate.contaminations(docs, bench.limit(0)).count() == 0


def test_decontamination_query_both_ways(spark, sf_dir):
    """The registered query: every exact passage is found, and what is found stands a full alignment."""
    docs, bench = real(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, items = {r.doc_id: plain(r.text or "") for r in docs.collect()}, {r.item_id: plain(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in registry.QUERIES["op5_decontaminate"](spark, sf_dir).collect()}
    assert {(d, i) for d, text in rows.items() for i, item in items.items() if item in text} <= got.keys() and got
    for (d, i), e in got.items():
        assert e <= int(len(items[i]) * decontaminate.EDITS)
        if e == 0:
            assert items[i] in rows[d]
        elif len(rows[d]) < 3000:
            assert e == least_edits(items[i], rows[d])
    # no document without a hit comes near an item: three 8-byte pieces apart from each other would have to be missing
    few = [d for d in sorted(rows) if d not in {k for k, _ in got} and len(rows[d]) < 900][:12]
    for d in few:
        for i, item in list(items.items())[:6]:
            assert least_edits(item, rows[d]) > int(len(item) * decontaminate.EDITS)


# --- nearest neighbours


def exact(ids, x, q, k=20):
    s = (x * x[q]).sum(1)
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), s[i]) for i in order]


def test_search_recall_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("codes", F.lit("clash"))
    got = {}
    for r in ann_additive.search(table, table.where("vec_id % 20 = 0"), block=128, query_block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    hit = total = 0
    for q in (i for i in range(len(ids)) if ids[i] % 20 == 0):
        mine = got[int(ids[q])]
        assert [r for *_, r in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        for v, s, _ in mine:
            assert s == pytest.approx(float(x[list(ids).index(v)] @ x[q]), abs=1e-12)
        hit += len({v for v, *_ in mine} & {v for v, _ in exact(ids, x, q)})
        total += 20
    assert hit / total >= 0.9


def test_search_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [0.5, 0.5]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann_additive.search(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 6, 1.0), (1, 2, 7, 0.5), (6, 1, 1, 1.0), (6, 2, 7, 0.5), (7, 1, 1, 0.5), (7, 2, 6, 0.5)]
    assert ann_additive.search(df.limit(0), df).count() == 0


def test_equal_vectors_go_by_id(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 250, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    got = ann_additive.search(df, df.where("vec_id = 100"), nearest=5, shortlist=20, block=64).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_repeated_ids_take_part_once(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann_additive.search(df, df.where("vec_id = 1")).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 3.0), (1, 2, 3, 0.0)]


def test_copies_below_the_neighbours_push_none_out(spark):
    """One vector, copied more often than a shortlist holds, ranks just below the true neighbours."""
    rng = np.random.default_rng(9)
    near, copied = rng.normal(size=(6, 8)) * 0.05 + 1, np.full(8, 0.9)
    rows = [(0, np.ones(8)), *[(i + 1, v) for i, v in enumerate(near)], *[(100 + i, copied) for i in range(400)], *[(1000 + i, v) for i, v in enumerate(rng.normal(size=(100, 8)))]]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = ann_additive.search(df, df.where("vec_id = 0"), nearest=5, shortlist=20).orderBy("rank").collect()
    order = sorted(((-float(v.sum()), i) for i, v in rows if i), key=lambda p: p)[:5]
    assert [r.vec_id for r in got] == [i for _, i in order]


def test_beam_encoding_stores_lengths():
    x = np.random.default_rng(2).normal(size=(400, 16))
    books = ann_additive.fit_codebooks(x, books=4, words=16)
    codes, length = ann_additive.encode(x, books)
    sums = books[np.arange(4), codes].sum(1)
    assert np.allclose(length, np.sqrt((sums * sums).sum(1)))
    greedy, _ = ann_additive.encode(x, books, beam=1)
    assert ((x - sums) ** 2).sum() <= ((x - books[np.arange(4), greedy].sum(1)) ** 2).sum()


# --- token counts

LETTERS = random.Random(6)
ODD = ["".join(LETTERS.choice("abcdeéß😀") for _ in range(6000)), "na" * 1500 + "n", "aaaa aaaaaaa aaa", "<|endoftext|>Hi<|startoftext|><|endoftext|>", "ΣΑΣ ΟΔΟΣ", "a\x1cb\x1fc\x85d​e　f\xa0g", "it's we'll I'VE '''s", "123 ٣٤ ⅷ", "x" * 3000, "ab" * 4000 + "!" * 500, "<|endoftext|", "ﬁ Å", "\x00\x01", "𝒳𝓎", "👨‍👩‍👧"]


def test_token_counts_match_the_library(spark, sf_dir):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(token_count.default_vocabulary())
    more = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = real(spark, sf_dir).select("doc_id", "text").unionByName(more).unionByName(hard(spark).select("doc_id", "text"))
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, token_count.token_counts(docs.withColumn("n_tokens", F.lit(1))).collect()), key=repr) == want
    assert token_count.token_counts(docs.limit(0)).count() == 0
