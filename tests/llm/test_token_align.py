"""Token alignment against both libraries on whole texts and a plain scan over all token pairs."""

import hashlib
from collections import Counter

import pytest
from helpers import HARD, hard, real
from pyspark.sql import functions as F

from chronolex.llm import registry, token_align
from chronolex.llm.token_count import _byte_letters

ODD = [
    (20, "  two spaces\n newline \x1c and <|endoftext|> and <s>x</s>", "en", "a", 1),
    (21, "a ▁ mark", "en", "a", 1),
    (22, " ", "en", "a", 1),
    (23, "\n\n  \n x\t y   z　 w", "en", "a", 1),
    (24, "x" * 500 + " " * 300 + "y", "en", "a", 1),
    (25, "한국어 문장은 \U0001f600\U0001f600 여기 있다 \x00 ok", "ko", "a", 1),
    (26, "naïve café-society can't won't 12345 67,890.12", "fr", "a", 1),
]


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each (doc_id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_path, piece_path = token_align.default_paths()
    t, sp = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
    t.encode_special_tokens = True
    back = {c: b for b, c in _byte_letters().items()}
    made, count = [], Counter()
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        sides = []
        for ids, of in ((a, lambda i: bytes(back[c] for c in t.id_to_token(i))), (b, lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())):
            at, spans = 0, []
            for i in ids:
                n = len(of(i))
                spans.append((i, at, at + n))
                at += n
            sides.append((spans, b"".join(map(of, ids))))
        (x, xs), (y, ys) = sides
        if not text or xs != raw or ys != raw:
            x = y = []
        links, j = [], 0
        for i, s, e in x:
            while j < len(y) and y[j][2] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][1] < e:
                links.append((i, y[k][0]))
                k += 1
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, lo = [], 0
        for c in cuts:
            part = lambda spans: ",".join(str(i) for i, s, e in spans if lo <= s and e <= c)  # noqa: B023, E731
            groups.append(part(x) + "|" + part(y))
            lo = c
        count.update(links)
        made.append((doc, len(x), len(y), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(d, a, b, g, len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), sha) for d, a, b, g, ls, sha in made]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(df, rows):
    assert sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_odd_texts(spark):
    rows = [r for r in HARD if r[0] != 7] + ODD  # the longest one has 20,000 groups: brute force below goes through few
    df = spark.createDataFrame(rows, hard(spark).schema)
    clash = df.withColumn("pairs", F.lit(1)).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3))
    same(token_align.digest(clash), [(r[0], r[1]) for r in rows])


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in real(spark, sf_dir).select("doc_id", "text").collect() if len(r.text or "") < 3000]
    short = real(spark, sf_dir).where(F.coalesce(F.length("text"), F.lit(0)) < 3000)
    same(token_align.digest(short), rows)
    whole = registry.op11_token_alignment(spark, sf_dir)
    assert whole.count() == real(spark, sf_dir).count()


def test_frequent_pairs_and_small_tables_agree(spark, sf_dir, monkeypatch):
    docs = real(spark, sf_dir)
    before = sorted(map(tuple, token_align.digest(docs).collect()), key=repr)
    monkeypatch.setattr(token_align, "SPREAD", 50)
    token_align._loaded.cache_clear()
    assert sorted(map(tuple, token_align.digest(docs).collect()), key=repr) == before


def test_empty_and_string_ids(spark):
    assert token_align.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = token_align.digest(spark.createDataFrame([("x", "a b")], "doc_id string, text string")).first()
    assert (got.doc_id, got.n_a, got.n_groups) == ("x", 2, 2)


def test_segments_forgotten_between_batches():
    aligner = token_align.Aligner(*token_align.default_paths())
    first = aligner.documents(["one two three", "two two"])
    aligner.held = token_align.SEGMENT_BYTES + 1
    second = aligner.documents(["one two three", "two two"])
    assert first[1] == second[1] and (first[0] == second[0]).all() and (first[3] == second[3]).all()


@pytest.mark.parametrize("text", ["plain words here", "  lead", "trail  ", "a\n b", "a\n\n  b c"])
def test_segments_rebuild_the_text(text):
    assert "".join(token_align.SEGMENT.findall(" " + text)) == " " + text


def test_texts_that_end_in_one_space(spark):
    texts = ["trail ", "a b ", "x ", " ", "x  ", "\n ", "word\x1c ", "ok. ", "plain", "x ", " x "]
    rows = list(enumerate(texts))
    same(token_align.digest(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_white_space_at_both_ends_of_neighbours(spark):
    """Texts of one partition that would run into each other if their segments were read joined."""
    rows = list(enumerate(["x \xa0", "\xa0\xa0y", "!\x1c\x1c", "\xa0\xa0\t\x85\xa0            word\r\n", "\n\n\r\n\xa0\xa0!\r\n", "\xa0   \t\xa0\xa0\t\n\n  \xa0"]))
    same(token_align.digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), rows)


def test_interval_tables_may_exceed_memory():
    """A long text without spaces is one segment, whose tables go to disk if they are too large."""
    text = "".join(chr(0x4E00 + k * 7919 % 20000) for k in range(150_000))
    aligner = token_align.Aligner(*token_align.default_paths())
    whole = aligner.documents([text])
    aligner.forget()
    aligner.tables.execute("SET memory_limit = '64MB'")
    spilled = aligner.documents([text])
    assert whole[0][0][0] > 150_000 and (whole[0] == spilled[0]).all() and whole[1] == spilled[1] and (whole[4] == spilled[4]).all()
