"""How the tokens of two tokenizers lie over each other, by interval joins in DuckDB inside each Arrow partition.

Tokens of both sides are intervals of bytes. An ASOF join finds the B token under each A token's first byte, a range join
those that begin inside an A token beyond it; together these are all overlaps. Offsets where tokens of both sides end
cut the text, and a window sum over the cuts numbers the groups.

Both tokenizers always cut where a space follows a character that isn't white space: the byte-level one by its splitting
pattern, the other because none of its pieces has its space mark after another character, which is checked. So texts are
taken apart there, and each distinct segment of a worker goes through the interval tables once; a text's figures are
sums over its segments. Counts of id pairs are summed by document in the worker and over the corpus in Spark.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm import textarrays as T
from chronolex.llm.durable import keep
from chronolex.llm.token_count import _byte_letters

#: From a space to the next space that follows a character that isn't white space. A space that ends the text stays with what
#: it follows: the piece model, which adds a space itself, would get nothing for it.
SEGMENT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*(?: \Z)?")
#: Bytes of text in one pass, and of segments in one set of interval tables.
PASS_BYTES, TABLE_BYTES = 1 << 21, 1 << 18
#: A worker forgets its segments when it holds more than this many, or more bytes than that.
SEGMENTS, SEGMENT_BYTES = 300_000, 1 << 24
#: White space so long is left to the library of the tokenizer file: the faster reader of its ranks overflows its stack on it.
LONG_SPACE = re.compile(r"\s{1000}")
#: A pair of ids is frequent if it has more than one in SPREAD of the rows (document, pair); there are fewer than SPREAD.
SPREAD = 20_000
MARK = "▁"
#: Before a token in the text of groups: none, a new group, the B side of a group, another token of the same side.
_SIGNS = ("", ";", "|", ",")

_TABLES = """
CREATE OR REPLACE TEMP TABLE first AS
SELECT a.segment, a.id AS a, a.till AS a_till, b.id AS b, b.till AS b_till FROM a ASOF JOIN b ON a.at >= b.at;
CREATE OR REPLACE TEMP TABLE cuts AS SELECT a.till FROM a SEMI JOIN b ON a.till = b.till;
"""
_PAIRS = """
WITH links AS (
    SELECT segment, a, b FROM first
    UNION ALL
    SELECT f.segment, f.a, b.id FROM (FROM first WHERE b_till < a_till) f JOIN b ON b.at >= f.b_till AND b.at < f.a_till
)
SELECT segment, a, b, count(*) AS n FROM links GROUP BY ALL ORDER BY segment, a, b
"""
_GROUPS = """
SELECT t.segment, t.id, t.side, coalesce(sum(CASE WHEN c.till IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t.side ORDER BY t.till ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 AS side FROM b) t LEFT JOIN cuts c ON t.till = c.till
ORDER BY g, t.side, t.till
"""


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Both tokenizers, the bytes of their entries, and the figures of the segments that this worker has met."""

    def __init__(self, byte_path: str, piece_path: str):
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(byte_path)
        self.byte_level.encode_special_tokens = True
        self.byte_level.no_padding()
        self.byte_level.no_truncation()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        # entries in letters that stand for no byte are special tokens, which a plain text never gets
        entries = {i: bytes(letters.get(c, 63) for c in entry) for entry, i in self.byte_level.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.ranked = self._ranked(byte_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        if any(MARK in p.lstrip(MARK) for i, p in enumerate(names) if not self.pieces.is_control(i) and not self.pieces.is_unknown(i)):
            raise ValueError("a piece holds a space mark behind another character: segments don't stand by themselves")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.tables = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": f"{tempfile.gettempdir()}/align-{uuid.uuid4().hex}"})
        self.forget()

    def _ranked(self, path: str):
        """The same vocabulary read by ranks, many times faster, if its ids are the ranks of its merges; else None."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        first = len(model["vocab"]) - len(made)
        if first != 256 or any(model["vocab"].get(x) != first + k for k, x in enumerate(made)):
            return None
        ranks = {self.a_bytes[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.figures = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether bytes differ
        self.ids: list[str] = []
        self.pairs, self.times, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, segments: list[str]) -> None:
        """Figures of new segments, in interval tables of about TABLE_BYTES at a time."""
        sizes = np.cumsum([0, *(len(s.encode()) for s in segments)])
        for lo, hi in T.passes(sizes, TABLE_BYTES):
            self._align(segments[lo:hi])
        self.held += int(sizes[-1])

    def _byte_tokens(self, segments: list[str], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte-level side and the segment each belongs to.

        Segments are read joined, up to one that ends in white space: it ended its text, and would run into the next one.
        """
        ends = [k for k, s in enumerate(segments, 1) if s[-1].isspace()]
        runs = ["".join(segments[lo:hi]) for lo, hi in zip([0, *ends], [*ends, len(segments)], strict=True)]
        if self.ranked is not None and not any(map(LONG_SPACE.search, runs)):
            ids = np.fromiter(chain.from_iterable(map(self.ranked.encode_ordinary, runs)), np.int64)
            return ids, np.searchsorted(bounds, np.cumsum(self.a_sizes[ids]), side="left") - 1
        return _flat([e.ids for e in self.byte_level.encode_batch_fast(segments, add_special_tokens=False)])

    def _align(self, segments: list[str]) -> None:
        base = len(self.number)
        raw = [s.encode() for s in segments]
        a, of_a = self._byte_tokens(segments, np.cumsum([0, *map(len, raw)]))
        pieces = self.pieces.encode([s[1:] for s in segments], num_threads=1)
        b, of_b = _flat(pieces)
        n = len(segments)
        whole = np.bincount(of_a, weights=self.a_sizes[a], minlength=n) == np.fromiter(map(len, raw), np.int64, n)
        good = whole & np.fromiter((b"".join(map(self.b_bytes.__getitem__, y)) == x for x, y in zip(raw, pieces, strict=True)), bool, n)
        a, of_a, b, of_b = a[good[of_a]], of_a[good[of_a]], b[good[of_b]], of_b[good[of_b]]
        figures, texts = np.zeros((n, 5), np.int64), [""] * n
        figures[:, 0], figures[:, 1], figures[:, 4] = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), ~good
        pairs, times, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
        if len(a):
            for name, ids, segment, length in (("a", a, of_a, self.a_sizes), ("b", b, of_b, self.b_sizes)):
                till = np.cumsum(length[ids])
                self.tables.register(name, pa.table({"segment": segment, "id": ids, "at": till - length[ids], "till": till}))
            self.tables.execute(_TABLES)
            p = self.tables.execute(_PAIRS).fetchnumpy()
            pairs, times = (p["a"].astype(np.int64) << 32) | p["b"].astype(np.int64), p["n"].astype(np.int64)
            sizes = np.bincount(p["segment"], minlength=n)
            figures[:, 3] = np.bincount(p["segment"], weights=times, minlength=n).astype(np.int64)
            g = self.tables.execute(_GROUPS).fetchnumpy()
            segment, new = g["segment"], np.diff(g["g"], prepend=-1) != 0
            figures[:, 2] = np.bincount(segment[new], minlength=n)
            begin = np.flatnonzero(np.diff(segment, prepend=-1) != 0)
            sign = np.where(new, 1, np.where(np.diff(g["side"], prepend=0) != 0, 2, 3))
            sign[begin] = 0
            said = [_SIGNS[k] + str(i) for k, i in zip(sign.tolist(), g["id"].tolist(), strict=True)]
            for k, lo, hi in zip(segment[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(said)], strict=True):
                texts[k] = "".join(said[lo:hi])
        self.number.update(zip(segments, range(base, base + n), strict=True))
        self.figures = np.concatenate((self.figures, figures))
        self.ids.extend(texts)
        self.pairs, self.times = np.concatenate((self.pairs, pairs)), np.concatenate((self.times, times))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))

    def documents(self, texts: list[str | None]):
        """Figures (n_a, n_b, n_groups, n_links) and group text by document; its pairs and how often it has each."""
        if len(self.number) > SEGMENTS or self.held > SEGMENT_BYTES:
            self.forget()
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        new = [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in self.number]
        if new:
            self.learn(new)
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(texts)), n)
        figures = np.zeros((len(texts), 5), np.int64)
        for k in range(5):  # sums stay far below 2 ** 53
            figures[:, k] = np.bincount(owner, weights=self.figures[which, k], minlength=len(texts)).astype(np.int64)
        bad = figures[:, 4] > 0
        figures[bad] = 0
        ends = np.cumsum(n)
        ids = self.ids
        said = ["" if bad[k] or not n[k] else ";".join([ids[i] for i in which[ends[k] - n[k] : ends[k]].tolist()]) for k in range(len(texts))]
        good = ~bad[owner]
        both, often = np.unique((owner[good] << 32) | which[good], return_counts=True)
        segment = both & 0xFFFFFFFF
        sizes = (self.begin[1:] - self.begin[:-1])[segment]
        at = np.repeat(self.begin[segment] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        pair, doc, times = self.pairs[at], np.repeat(both >> 32, sizes), np.repeat(often, sizes) * self.times[at]
        order = np.lexsort((pair, doc))
        pair, doc, times = pair[order], doc[order], times[order]
        if len(pair):
            first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))))
            pair, doc, times = pair[first], doc[first], np.add.reduceat(times, first)
        return figures[:, :4], said, np.bincount(doc, minlength=len(texts)), pair, times


def _flat(tokens: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.fromiter(chain.from_iterable(tokens), np.int64, int(n.sum())), np.repeat(np.arange(len(tokens)), n)


@lru_cache(maxsize=1)
def _loaded(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, hashed: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text; others ignored) with its tokens' overlaps.

    Columns: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), and the arrays pairs (A id << 32 | B id)
    and times (the links of that pair in the document). The byte-level side sees a space and the text, the other one the
    text, to which it adds a space itself; strings of special tokens are plain text. Null and empty texts, and those whose
    joined token bytes differ from space and text on either side (such as U+2581 in a text), have zeros, an empty string and
    empty arrays. With ``hashed`` the groups are given as the hex digits of their SHA-256, the empty string stays. Repeated
    rows are each returned; an empty table gives an empty result.
    """
    default = default_paths() if byte_path is None or piece_path is None else ("", "")
    paths = byte_path or default[0], piece_path or default[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _loaded(*paths)
        for batch in batches:
            for lo, hi in T.passes(T.flat(batch.column(1))[1], PASS_BYTES):
                part = batch.slice(lo, hi - lo)
                figures, said, sizes, pair, times = aligner.documents(part.column(1).to_pylist())
                if hashed:
                    said = [s and hashlib.sha256(s.encode()).hexdigest() for s in said]
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (pair, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(figures[:, k]) for k in range(4)], pa.array(said, pa.string()), *lists], names=shape.names)

    rows = docs.select("doc_id", "text")
    shape = T.schema_of(rows, "doc_id", n_a="long", n_b="long", n_groups="long", n_links="long", groups="string", pairs="array<long>", times="array<long>")
    return rows.mapInArrow(each, shape)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, rows, best) over ``links`` (pair, times): links and rows of each pair, and whether no pair of its B id has more links.

    The table is bounded by the product of both vocabularies, whatever the size of the corpus.
    """
    counts = keep(links.groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("rows")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", "rows", (F.col("n") == F.col("most")).alias("best"))


def digest(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``.

    n_best are the row's links whose pair has the most links corpus-wide among its B id's pairs, ties included; count_sum adds
    up, over the row's links, the corpus-wide links of the pair. Nulls, empties and repeats as in ``aligned``; the hash of a
    row without tokens is the empty string. Frequent pairs, of which there are fewer than SPREAD, are looked up by a
    broadcast, so that no task gets all rows of one; the rest meets its counts by a shuffle.
    """
    rows = keep(aligned(docs, byte_path, piece_path, hashed=True).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    facts = keep(pair_counts(links), "counts")
    total = facts.agg(F.sum("rows")).first()[0] or 0
    frequent = F.broadcast(facts.where(F.col("rows") * SPREAD > max(total, SPREAD)).select("pair", "n", "best"))
    rest = facts.where(F.col("rows") * SPREAD <= max(total, SPREAD)).select("pair", "n", "best")
    met = links.join(frequent, "pair").unionByName(links.join(frequent, "pair", "left_anti").join(rest, "pair"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    whole = rows.drop("pairs", "times").join(sums, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256"))
