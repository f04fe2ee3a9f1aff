"""Token counts of a byte-level BPE with word ends, by rank-synchronous merging of ragged numpy arrays.

All pre-tokens of a batch that weren't met before are one flat array of symbols with the offsets of each pre-token. In a
round every pre-token finds the lowest rank among its adjacent pairs and merges all places of that pair at once; the
rounds end when no pair is left that has a rank. What survives is counted. A pair's merge makes only pairs of higher
rank, so merging all places at once gives what merging one after the other gives.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronolex.llm import textarrays as T

LIMIT = 2048
#: Pre-tokens whose counts a Python worker remembers; when more are met it starts anew.
REMEMBERED = 300_000
#: Bytes from which on a pre-token is merged by itself, with its ranks kept between rounds.
LONG = 512

_NONE = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Fixed values of byte-level vocabulary files. The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A tokenizer file's rules: special strings, the splitting pattern and the ranked pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([vocabulary.get(letters[b], -1) for b in range(256)], np.int64)
        self.final = np.array([vocabulary.get(letters[b] + suffix, -1) for b in range(256)], np.int64)
        if (self.inner < 0).any() or (self.final < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        split = next(p for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in rules["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.seen: dict[str, int] = {}
        self.entry: dict[int, int] | None = None

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of ``text`` and the number of special strings in it, which are tokens by themselves."""
        if self.special is None or "<" not in text:
            return self.words.findall(self._normal(text)), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.words.findall(self._normal(part))], len(parts) - 1

    @staticmethod
    def _normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # lower() looks at neighbours for the capital sigma only
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def long_count(self, raw: bytes) -> int:
        """The number of symbols that survive in one long pre-token.

        Rounds are those of ``counts``. Ranks are kept from round to round, by rank with the places of their pairs; a
        merge looks up the two pairs it makes and no others, so the cost doesn't grow with the number of rounds.
        """
        flat = np.frombuffer(raw, np.uint8)
        first = self.inner[flat]
        first[-1] = self.final[flat[-1]]
        pair = (first[:-1] << 20) | first[1:]
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        known = np.flatnonzero(self.key[at] == pair)
        places: dict[int, list[int]] = {}
        for place, entry in zip(known.tolist(), at[known].tolist(), strict=True):
            places.setdefault(entry, []).append(place)
        if self.entry is None:
            self.entry = {k: i for i, k in enumerate(self.key.tolist())}
        entry_of, rank, made, key = self.entry.get, self.rank, self.made, self.key
        ranks = [(int(rank[e]), e) for e in places]
        heapq.heapify(ranks)
        symbols, n = first.tolist(), len(first)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while ranks:
            _, e = heapq.heappop(ranks)
            new, a, b = int(made[e]), int(key[e]) >> 20, int(key[e]) & ((1 << 20) - 1)
            for p in sorted(places.pop(e, ())):
                q = after[p]
                if symbols[p] != a or q >= n or symbols[q] != b:  # gone or merged meanwhile
                    continue
                symbols[p], symbols[q] = new, -1
                left -= 1
                r = after[p] = after[q]
                if r < n:
                    before[r] = p
                for s, t in ((before[p], p), (p, r)):
                    if s >= 0 and t < n:
                        found = entry_of((symbols[s] << 20) | symbols[t])
                        if found is not None:
                            if found not in places:
                                places[found] = []
                                heapq.heappush(ranks, (int(rank[found]), found))
                            places[found].append(s)
        return left

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of symbols that survive in each of ``words`` (none is empty)."""
        raw = [w.encode() for w in words]
        long = [i for i, r in enumerate(raw) if len(r) > LONG]
        if long:
            out = np.empty(len(words), np.int64)
            short = np.setdiff1d(np.arange(len(words)), long)
            out[short] = self.counts([words[i] for i in short]) if len(short) else 0
            out[long] = [self.long_count(raw[i]) for i in long]
            return out
        lengths = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.final[flat[ends - 1]]
        out, owner = np.ones(len(words), np.int64), np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            pair = (symbols[:-1] << 20) | symbols[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = np.where((self.key[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], _NONE)
            begin = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(symbols)))
            ended = least == _NONE
            out[owner[begin[ended]]] = sizes[ended]
            live = np.repeat(~ended, sizes)
            merge = (rank == np.repeat(least, sizes)) & live
            # of overlapping places (a a a) every second one counted from the left
            places = np.flatnonzero(merge)
            if not len(places):
                break
            run = np.concatenate(([0], np.flatnonzero(np.diff(places) != 1) + 1))
            odd = (places - np.repeat(places[run], np.diff(np.append(run, len(places))))) % 2 == 1
            places = places[~odd]
            symbols = symbols.copy()
            symbols[places] = self.made[at[places]]
            live[places + 1] = False
            symbols, owner = symbols[live], owner[live]
        return out

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = list({w for words, _ in split for w in words} - self.seen.keys())
        long = {}  # pre-tokens of more than LONG characters are few and may be large: they aren't remembered
        if new:
            made = dict(zip(new, self.counts(new).tolist(), strict=True))
            long = {w: made.pop(w) for w in new if len(w) > LONG}
            self.seen.update(made)
        get = self.seen.__getitem__ if not long else lambda w: long[w] if w in long else self.seen[w]
        return [sum(map(get, words)) + n for words, n in split]


@lru_cache(maxsize=2)
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``path`` is a tokenizer file that every executor has. Counts are without begin and end tokens; special strings in
    a text are one token each. doc_id keeps its type. Null and empty texts have no bytes and no tokens; repeated rows are each returned; an
    empty table gives an empty result.
    """
    path = path or default_vocabulary()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = bpe.count(texts)
                sizes = [len(t.encode()) for t in texts]
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(each, T.schema_of(docs, "doc_id", n_bytes="long", n_tokens="long", over_limit="boolean"))
