"""Token counts by rank-synchronous array merging.

Pre-tokens are held as ragged arrays of symbol ids.  In every turn each
sequence finds its lowest-rank pair and merges all places of it at once, until
no sequence has a mergeable pair; the symbols left are the tokens.  Words are
counted once per task batch of new words and remembered in a bounded memory.

The vocabulary file must describe a byte-level BPE with an end-of-word suffix,
an NFC / white space / lower case normaliser and added special strings that
match raw text, as word_bpe_49k.json does; others raise ValueError.

Edge cases: a null text counts as empty; an empty text has 0 tokens; texts are
never truncated, and one very long text makes one larger batch; repeated rows
are counted one by one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A sequence without a mergeable pair.
NONE = np.int64(2**31 - 1)
#: Distinct words remembered by a Python worker; beyond it the memory starts anew.
MEMORY = 600_000
#: New words merged at once.
BATCH = 100_000

# Fixed value: the split of the vocabulary file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


class Merges:
    """Symbols and ranked pairs of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"not a lower-case byte-level BPE with word ends: {path}")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings must match raw text")
        vocab = model["vocab"]
        self.size = np.int64(len(vocab))
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        # A direct table for the usual case; slots with several keys are looked up in the sorted keys.
        self.bits = 20
        slot = self._slot(self.key)
        self.table_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.table_rank = np.full(1 << self.bits, NONE, dtype=np.int64)
        self.table_key[slot], self.table_rank[slot] = self.key, self.rank
        self.crowded = np.bincount(slot, minlength=1 << self.bits) > 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, NONE where there is none."""
        key = left * self.size + right
        slot = self._slot(key)
        out = np.where(self.table_key[slot] == key, self.table_rank[slot], NONE)
        hard = np.flatnonzero(self.crowded[slot])
        if len(hard):
            at = np.minimum(np.searchsorted(self.key, key[hard]), len(self.key) - 1)
            out[hard] = np.where(self.key[at] == key[hard], self.rank[at], NONE)
        return out

    def symbols(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all sequences, start of each and the end of the last); no sequence may be empty."""
        buf = np.frombuffer(b"".join(pretokens), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pretokens])
        out = self.inner[buf]
        out[ends - 1] = self.last[buf[ends - 1]]
        return out, np.concatenate(([0], ends))

    def merge(self, pretokens: list[bytes]) -> np.ndarray:
        """Number of tokens of every pre-token."""
        counts = np.ones(len(pretokens), dtype=np.int64)
        if not pretokens:
            return counts
        sym, starts = self.symbols(pretokens)
        alive = np.arange(len(pretokens))
        counts[:] = np.diff(starts)
        while len(alive):
            length = np.diff(starts)
            owner = np.repeat(np.arange(len(alive)), length)
            rank = np.full(len(sym), NONE, dtype=np.int64)
            inside = owner[1:] == owner[:-1]
            at = np.flatnonzero(inside)
            rank[at] = self.rank_of(sym[at], sym[at + 1])
            lowest = np.minimum.reduceat(rank, starts[:-1])
            go = lowest < NONE
            counts[alive[~go]] = length[~go]
            hit = (rank == lowest[owner]) & go[owner]
            hit = _every_other(hit)
            sym = np.where(hit, self.merged[np.where(hit, rank, 0)], sym)
            keep = go[owner]
            keep[1:] &= ~hit[:-1]
            sym, owner = sym[keep], owner[keep]
            alive = alive[go]
            renumber = np.cumsum(go) - 1
            length = np.bincount(renumber[owner], minlength=len(alive)) if len(alive) else np.empty(0, dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(length)))
        return counts


def _every_other(hit: np.ndarray) -> np.ndarray:
    """In runs of adjacent hits (one symbol repeated) only the first, third, ... merge."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    index = np.arange(len(hit))
    begin = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), index, 0))
    return hit & ((index - begin) % 2 == 0)


def _byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Counter:
    """Token counts of texts, with a bounded memory of words."""

    def __init__(self, path: str) -> None:
        import regex

        self.merges = Merges(path)
        self.split = regex.compile(PRETOKEN)
        self.special = re.compile("|".join(map(re.escape, self.merges.special))) if self.merges.special else None
        self.known: dict[str, int] = {}
        self._slow = None
        self.path = path

    def normalised(self, word: str) -> str:
        """NFC and lower case; the library's own normaliser beyond Latin letters."""
        if word.isascii():
            return word.lower()
        if max(word) < "ɐ" and "İ" not in word:
            return unicodedata.normalize("NFC", word).lower()
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path).normalizer
        return self._slow.normalize_str(word)

    def learn(self, words: list[str]) -> None:
        """Count the tokens of new words: split each, merge all pieces together, add up."""
        for first in range(0, len(words), BATCH):
            some = words[first : first + BATCH]
            pieces: dict[bytes, int] = {}
            where: list[int] = []
            sizes: list[int] = []
            for word in some:
                parts = self.split.findall(self.normalised(word))
                sizes.append(len(parts))
                where += [pieces.setdefault(p.encode(), len(pieces)) for p in parts]
            counts = self.merges.merge(list(pieces))
            total = np.concatenate(([0], np.cumsum(counts[where]))) if where else np.zeros(1, dtype=np.int64)
            ends = np.cumsum(sizes)
            self.known.update(zip(some, (total[ends] - total[ends - sizes]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of every text."""
        extra = [0] * len(texts)
        if self.special:
            for i, text in enumerate(texts):
                if "<|" in text:
                    texts[i], extra[i] = self.special.subn(" ", text)
        split = [_ASCII_SPACE.split(t) if not t.isascii() else t.split(" ") if t.isprintable() else _ASCII_SPACE.split(t) for t in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = set().union(*split)
        self.learn(list(new))
        known = self.known
        return [sum(map(known.__getitem__, words)) + more for words, more in zip(split, extra, strict=True)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per Python worker and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _groups(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row: one narrow stage, no shuffle.

    ``vocabulary`` is a path that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            tokens = [n for some in _groups(texts) for n in count.count(some)]
            over = pa.array([n > limit for n in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64()), over], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[key].cast("long").alias(key), docs[text].alias(text)).mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over the whole ``documents`` table."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
