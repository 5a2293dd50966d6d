"""Periodic runs of words: maximal stretches in which a block of words repeats.

Texts of a batch are one integer array in which no two texts share a number.
Prefix doubling ranks all suffixes; the ranks of every length 2**k are kept, and
tell exactly how many words two places have in common.  From the suffix array
and its LCP array come, for every place, the longest previous factor and where
it stands; they cut the text into LZ blocks.  After Main, a run that is not
inside a block touches the block's border with a period below the length of the
block and the one before: both extensions are taken at every border for all
those periods.  A run strictly inside a block is a copy of a run of the block's
source, kept by where runs start, and is moved over.

All this is one narrow stage; a task holds one batch of some 100,000 words, or
one longer text, at some 200 bytes a word.

Edge cases: a null or empty text has no words and no runs; a row with a null
doc_id is one like others; repeated rows are judged one by one; runs of one
stretch have its smallest period; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pathloom.llm.textkernel import give_back

#: (start, end, period) of a run, in words.
Run = tuple[int, int, int]


@dataclass(frozen=True)
class Settings:
    """min_words: least length of a run, which has two periods at least. batch_words: words judged at once, or one text."""

    min_words: int = 12
    batch_words: int = 100_000


class Suffixes:
    """All suffixes of texts that share no number, in order; every suffix ends with its text."""

    def __init__(self, words: np.ndarray, ends: np.ndarray) -> None:
        """``words``: from 0 without gaps; ``ends``: of its text, for every word."""
        n = len(words)
        counts = np.bincount(words)
        rank = np.full(n + 1, -1, dtype=np.int32)  # the last one stands behind all texts
        rank[:n] = (np.cumsum(counts) - counts)[words]
        self.words, self.ranks, width = words, [rank], 1
        tied = np.flatnonzero(counts[words] > 1)
        while len(tied):  # suffixes that agree in ``width`` words
            after = tied + width
            follows = np.where(after < ends[tied], rank[np.minimum(after, n)], -1).astype(np.int64) + 1
            group = rank[tied].astype(np.int64)
            key = group * (n + 2) + follows
            order = np.argsort(key)
            tied, key, group = tied[order], key[order], group[order]
            place = np.arange(len(tied))
            first = np.concatenate(([True], key[1:] != key[:-1]))
            first_of_group = np.concatenate(([True], group[1:] != group[:-1]))
            rank = rank.copy()
            rank[tied] = group + np.maximum.accumulate(np.where(first, place, 0)) - np.maximum.accumulate(np.where(first_of_group, place, 0))
            self.ranks.append(rank)
            tied = tied[~(first & np.concatenate((first[1:], [True])))]
            width *= 2
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank[:n]] = np.arange(n)

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from places i < j of one text on, or before them."""

        def agree(level: int, at: np.ndarray) -> np.ndarray:
            rank, step = self.ranks[level], out[at]
            if not back:
                return rank[i[at] + step] == rank[j[at] + step]
            a = i[at] - step - (1 << level)
            return (a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(j[at] - step - (1 << level), 0)])

        out = np.zeros(len(i), dtype=np.int64)
        at, met = np.arange(len(i)), []
        for level in range(len(self.ranks)):
            at = at[agree(level, at)]
            if not len(at):
                break
            met.append(at)
        for level in reversed(range(len(met))):
            at = met[level]
            out[at[agree(level, at)]] += 1 << level
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest factor at every word that stands somewhere before as well."""
        n, order = len(self.order), self.order
        lcp = np.zeros(n + 1, dtype=np.int64)  # of a suffix and the one above it
        same = np.flatnonzero(self.words[order[1:]] == self.words[order[:-1]]) + 1
        lcp[same] = self.common(np.minimum(order[same - 1], order[same]), np.maximum(order[same - 1], order[same]))
        length, source = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for step, held in ((-1, lcp[:n].copy()), (1, lcp[1:].copy())):
            near = np.arange(n) + step  # the next suffix up or down that starts earlier
            open_ = np.flatnonzero(held)
            while len(open_):
                over = near[open_]
                open_ = open_[late := order[over] > order[open_]]
                over = over[late]
                least, beyond = np.minimum(held[open_], held[over]), near[over]
                held[open_], near[open_] = least, beyond
                open_ = open_[least > 0]
            better = held > length[order]
            at = order[better]
            length[at], source[at] = held[better], order[near[better]]
        return length, source


def blocks_of(length: np.ndarray) -> np.ndarray:
    """Where the LZ blocks start: each is the longest previous factor, or one new word."""
    step, starts, at = np.maximum(length, 1).tolist(), [], 0
    while at < len(step):
        starts.append(at)
        at += step[at]
    return np.array(starts, dtype=np.int64)


def _counted(times: np.ndarray) -> np.ndarray:
    """1, 2, ... n for every n of ``times``."""
    return np.arange(1, times.sum() + 1) - np.repeat(np.cumsum(times) - times, times)


def border_runs(suffixes: Suffixes, starts: np.ndarray, bounds: np.ndarray, settings: Settings) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch a border of the blocks, by start and end."""
    n = len(suffixes.words)
    size = np.diff(np.append(starts, n))
    text = np.searchsorted(bounds, starts, "right") - 1
    inner = np.flatnonzero(starts != bounds[text])
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # of every text, whose end is a border as well
    border = np.concatenate((starts[inner], starts[last] + size[last]))
    before, after = np.concatenate((size[inner - 1], size[last])), np.concatenate((size[inner], np.zeros(len(last), np.int64)))
    room = border - bounds[np.concatenate((text[inner], text[last]))]
    left = np.minimum(before + after - 1, room)
    i = np.concatenate((np.repeat(border, after), np.repeat(border, left) - _counted(left)))
    j = np.concatenate((np.repeat(border, after) + _counted(after), np.repeat(border, left)))
    # Of a run's words but one period a half or more stand on one side of the border.
    need = -(-settings.min_words // 4)
    level = min(int(math.log2(max(need, 1))), 1, len(suffixes.ranks) - 1)
    rank, width = suffixes.ranks[level], 1 << level
    near = (rank[i] == rank[j]) | ((i >= width) & (rank[np.maximum(i - width, 0)] == rank[np.maximum(j - width, 0)]))
    i, j = i[near], j[near]
    ahead, behind, period = suffixes.common(i, j), suffixes.common(i, j, back=True), j - i
    runs = np.stack((i - behind, j + ahead, period), axis=1)[(ahead + behind >= period) & (period + ahead + behind >= settings.min_words)]
    runs = runs[np.lexsort(runs.T[::-1])]
    return runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))[: len(runs)]]


def with_copies(runs: list[Run], blocks: list[tuple[int, int, int]]) -> list[Run]:
    """``runs`` by start, and all that stand strictly inside (start, length, source) of a block, in the order of blocks.

    A block may overlap its source: then a run of the source comes back every ``start - source`` words.
    """
    for start, length, source in blocks:
        shift, new = start - source, []
        lo, hi = bisect_left(runs, (source + 1,)), bisect_left(runs, (start + 1,))
        for first, end, period in runs[lo:hi]:
            new += [(first + t, end + t, period) for t in range(shift, start + length - end, shift)]
        if new:
            runs[hi:] = sorted(runs[hi:] + new)
    return runs


def runs_of(texts: list[np.ndarray], settings: Settings = Settings()) -> list[list[Run]]:
    """All runs of every text, a text being an array of numbers from 0 without gaps; by start and period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out: list[list[Run]] = [[] for _ in texts]
    if not bounds[-1]:
        return out
    alphabet = np.array([int(t.max()) + 1 if len(t) else 0 for t in texts], dtype=np.int64)
    words = np.concatenate(texts) + np.repeat(np.cumsum(alphabet) - alphabet, sizes)
    suffixes = Suffixes(words, np.repeat(bounds[1:], sizes))
    length, source = suffixes.previous_factors()
    starts = blocks_of(length)
    full = np.unique(bounds[:-1])  # texts without words have no place
    found = border_runs(suffixes, starts, full, settings)
    for text in np.unique(np.searchsorted(bounds, found[:, 0], "right") - 1).tolist():
        low, high = bounds[text], bounds[text + 1]
        own = found[np.searchsorted(found[:, 0], low) : np.searchsorted(found[:, 0], high)]
        inside = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)]
        inside = inside[length[inside] >= settings.min_words + 2]
        blocks = np.stack((inside - low, length[inside], source[inside] - low), axis=1).tolist()
        runs = with_copies([(s - low, e - low, p) for s, e, p in own.tolist()], [tuple(b) for b in blocks])
        out[text] = sorted(((int(s), int(e), int(p)) for s, e, p in runs), key=lambda r: (r[0], r[2]))
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word every place of a text of n words takes, where the text's end is made periodic; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % (1 + (n - a) // (3 + g % 8)), at)


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers of the words, by first occurrence."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The text without what a run repeats: of every run its first period stays, unless another run takes it."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, end, period in runs:
            change[start + period] += 1
            change[end] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


_COLUMNS = T.StructType(
    [T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())]
)


def _judged(batches: Iterator[pa.RecordBatch], change: Callable[[object, int], np.ndarray | None] | None, settings: Settings) -> Iterator[tuple[list, list[list[Run]], list[list[bytes]]]]:
    """(keys, runs, words) of consecutive rows (key, text) of some ``batch_words`` words."""
    keys: list = []
    texts: list[np.ndarray] = []
    words: list[list[bytes]] = []
    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = text.as_buffer().to_pybytes().split() if text.is_valid else []
            number = numbered(own)
            if change is not None and (at := change(key, len(own))) is not None:
                own = [own[k] for k in at.tolist()]
                number = number[at]
                number = np.unique(number, return_inverse=True)[1]
            if held and held + len(own) > settings.batch_words:
                yield keys, runs_of(texts, settings), words
                keys, texts, words, held = [], [], [], 0
            keys.append(key)
            texts.append(number)
            words.append(own)
            held += len(own)
    if keys:
        yield keys, runs_of(texts, settings), words


def find_runs(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed) of every row: array<struct<start,length,period>> by start and period, and the text with
    repeated periods taken out, its words one space apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, runs, words in _judged(batches, None, settings):
            spans = [[{"start": s, "length": e - s, "period": p} for s, e, p in some] for some in runs]
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(spans, span), pa.array([collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)])], names=[key, "runs", "collapsed"])
        give_back()

    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    rows = docs.select(docs[key].alias(key), docs[text].alias("text"))
    kind = _arrow_type(rows)
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *_COLUMNS]))


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[0].dataType)


_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts, the longest run and digests of every row (doc_id, text), after ``planted`` has changed its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, runs, words in _judged(batches, planted, settings):
            out = []
            for key, some, own in zip(keys, runs, words, strict=True):
                s, e, p = min(some, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
                best = (s, e - s, p, 1000 * (e - s) // p) if some else (None,) * 4
                lines = "".join([f"{s},{e - s},{p}\n" for s, e, p in some])
                out.append((key, len(some), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(own, some)).hexdigest()))
            columns = [pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DIGEST.split(", ")])
        give_back()

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as binary) as text").mapInArrow(run, _DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over the whole ``documents`` table."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
