"""Benchmark decontamination by spaced seeds.

Fixed masks over a window of words select some positions and ignore the rest,
so a window still hits when an ignored word was replaced.  Hashes of test
windows are looked up for every window of every document; around a hit the
document and the test item are laid over each other at the same offset.  A hit
is kept if the best stretch with matches and substitutions has enough matching
words, or if a fixed share of all the item's words match.

Some seed is whole wherever that share is, however the changed words lie: four
words in a row stand in any text with fewer changed words than a quarter, or one
change between two and two (``short_masks``, items below ``short`` words); of any
seven words in a row two or more are changed only where more than a quarter of
all is (``long_masks``, items from there on).

Hits of a text and an item are kept by their offset: each is laid over once,
whatever the number of seeds in common, and all offsets of a pair are compared
in blocks of a fixed number of words.

Test items of up to ``block_words`` words in all go to executors, and rows are
judged in one narrow stage.  Beyond that, seeds of items and of texts are two
tables joined by equality, which gives pairs of text and item; every text meets
its items once, and the same kernel judges them.  Of the items nothing but a
bitmap of a fixed number of bits is sent around.  Words are told apart by 64-bit
hashes.

Edge cases: null and empty texts, and items without words, match nothing; an
item shorter than a window must occur whole; rows with equal ids are judged one
by one; items that repeat are each reported; an empty table gives an empty
result, an empty benchmark leaves every row clean; other columns, of any name,
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import textkernel as kernel
from pathloom.llm.hashcounts import hash_counts
from pathloom.llm.storage import saved

#: Word bytes are letters, digits and all of non-ASCII; everything else separates words.
_WORD_BYTES = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))


@dataclass(frozen=True)
class Settings:
    """masks: 1 takes a word, 0 ignores it; equal lengths. short_masks: for items of a window to ``short`` - 1 words
    besides; long_masks: for longer ones. min_words: matching words needed in a stretch. share: of the item's words needed otherwise, all below a window.
    penalty: of a substitution against a match. block_words: words of test items broadcast at most.
    seed_bits: log2 of the bits that tell which seeds of texts are worth joining, with more items than that."""

    masks: tuple[str, ...] = ("110110101", "101101101", "111010011")
    short_masks: tuple[str, ...] = ("1111", "11011", "10111", "11101")
    long_masks: tuple[str, ...] = ("111111", "1011111", "1101111", "1110111", "1111011", "1111101")
    short: int = 49
    min_words: int = 13
    share: float = 0.75
    penalty: float = 2.0
    block_words: int = 500_000
    seed_bits: int = 24


def words_bytes(text: str | None) -> bytes:
    """Case-folded letters, digits and non-ASCII, anything else as space: shouted copies have the same words."""
    return (text or "").casefold().encode().translate(_WORD_BYTES)


def seed_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """One hash for every window that starts at a word and fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, salt, dtype=np.uint64)
    for i, taken in enumerate(mask):
        if taken == "1":
            out = out * kernel._MUL + words[i : i + n]
    return kernel.mix(out)


def masks_of(n: int, settings: Settings) -> list[str]:
    """Masks laid over an item of n words; one shorter than a window has a mask of its own length."""
    if n < len(settings.masks[0]):
        return ["1" * n] if n else []
    return [*settings.masks, *(settings.short_masks if n < settings.short else settings.long_masks)]


#: A seed that one item holds so often is not paired place by place.
OFTEN = 16
#: Pairs of places, and compared words, held at once.
PAIRS, CELLS = 2_000_000, 1_000_000


@dataclass
class Seeds:
    """Windows of all items under one mask: sorted hashes with item and place; which top bits occur; hash -> (item,
    places) of windows that an item holds often."""

    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    table: np.ndarray
    often: dict[int, list[tuple[int, np.ndarray]]]


@dataclass
class Block:
    """Test items: their words, and the hashes of their windows."""

    ids: list[int | None]
    words: list[np.ndarray]
    masks: dict[str, Seeds] = field(default_factory=dict)

    def index(self, settings: Settings, table_bits: int = 20) -> Block:
        used = [masks_of(len(w), settings) for w in self.words]
        for mask in sorted({m for some in used for m in some}):
            h, item, at = [], [], []
            for i, w in enumerate(self.words):
                if mask in used[i]:
                    got = seed_hashes(w, mask, len(mask))
                    h.append(got)
                    item.append(np.full(len(got), i))
                    at.append(np.arange(len(got)))
            h, item, at = map(np.concatenate, (h, item, at))
            order = np.lexsort((at, item, h))
            h, item, at = h[order], item[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (item[1:] != item[:-1]))))
            count = np.diff(np.append(first, len(h)))
            often: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, n in zip(first[count >= OFTEN].tolist(), count[count >= OFTEN].tolist(), strict=True):
                often.setdefault(int(h[i]), []).append((int(item[i]), at[i : i + n]))
            few = np.repeat(count < OFTEN, count)
            table = np.zeros(1 << table_bits, dtype=bool)
            table[(h >> np.uint64(64 - table_bits)).astype(np.int64)] = True
            self.masks[mask] = Seeds(h[few], item[few], at[few], table, often)
        return self


def overlaps(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray, settings: Settings) -> tuple[int, int, int] | None:
    """(matching words, first, end) of the best stretch over all offsets at which the item may start in the document:
    of words with matches and substitutions, else from the first to the last matching word of the whole item; None if
    too few words match in both.  The smallest offset counts among equals."""
    n, best = len(item), None
    needed = n if n < len(settings.masks[0]) else math.ceil(settings.share * n)
    place = np.arange(n)
    rows = max(1, CELLS // n)
    for block in range(0, len(shifts), rows):
        shift = shifts[block : block + rows]
        at = shift[:, None] + place
        same = (at >= 0) & (at < len(doc))
        same &= doc[np.clip(at, 0, len(doc) - 1)] == item
        matches = same.sum(axis=1)
        some = np.flatnonzero(matches >= min(needed, settings.min_words))
        if not len(some):
            continue
        same, matches, shift = same[some], matches[some], shift[some]
        line = np.arange(len(some))
        total = np.zeros((len(some), n + 1))
        np.cumsum(np.where(same, 1.0, -settings.penalty), axis=1, out=total[:, 1:])
        low = np.minimum.accumulate(total, axis=1)
        stop = np.argmax(total - low, axis=1)
        start = np.argmax(total == low[line, stop][:, None], axis=1)
        held = np.concatenate((np.zeros((len(some), 1), np.int64), np.cumsum(same, axis=1)), axis=1)
        inside = held[line, stop] - held[line, start]
        long_ = inside >= settings.min_words
        count = np.where(long_, inside, np.where(matches >= needed, matches, 0))
        first = np.where(long_, start, np.argmax(same, axis=1))
        end = np.where(long_, stop, n - np.argmax(same[:, ::-1], axis=1))
        top = int(np.argmax(count))
        if count[top] > (best[0] if best else 0):
            best = (int(count[top]), int(shift[top] + first[top]), int(shift[top] + end[top]))
    return best


def offsets(words: np.ndarray, at: np.ndarray, block: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, offsets) with a seed in common, by text and item; ``at`` bounds the texts' words."""
    found: list[np.ndarray] = []
    marked: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def keep(rows: list[np.ndarray]) -> None:
        found.append(np.unique(np.stack(rows, axis=1), axis=0))
        if sum(map(len, found)) > 2 * PAIRS:
            found[:] = [np.unique(np.concatenate(found), axis=0)]

    for mask, seeds in block.masks.items():
        h = seed_hashes(words, mask, len(mask))
        p = np.flatnonzero(seeds.table[(h >> np.uint64(64 - (len(seeds.table).bit_length() - 1))).astype(np.int64)])
        text = np.searchsorted(at, p, "right") - 1
        inside = p + len(mask) <= at[text + 1]
        p, text = p[inside], text[inside]
        here = h[p]
        lo, hi = np.searchsorted(seeds.hashes, here, "left"), np.searchsorted(seeds.hashes, here, "right")
        met = np.flatnonzero(hi > lo)
        ends = np.cumsum(hi[met] - lo[met])
        cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)) if len(ends) else []
        for rows in np.split(met, cuts):
            n = hi[rows] - lo[rows]
            if n.sum():
                each = np.repeat(lo[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                keep([np.repeat(text[rows], n), seeds.item[each], np.repeat(p[rows] - at[text[rows]], n) - seeds.at[each]])
        if seeds.often:
            rows = np.flatnonzero(np.isin(here, np.fromiter(seeds.often, np.uint64, len(seeds.often))))
            rows = rows[np.lexsort((rows, here[rows], text[rows]))]
            new = np.flatnonzero(np.concatenate(([True], (here[rows][1:] != here[rows][:-1]) | (text[rows][1:] != text[rows][:-1])))) if len(rows) else []
            for some in np.split(rows, new[1:]) if len(rows) else []:
                for item, places in seeds.often[int(here[some[0]])]:
                    marked.setdefault((int(text[some[0]]), item), []).append((p[some] - at[text[some[0]]], places))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), dtype=np.int64)
    new = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))) if len(rows) else np.empty(0, dtype=np.int64)
    few = {(int(some[0, 0]), int(some[0, 1])): some[:, 2] for some in np.split(rows, new[1:])} if len(rows) else {}
    for text, item in sorted(few.keys() | marked.keys()):
        shifts = few.get((text, item), np.empty(0, dtype=np.int64))
        if (text, item) in marked:
            size = len(block.words[item])
            seen = np.zeros(size + at[text + 1] - at[text], dtype=bool)
            seen[shifts + size] = True
            for of_text, of_item in marked[text, item]:
                for place in of_item.tolist():
                    seen[of_text + (size - place)] = True
            shifts = np.flatnonzero(seen) - size
        yield text, item, shifts


def leaks(texts: list[bytes], block: Block, settings: Settings) -> list[list[tuple[int | None, int, int, int]]]:
    """For every text its (item id, matching words, first word, end word), best stretch of each item."""
    out: list[list] = [[] for _ in texts]
    for first, some in kernel.chunks(texts):
        words, at = kernel.word_hashes(some)
        for text, item, shifts in offsets(words, at, block):
            got = overlaps(words[at[text] : at[text + 1]], block.words[item], shifts, settings)
            if got:
                out[first + text].append((block.ids[item], *got))
    return out


#: Test items that meet a text at once, beyond ``block_words``.
ITEMS = 1000
_NAMES = ("item_id", "n_words", "first_word", "end_word")
_FOUND = f"array<struct<{','.join(f'{c}:bigint' for c in _NAMES)}>>"
_FOUND_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in _NAMES]))


def items_of(tests: DataFrame, test_key: str, test_text: str) -> DataFrame:
    """(item, item_id, words): a number of its own and the word hashes of every test row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [kernel.word_hashes([words_bytes(t)])[0].view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int64()))], names=["item", "item_id", "words"])

    rows = tests.select(F.monotonically_increasing_id().alias("item"), tests[test_key].cast("long").alias("item_id"), tests[test_text].alias("text"))
    return saved(rows.mapInArrow(run, "item long, item_id long, words array<long>").where(F.size("words") > 0), "decontaminate-items")


def block_of(items: DataFrame, settings: Settings) -> Block | None:
    """All items as one block, or None if they have more than ``block_words`` words."""
    if (items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0) > settings.block_words:
        return None
    rows = items.orderBy("item").collect()  # block_words words at most
    return Block([r["item_id"] for r in rows], [np.array(r["words"], dtype=np.int64).view(np.uint64) for r in rows]).index(settings)


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def joined_leaks(docs: DataFrame, items: DataFrame, settings: Settings, text: str) -> DataFrame:
    """(text_key, leaks) of texts with leaks, for items of any number: seeds of both sides joined by equality."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, item, used = [np.empty(0, np.int64)], [], []
            for number, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.array(words, dtype=np.int64).view(np.uint64)
                for mask in masks_of(len(w), settings):
                    got = np.unique(seed_hashes(w, mask, len(mask))).view(np.int64)
                    h.append(got)
                    item += [number] * len(got)
                    used += [mask] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(item, pa.int64()), pa.array(used, pa.string())], names=["h", "item", "mask"])

    known = saved(items.select("item", "words").mapInArrow(seeds, "h long, item long, mask string"), "decontaminate-seeds")
    masks = [r["mask"] for r in known.select("mask").distinct().collect()]  # those of the settings and one for each length below a window
    counts = hash_counts(known.select("h"), lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), settings.seed_bits)
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(counts > 0).tobytes())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [words_bytes(t) for t in batch.column(1).to_pylist()]
            for first, some in kernel.chunks(texts):
                words, at = kernel.word_hashes(some)
                for mask in masks:
                    h = seed_hashes(words, mask, len(mask))
                    p = np.flatnonzero(table[(h >> np.uint64(64 - settings.seed_bits)).astype(np.int64)])
                    text_at = np.searchsorted(at, p, "right") - 1
                    inside = p + len(mask) <= at[text_at + 1]
                    rows = np.unique(np.stack([text_at[inside].astype(np.uint64), h[p[inside]]], axis=1), axis=0)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array([keys[first + i] for i in rows[:, 0].tolist()]), pa.array(rows[:, 1].copy().view(np.int64))], names=["text_key", "h"])

    texts = docs.where(docs[text].isNotNull()).select(text_key(docs[text]).alias("text_key"), docs[text].alias("text"))
    met = texts.mapInArrow(windows, "text_key string, h long").distinct().join(known.select("h", "item").distinct(), "h")
    pairs = saved(met.select("text_key", "item").distinct(), "decontaminate-candidates")
    # A text with very many items meets them in parts.
    parts = pairs.groupBy("text_key").agg(F.ceil(F.count(F.lit(1)) / ITEMS).alias("parts"))
    whole = texts.join(parts, "text_key").dropDuplicates(["text_key"]).select("text_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "text")
    some = pairs.join(parts, "text_key").join(items, "item").select("text_key", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part"), "item", "item_id", "words")

    def verify(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("item").to_numpy())
        own, out = right.take(order), []
        if left.num_rows and own.num_rows:
            item, words = own.column("item").to_pylist(), [np.array(w, dtype=np.int64).view(np.uint64) for w in own.column("words").to_pylist()]
            block = Block(list(range(len(item))), words).index(settings, 12)
            ids = own.column("item_id").to_pylist()
            out = [(key[0].as_py(), item[i], ids[i], *got) for i, *got in leaks([words_bytes(left.column("text")[0].as_py())], block, settings)[0]]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.string(), *[pa.int64()] * 5], strict=True)], names=["text_key", "item", *_NAMES])

    found = whole.groupBy("text_key", "part").cogroup(some.groupBy("text_key", "part")).applyInArrow(verify, "text_key string, item long, " + ", ".join(f"{c} long" for c in _NAMES))
    return found.groupBy("text_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("item", *_NAMES))), lambda x: F.struct(*(x[c].alias(c) for c in _NAMES))).alias("leaks"))


def find_leaks(docs: DataFrame, tests: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", test_key: str = "item_id", test_text: str = "text") -> DataFrame:
    """(key, leaks), the overlaps with test items, of every row of ``docs``."""
    items = items_of(tests, test_key, test_text)
    block = block_of(items, settings)
    if block is None:
        found = joined_leaks(docs, items, settings, text)
        rows = docs.select(docs[key].alias(key), text_key(docs[text]).alias("text_key"))
        return rows.join(found, "text_key", "left").select(key, F.coalesce("leaks", F.expr(f"cast(array() as {_FOUND})")).alias("leaks"))
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = leaks([words_bytes(t) for t in batch.column(1).to_pylist()], shared.value, settings)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(_NAMES, x, strict=True)) for x in some] for some in new], _FOUND_TYPE)], names=[key, "leaks"])

    rows = docs.select(docs[key].alias(key), docs[text].alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("leaks", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _NAMES])))]))


def without_leaks(docs: DataFrame, tests: DataFrame, settings: Settings = Settings(), text: str = "text", test_key: str = "item_id", test_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no test item, with all their columns."""
    items = items_of(tests, test_key, test_text)
    block = block_of(items, settings)
    if block is None:
        found = joined_leaks(docs, items, settings, text).select(F.col("text_key").alias("__text_key"))
        return docs.join(found, text_key(docs[text]) == found["__text_key"], "left_anti")
    shared, at = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = leaks([words_bytes(t) for t in batch.column(at).to_pylist()], shared.value, settings)
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over the whole ``documents`` table against the whole ``benchmark`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ordered = F.sort_array("leaks")
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("bigint").alias("n_items"),
        F.transform(ordered, lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["n_words"])), F.lit(0)).alias("max_words"),
        F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["first_word"].cast("string"), x["end_word"].cast("string"))), ",").alias("spans"),
    )
