"""Phrase collocations by hierarchical pair naming.

A task numbers the words of its texts in blocks of one language.  Words that are
frequent over all blocks get a name; in every block names replace the words.  Two
adjacent names are a pair; pairs that are frequent over all blocks get a name in
turn, and replace the first of the two.  A name of round k so stands for k words,
and the two names of its pair point to its parents: all but the last word and all
but the first.  Counts of all beginnings and ends of a phrase, which its cuts
need, come down from its parents, and a longer phrase is found from its parents'
side; texts are not read again.

Counts meet by (language, word) or by pair of names, each block sending a row of
a word or pair once.  Such a row learns the count and the name in the same
shuffle, a window over its key, and only rows of frequent keys go back to their
blocks.  A name is the place of its first row, (block, number in the block).
Names are joined as tables, nothing is broadcast.

Edge cases: a null text is empty, a null language is ``und``; texts without
words, and an empty table, add nothing; repeated rows and null ids count like
others; a phrase never spans two pieces or texts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm import textkernel as kernel
from pathloom.llm.storage import saved

# What separates pieces, and what separates words in them.
BREAKS, SPACES = b".,;:!?\n\v\f\r", b" \t"

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2
#: Bits of a name: block of a task, number in the block; the task's number takes the rest.
_BLOCK_BITS, _NUMBER_BITS = 16, 26


@dataclass(frozen=True)
class Settings:
    """min_count: of a candidate. max_words: of a phrase, two at least. top: phrases reported of a language.
    subsumed: share of a phrase's count, in hundredths, at which a longer one takes its place. scale: of a score.
    salts: parts in which a language is ranked first. block_bytes: of text numbered together, or one longer text."""

    min_count: int = 10
    max_words: int = 3
    top: int = 2000
    subsumed: int = 50
    scale: int = 1_000_000
    salts: int = 64
    block_bytes: int = 32 << 20


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers of all words in order, -1 behind every piece; the words by number; how often each occurs)."""
    words, known, parts = kernel.Words(), [], []
    for _, some in kernel.chunks(texts):
        joined = b"\n".join(some).lower() + b"\n"  # of bytes: A-Z alone
        kind = _KIND[np.frombuffer(joined, np.uint8)]
        edge = np.flatnonzero(np.diff((kind == 0).astype(np.int8), prepend=0))
        starts, stops = edge[0::2], edge[1::2]
        if not len(starts):
            continue
        numbers, new = words.numbers(joined, starts, stops)
        known += new
        piece = np.cumsum(kind == 2)[starts]
        piece -= piece[0]
        piece = np.cumsum(np.diff(piece, prepend=0) > 0)
        out = np.full(len(starts) + int(piece[-1]) + 1, -1, dtype=np.int32)
        out[np.arange(len(starts)) + piece] = numbers
        parts.append(out)
    line = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return line, known, np.bincount(line[line >= 0], minlength=len(known))


def renamed(line: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The line with ``numbers`` as 0, 1, ... and all others as -1."""
    new = np.full(max(int(line.max(initial=-1)), int(numbers.max(initial=-1))) + 2, -1, dtype=np.int32)
    new[numbers] = np.arange(len(numbers))
    return new[line]  # the last entry is that of -1


def pairs(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the line of pairs, each in the place of its first; first, second and count of every pair by number)."""
    at = np.flatnonzero((line[:-1] >= 0) & (line[1:] >= 0))
    size = int(line.max(initial=0)) + 1
    keys, number, count = np.unique(line[at].astype(np.int64) * size + line[at + 1], return_inverse=True, return_counts=True)
    out = np.full(len(line), -1, dtype=np.int32)
    out[at] = number
    return out, keys // size, keys % size, count


def packed(numbers: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def blocks_of(docs: DataFrame, settings: Settings, lang: str, text: str) -> DataFrame:
    """(block, lang, n, words, counts, line): rows of some ``block_bytes`` of texts, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << _BLOCK_BITS, 0
        held: dict[str, list[bytes]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for name, texts in held.items():
                line, words, counts = numbered(texts)
                if made >> _BLOCK_BITS or len(words) >> _NUMBER_BITS:
                    raise ValueError("more blocks or words than names have bits for: take smaller partitions")
                if words:
                    columns = [pa.array([first + made], pa.int64()), pa.array([name]), pa.array([int(counts.sum())], pa.int64())]
                    columns += [pa.array([[w.decode() for w in words]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([packed(line)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "n", "words", "counts", "line"])
                    made += 1
            held.clear()

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_buffer().to_pybytes()
                held.setdefault(name, []).append(raw)
                size += len(raw) + 1
                if size >= settings.block_bytes:
                    yield from flushed()
                    size = 0
        yield from flushed()
        kernel.give_back()

    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "block long, lang string, n long, words array<string>, counts array<long>, line binary")


def frequent(rows: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """Rows (block, number, keys, n) of keys that occur often enough, with the key's count f and its name."""
    here = F.shiftleft(F.col("block"), _NUMBER_BITS) + F.col("number")
    same = Window.partitionBy(*keys)
    out = rows.withColumns({"f": F.sum("n").over(same), "name": F.min(here).over(same)}).where(F.col("f") >= settings.min_count)
    return out.select("block", "number", "name", "f", *keys, (F.col("name") == here).alias("first"))


def named(blocks: DataFrame, rows: DataFrame, paired: bool) -> DataFrame:
    """(block, line, names): blocks whose words, or pairs if ``paired``, are numbered by the names in ``rows``."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        order = np.argsort(number)
        if len(order) and left.num_rows:
            line = unpacked(left.column("line")[0].as_py())
            line = renamed(pairs(line)[0] if paired else line, number[order])
            names = right.column("name").to_numpy()[order]
            columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([packed(line)], pa.binary()), pa.array([names], pa.list_(pa.int64()))]
        else:
            columns = [pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, names=["block", "line", "names"])

    return blocks.select("block", "line").groupBy("block").cogroup(rows.select("block", "number", "name").groupBy("block")).applyInArrow(run, "block long, line binary, names array<long>")


def pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, number, left, right, n): every pair of adjacent names of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = names.values.to_numpy()
                _, left, right, count = pairs(unpacked(blob))
                if len(count) >> _NUMBER_BITS:
                    raise ValueError("more pairs than names have bits for: take smaller blocks")
                for i in range(0, len(count), 100_000):
                    part = slice(i, i + 100_000)
                    number = np.arange(len(count))[part]
                    columns = [np.full(len(number), block), number, own[left[part]], own[right[part]], count[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "number", "left", "right", "n"])
        kernel.give_back()

    return blocks.select("block", "line", "names").mapInArrow(run, "block long, number long, left long, right long, n long")


def children(parents: DataFrame, level: DataFrame) -> DataFrame:
    """Phrases of one word more from (name, left, right, f).

    ``heads`` are the counts of the beginnings from one word on, ``tails`` those of the ends, shortest first.
    """
    head = parents.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("start"), F.concat("heads", F.array("f")).alias("heads"))
    tail = parents.select(F.col("name").alias("right"), "last", F.concat("tails", F.array("f")).alias("tails"))
    met = level.join(head, "left").join(tail, "right")
    return met.select("name", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "f", "heads", "tails", "left", "right")


def lowest_cut(settings: Settings) -> Column:
    """struct<score, cut, l, r> of the cut with the lowest score; decimals of 38 digits hold all products."""
    n = F.size("heads")
    exact = "decimal(14,0)"
    cut = F.transform(
        "heads",
        lambda head, i: F.struct(
            F.call_function("div", F.lit(settings.scale).cast("decimal(7,0)") * F.col("f").cast(exact) * F.col("f").cast(exact), head.cast(exact) * F.element_at("tails", n - i).cast(exact)).alias("score"),
            (i + 1).alias("cut"), head.alias("l"), F.element_at("tails", n - i).alias("r"),
        ),
    )
    return F.array_min(cut)


def collocations(docs: DataFrame, settings: Settings = Settings(), lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    blocks = saved(blocks_of(docs, settings, lang, text), "collocations-blocks")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w")).select("block", "lang", "number", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    rows = saved(frequent(words, ["lang", "word"], settings), "collocations-words")
    none = F.expr("cast(array() as array<bigint>)")
    level = rows.where("first").select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"))
    levels: list[DataFrame] = []
    for k in range(2, settings.max_words + 1):
        blocks = saved(named(blocks, rows, k > 2), f"collocations-names{k - 1}")
        rows = frequent(pair_rows(blocks), ["left", "right"], settings)
        rows = saved(rows if k < settings.max_words else rows.where("first"), f"collocations-pairs{k}")
        level = saved(children(level, rows.where("first").select("name", "left", "right", "f")), f"collocations-phrases{k}")
        levels.append(level)
    kept = []
    for this, longer in zip(levels, [*levels[1:], None], strict=True):
        if longer is not None:  # of all longer phrases with this one inside, one with one word more occurs most often
            above = longer.select(F.explode(F.array("left", "right")).alias("name"), F.col("f").alias("above")).groupBy("name").agg(F.max("above").alias("above"))
            this = this.join(above, "name", "left").where(F.coalesce(100 * F.col("above") < settings.subsumed * F.col("f"), F.lit(True)))
        kept.append(this.select("lang", "phrase", F.col("f").alias("a"), lowest_cut(settings).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score"))
    found = reduce(DataFrame.unionByName, kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(settings.salts)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= settings.top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= settings.top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over the whole ``documents`` table."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, f, unnest(range(1, k)) AS cut, w FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, c.cut, ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, part, max(f) AS above
  FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part, f FROM candidates WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase
  WHERE i.above IS NULL OR 100 * i.above < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
