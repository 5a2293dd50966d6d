"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units at places that no piece of the vocabulary spans, so
units can be encoded apart.  Distinct units, whatever their length, are exploded
into their bounded substrings, joined by equality to the piece table, grouped by
unit, and folded with a higher-order aggregate.

The vocabulary at hand is a BPE model: the path with the best sum of piece
scores is not what the library returns, so the fold is not the plain Viterbi
recursion.  It runs over the edges in the order of their scores (merge ranks),
its state being the set of borders that are left in the unit: an edge takes away
the one border inside it if its ends are borders and nothing else lies between
them, which is a merge of two neighbours.  A piece ranks above those it is
made of (checked when the model is loaded), so one pass in that order is the
library's merge loop.  The path consists of the edges between neighbouring borders.

Ids go back to the texts chunk by chunk: the pass that cuts texts leaves each
chunk's unit numbers in a file in the shared folder and its distinct units in a
table.  That table is dealt out by unit once, both for the lattice and for the
join with its result, and units return to their chunk with packed piece keys.
No text is shuffled, and a chunk is bounded by a number of characters.

Edge cases: null and empty texts have no ids; runs of spaces follow the model's
run pieces; characters outside the vocabulary become byte pieces; a null doc_id
stays null; repeated rows are encoded one by one; an empty table gives an empty
result; other columns are ignored.  Decoding gives the text back unless it holds
U+2581, which the model reads as a space.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import textkernel as kernel
from pathloom.llm.exprs import let
from pathloom.llm.storage import new_path, saved, setting
from pathloom.llm.tokenfiles import _ranges, file_system, write_bytes

SPACE = "▁"
#: Places of an edge within its long: rank, start, width.
START, RANK = 8, 40
#: Borders that one long holds; longer units take words of LONG_WORD borders, in blocks.
ONE_LONG, LONG_WORD, LONG_BLOCK = 62, 48, 128
#: Piece keys of one long in the packed result, and bits of each.
PACK, PACK_BITS = 4, 16


@dataclass(frozen=True)
class Settings:
    """chunk_chars: texts of a chunk. task_units: units of chunks, repeats included, of a lattice task, about.
    most_tasks: beyond so many, tasks take more units instead. window: starts of a unit exploded together."""

    chunk_chars: int = 32_000_000
    task_units: int = 150_000
    most_tasks: int = 50_000
    window: int = 64


@dataclass
class Vocabulary:
    """Pieces of a byte-fallback BPE model.

    ``pieces[key]`` and ``ids[key]`` are ordered by merge rank, pieces of one
    character last; keys below ``n_merges`` are ranks.
    """

    pieces: list[str]
    ids: list[int]
    n_merges: int
    runs: dict[int, int]
    byte_ids: list[int]
    text_of_id: list[bytes]
    key: dict[str, int] = field(default_factory=dict)
    border_codes: np.ndarray | None = None
    longest: int = 1

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"not a BPE model with identity normalisation: {path}")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        is_run = lambda p: len(p) > 1 and not p.strip(SPACE)
        merged = sorted(((-p.score, i, p.piece) for i, p in normal if len(p.piece) > 1 and not is_run(p.piece)))
        single = [(0, i, p.piece) for i, p in normal if len(p.piece) == 1]
        texts = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in model.pieces]
        out = Vocabulary(
            [p for _, _, p in merged + single],
            [i for _, i, _ in merged + single],
            len(merged),
            {len(p.piece): i for i, p in normal if not p.piece.strip(SPACE)},
            [i for i, p in enumerate(model.pieces) if p.type == 6],
            texts,
        )
        out._check()
        return out

    def _check(self) -> None:
        """Keys of pieces, the pairs of characters that pieces span, and whether every merge ranks above its parts."""
        self.key = {p: k for k, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        self.border_codes = np.unique(np.array([ord(p[i]) << 21 | ord(p[i + 1]) for p in self.pieces for i in range(len(p) - 1)], dtype=np.int64))
        if self.longest > LONG_WORD - 8 or len(self.pieces) >= 1 << (PACK_BITS - 1):
            raise ValueError("pieces are too long or too many for packed edges")
        for k, piece in enumerate(self.pieces[: self.n_merges]):
            if any(part < self.n_merges and part >= k for part in self._last_merge(piece)):
                raise ValueError(f"a piece ranks below one that it is made of: {piece}")

    def _last_merge(self, piece: str) -> tuple[int, int]:
        """The two pieces whose merge completes ``piece`` when it is merged on its own."""
        symbols = list(piece)
        while len(symbols) > 2:
            ranked = [(k, i) for i in range(len(symbols) - 1) if (k := self.key.get(symbols[i] + symbols[i + 1], self.n_merges)) < self.n_merges]
            if not ranked:
                raise ValueError(f"a piece cannot be reached: {piece}")
            _, i = min(ranked)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return self.key[symbols[0]], self.key[symbols[1]]

    def run(self, n: int) -> list[int]:
        """Ids of n spaces in a row: merged from the left, all runs alike in rank."""
        symbols = [1] * n if n < 64 else [16] * ((n - 32) // 16) + [1] * (n - 16 * ((n - 32) // 16))
        i = 0
        while i < len(symbols) - 1:
            if symbols[i] + symbols[i + 1] in self.runs:
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                i = max(0, i - 1)
            else:
                i += 1
        return [self.runs[s] for s in symbols]

    def units(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(units of every word, a space before it, cut at the borders that no piece spans; where each word's begin)."""
        whole = SPACE + SPACE.join(words)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        pair = points[:-1] << 21 | points[1:]
        known = self.border_codes
        at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        cut = np.concatenate(([True], known[at] != pair))
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        cut[begins[:-1]] = True
        places = np.flatnonzero(cut)
        bounds = places.tolist()
        return [whole[i:j] for i, j in zip(bounds, [*bounds[1:], len(whole)], strict=True)], np.searchsorted(places, begins)


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(piece, key): one row per piece; its size is the vocabulary's."""
    return spark.createDataFrame([(p, k) for k, p in enumerate(vocabulary.pieces)], "piece string, key bigint")


def _left(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by.cast("int"))


def _right(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by.cast("int"))


def _bit(place: Column) -> Column:
    return _left(F.lit(1).cast("bigint"), place)


def _start(edge: Column) -> Column:
    return F.shiftrightunsigned(edge, START).bitwiseAND(F.lit((1 << (RANK - START)) - 1))


def _width(edge: Column) -> Column:
    return edge.bitwiseAND(F.lit((1 << START) - 1))


def _short_borders(length: Column, edges: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    """(borders left of a unit of up to ONE_LONG code points, how to read those under an edge)."""

    def under(borders: Column, edge: Column) -> Column:
        return _right(borders, _start(edge)).bitwiseAND(_bit(_width(edge) + 1) - 1)

    def merged(borders: Column, edge: Column) -> Column:
        def take(seen: Column) -> Column:
            """Both ends and one place between: that one goes."""
            ends = _bit(_width(edge)) + 1
            return F.when((F.bit_count(seen) == 3) & (seen.bitwiseAND(ends) == ends), borders - _left(seen - ends, _start(edge))).otherwise(borders)

        return let(under(borders, edge), take)

    return F.aggregate(edges, _bit(length + 1) - 1, merged), under


def _long_borders(length: Column, edges: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    """As ``_short_borders`` for any length: words of LONG_WORD borders in blocks of LONG_BLOCK, so that a merge copies two blocks at most."""
    full = (1 << LONG_WORD) - 1
    last = F.floor(length / LONG_WORD).cast("int")

    def whole(block: Column) -> Column:
        words = F.sequence(block * LONG_BLOCK, F.least(block * LONG_BLOCK + LONG_BLOCK - 1, last))
        return F.transform(words, lambda q: F.when(q < last, F.lit(full)).otherwise(_bit(length % LONG_WORD + 1) - 1))

    def word(borders: Column, q: Column) -> Column:
        return F.coalesce(F.get(F.get(borders, F.floor(q / LONG_BLOCK).cast("int")), (q % LONG_BLOCK).cast("int")), F.lit(0).cast("bigint"))

    def under(borders: Column, edge: Column) -> Column:
        q, r = F.floor(_start(edge) / LONG_WORD), _start(edge) % LONG_WORD
        both = _right(word(borders, q), r).bitwiseOR(_left(word(borders, q + 1), LONG_WORD - r))
        return both.bitwiseAND(_bit(_width(edge) + 1) - 1)

    def merged(borders: Column, edge: Column) -> Column:
        q, r = F.floor(_start(edge) / LONG_WORD), _start(edge) % LONG_WORD
        ends = _bit(_width(edge)) + 1

        def without(gone: Column) -> Column:
            low, high = _left(gone, r).bitwiseAND(F.lit(full)), _right(gone, LONG_WORD - r)

            def block(words: Column, i: Column) -> Column:
                first = i.cast("bigint") * LONG_BLOCK
                cleared = F.transform(words, lambda x, j: F.when(first + j == q, x - low).when(first + j == q + 1, x - high).otherwise(x))
                return F.when((first <= q + 1) & (first + LONG_BLOCK > q), cleared).otherwise(words)

            return F.transform(borders, block)

        def take(seen: Column) -> Column:
            return F.when((F.bit_count(seen) == 3) & (seen.bitwiseAND(ends) == ends), let(seen - ends, without)).otherwise(borders)

        return let(under(borders, edge), take)

    begin = F.transform(F.sequence(F.lit(0), F.floor(last / LONG_BLOCK).cast("int")), whole)
    return F.aggregate(edges, begin, merged), under


def fold(length: Column, edges: Column) -> Column:
    """Keys of the pieces of one unit, in order, from its edges (longs of rank, start and width)."""

    def path(ordered: Column, borders: Callable) -> Column:
        left, under = borders(length, ordered)

        def between(state: Column) -> Column:
            """Edges whose only borders are their ends, by start."""
            kept = F.filter(ordered, lambda e: under(state, e) == _bit(_width(e)) + 1)
            by_start = F.array_sort(F.transform(kept, lambda e: _left(_start(e), F.lit(24)).bitwiseOR(F.shiftrightunsigned(e, RANK))))
            return F.transform(by_start, lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))

        return let(left, between)

    return let(F.sort_array(edges), lambda x: F.when(length <= ONE_LONG, path(x, _short_borders)).otherwise(path(x, _long_borders)))


def packed(keys: Column) -> tuple[Column, Column]:
    """(the first PACK keys plus one in a long, the others or null)."""
    head = F.aggregate(F.reverse(F.slice(keys, 1, PACK)), F.lit(0).cast("bigint"), lambda acc, k: F.shiftleft(acc, PACK_BITS).bitwiseOR(k.cast("bigint") + 1))
    return head, F.when(F.size(keys) > PACK, F.slice(keys, F.lit(PACK + 1), F.size(keys)))


def dictionary(units: DataFrame, vocabulary: Vocabulary, settings: Settings) -> DataFrame:
    """(unit, keys) of distinct units that have a piece: explode, equi-join, group, fold.

    Units come spread by hash; explodes and the broadcast join keep that, so the
    group needs no second shuffle.  Rows of a unit also stay together, in the
    order of a number given to it, so that the sort of the group finds them sorted.
    Long units are exploded in overlapping windows, as a substring is found by counting from the start.
    """
    longest, window = vocabulary.longest, settings.window
    numbered = units.select("unit", F.monotonically_increasing_id().alias("u"), F.length("unit").alias("n"))
    windows = numbered.select("unit", "u", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / window).cast("int"))).alias("b"))
    windows = windows.select("unit", "u", "n", "b", F.substr("unit", F.col("b") * window + 1, F.lit(window + longest - 1)).alias("part"))
    starts = windows.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(window), F.length("part")) - 1)).alias("i"))
    parts = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("part") - F.col("i")))).alias("w"))
    place = _left((F.col("b") * window + F.col("i")).cast("bigint"), F.lit(START)).bitwiseOR(F.col("w").cast("bigint"))
    parts = parts.select("unit", "u", "n", place.alias("place"), F.substr("part", F.col("i") + 1, F.col("w")).alias("piece"))
    met = parts.join(F.broadcast(piece_table(units.sparkSession, vocabulary)), "piece")
    edge = F.shiftleft("key", RANK).bitwiseOR(F.col("place"))
    edges = met.select("u", "unit", "n", edge.alias("edge")).groupBy("u", "unit", "n").agg(F.collect_list("edge").alias("edges"))
    return edges.select("unit", fold(F.col("n"), F.col("edges")).alias("keys"))


class Cutter:
    """Numbers of the units of texts; one for each chunk of texts.  Only new words become strings and are cut."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.number: dict[str, int] = {SPACE: 0}
        self.words = kernel.Words()
        self.flat, self.ends = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        units, begins = self.vocabulary.units(words)
        number = self.number
        flat = np.fromiter((number.setdefault(u, len(number)) for u in units), dtype=np.uint32, count=len(units))
        self.ends = np.concatenate([self.ends, len(self.flat) + begins[1:]])
        self.flat = np.concatenate([self.flat, flat])

    def cut(self, texts: list[str]) -> list[np.ndarray]:
        """Unit numbers of every text; 0 is a space that no word follows at once."""
        raw = [t.replace(SPACE, " ").encode() for t in texts]
        joined = b" ".join(raw) + b" "
        stops = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = np.concatenate(([0], stops[:-1] + 1))
        at = np.concatenate(([0], np.cumsum([r.count(b" ") + 1 for r in raw])))
        word, fresh = self.words.numbers(joined, starts, stops)
        if fresh:
            self._learn([w.decode() for w in fresh])
        begin, length = self.ends[word], self.ends[word + 1] - self.ends[word]
        numbers = self.flat[_ranges(begin, length)]
        ends = np.concatenate(([0], np.cumsum(length)))[at]
        return [numbers[a:b] if t else numbers[:0] for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


#: Numbers below the first bound take one byte, below the second two, below the third three; others five.
_BOUNDS = (160, 160 + 80 * 256, 160 + 80 * 256 + 15 * 65536)


def _streams(x: np.ndarray) -> list[bytes]:
    """First bytes, and what follows them by its length: frequent numbers are small and share first bytes."""
    one, two, three = _BOUNDS
    first = np.full(len(x), 255, dtype=np.uint8)
    at = x < one
    first[at] = x[at]
    at = (x >= one) & (x < two)
    second = x[at] - np.uint32(one)
    first[at] = 160 + (second >> 8)
    at = (x >= two) & (x < three)
    third = x[at] - np.uint32(two)
    first[at] = 240 + (third >> 16)
    low = lambda y: (y & 255).astype(np.uint8).tobytes()
    return [first.tobytes(), low(second), low(third >> 8), low(third), x[x >= three].astype("<u4").tobytes()]


def _numbers(streams: list[bytes]) -> np.ndarray:
    one, two, _ = _BOUNDS
    first, *rest = (np.frombuffer(b, np.uint8) for b in streams[:4])
    second, high, low = (x.astype(np.uint32) for x in rest)
    out = first.astype(np.uint32)
    at = (first >= 160) & (first < 240)
    out[at] = ((out[at] - 160) << 8) + second + one
    at = (first >= 240) & (first < 255)
    out[at] = ((out[at] - 240) << 16) + (high << 8) + low + two
    out[first == 255] = np.frombuffer(streams[4], "<u4")
    return out


def _by_frequency(texts: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray]:
    """(old number of every new one, new number of every old one): frequent ones first, after 0, which stays."""
    seen = np.zeros(count, dtype=np.int64)
    for i in range(0, len(texts), 500):
        seen += np.bincount(np.concatenate(texts[i : i + 500]), minlength=count)
    order = np.concatenate(([0], 1 + np.argsort(-seen[1:], kind="stable")))
    rank = np.empty(count, dtype=np.uint32)
    rank[order] = np.arange(count)
    return order, rank


def _chunk_bytes(keys: list[int | None], texts: list[np.ndarray], rank: np.ndarray, sums: list[int]) -> bytes:
    """A chunk's file from its texts as unit numbers; ``texts`` is emptied on the way."""
    import zstandard

    table = pa.table({
        "doc_id": pa.array(keys, pa.int64()), "n": pa.array([len(x) for x in texts], pa.int64()), "crc": pa.array(sums, pa.int64()),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    codecs = [zstandard.ZstdCompressor(level=3).compressobj() for _ in range(5)]
    done: list[list[bytes]] = [[] for _ in codecs]
    texts.reverse()
    while texts:
        some = np.concatenate([texts.pop() for _ in range(min(500, len(texts)))])
        for held, codec, stream in zip(done, codecs, _streams(rank[some]), strict=True):
            held.append(codec.compress(stream))
    parts = [sink.getvalue().to_pybytes(), *(b"".join([*held, codec.flush()]) for held, codec in zip(done, codecs, strict=True))]
    return b"".join(len(x).to_bytes(8, "little") for x in parts) + b"".join(parts)


def _read_chunk(path: str) -> tuple[pa.Table, np.ndarray]:
    import zstandard

    system, name = file_system(path)
    with system.open_input_file(name) as f:
        raw = f.read()
    ends = np.cumsum([48] + [int.from_bytes(raw[i : i + 8], "little") for i in range(0, 48, 8)]).tolist()
    head, *streams = (raw[i:j] for i, j in zip(ends, ends[1:]))
    table = pa.ipc.open_file(pa.BufferReader(head)).read_all()
    return table, _numbers([zstandard.ZstdDecompressor().decompressobj().decompress(x) for x in streams])


def cut_texts(docs: DataFrame, vocabulary, folder: str, settings: Settings) -> DataFrame:
    """(chunk, number, unit) of every chunk; the chunk's texts as unit numbers go to a file named by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        cutter, size = Cutter(vocabulary.value), 0

        def close() -> pa.RecordBatch:
            """Write what is held; the words that were met are dropped before."""
            nonlocal cutter
            chunk = uuid.uuid4().int >> 65
            units = list(cutter.number)
            cutter = Cutter(vocabulary.value)
            order, rank = _by_frequency(held[1], len(units))
            write_bytes(f"{folder}/{chunk}", iter([_chunk_bytes(held[0], held[1], rank, held[2])]))
            units = [units[i] for i in order.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(units), chunk)), pa.array(np.arange(len(units), dtype=np.int32)), pa.array(units)], names=["chunk", "number", "unit"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, taken = first, 0
                while last < len(texts) and (last == first or taken + len(texts[last]) <= 1 << 21):
                    taken += len(texts[last])
                    last += 1
                if size and size + taken > settings.chunk_chars:
                    yield close()
                    held = ([], [], [])
                    size = 0
                some = texts[first:last]
                held[0].extend(keys[first:last])
                held[1].extend(cutter.cut(some))
                held[2].extend(zlib.crc32(t.encode()) for t in some)
                first, size = last, size + taken
        if held[0]:
            yield close()
        del held, cutter
        kernel.give_back()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "chunk long, number int, unit string")


def _ids_of_texts(numbers: np.ndarray, ends: np.ndarray, flat: np.ndarray, start: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their bounds) of texts whose unit numbers end at ``ends``.

    Zeros are spaces that no word follows at once.  A run of them, with the
    space of the word after it where that begins with one, is one run of spaces.
    """
    numbers = numbers.astype(np.int64)
    zero = numbers == 0
    begins = np.concatenate(([0], ends[:-1]))
    text_starts = np.zeros(len(numbers) + 1, dtype=bool)
    text_starts[begins] = True
    opens = np.flatnonzero(zero & (text_starts[:-1] | np.concatenate(([True], ~zero[:-1]))))
    begin, length = start[numbers], lengths[numbers]
    if len(opens):
        closes = np.flatnonzero(zero & (text_starts[1:] | np.concatenate((~zero[1:], [True])) | (np.arange(1, len(numbers) + 1) == len(numbers)))) + 1
        after = np.minimum(closes, len(numbers) - 1)
        eats = (closes < len(numbers)) & ~text_starts[closes] & (flat[np.minimum(start[numbers[after]], len(flat) - 1)] == vocabulary.runs[1])
        begin[after[eats]] += 1
        length[after[eats]] -= 1
        length[zero] = 0
        spaces = closes - opens + eats
        known = np.unique(spaces).tolist()
        runs = [np.array(vocabulary.run(n), dtype=np.int32) for n in known]
        size = np.array([len(r) for r in runs])
        where = np.searchsorted(known, spaces)
        begin[opens], length[opens] = (len(flat) + np.cumsum(size) - size)[where], size[where]
        flat = np.concatenate([flat, *runs])
    ids = flat[_ranges(begin, length)]
    at = np.concatenate(([0], np.cumsum(length)))
    return ids, at[np.concatenate(([0], ends))]


def decode_ids(ids: np.ndarray, text_of_id: list[bytes]) -> bytes:
    """UTF-8 of a sequence of ids, without the space that encoding puts before the text."""
    raw = b"".join(map(text_of_id.__getitem__, ids.tolist()))
    return raw[1:] if raw[:1] == b" " else raw


def encode(docs: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, ids and whether decoding gives the text back, for every row of (doc_id, text)."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(path)
    shared = spark.sparkContext.broadcast(vocabulary)
    folder = new_path(spark, "pieces")
    system, name = file_system(folder)
    system.create_dir(name, recursive=True)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", 2000):
        cut = saved(cut_texts(docs, shared, folder, settings), "pieces-units")
    rows = cut.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(rows // settings.task_units + 1, settings.most_tasks))
    dealt = cut.where("unit is not null").repartition(tasks, "unit")
    # Reads all columns, so that both uses of ``dealt`` are one exchange.
    distinct = dealt.groupBy("unit").agg(F.min("chunk").alias("c"), F.min("number").alias("n")).where("c >= 0 and n >= 0").select("unit")
    head, more = packed(F.col("keys"))
    known = dictionary(distinct, vocabulary, settings).select("unit", head.alias("head"), more.alias("more"))
    # A unit without a piece is one character that becomes bytes.
    met = dealt.join(known.hint("shuffle_hash"), "unit", "left").select("chunk", "number", F.coalesce("head", -1 - F.ascii("unit").cast("bigint")).alias("head"), "more")

    def assemble(table: pa.Table) -> pa.Table:
        voc: Vocabulary = shared.value
        table = table.sort_by("number")
        flat, start, lengths = _unpacked(table["head"].to_numpy(), table["more"], voc)
        docs_, numbers = _read_chunk(f"{folder}/{table['chunk'][0].as_py()}")
        ends = np.cumsum(docs_["n"].to_numpy())
        keys, sums = docs_["doc_id"].combine_chunks(), docs_["crc"].to_pylist()
        batches, first = [], 0
        while first < len(ends):  # texts of so many units, or one longer text, at once
            from_ = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, from_ + (1 << 18), "right")))
            ids, at = _ids_of_texts(numbers[from_ : ends[last - 1]], ends[first:last] - from_, flat, start, lengths, voc)
            good = [zlib.crc32(decode_ids(ids[i:j], voc.text_of_id)) == crc for i, j, crc in zip(at[:-1].tolist(), at[1:].tolist(), sums[first:last], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            batches.append(pa.RecordBatch.from_arrays([keys.slice(first, last - first), lists, pa.array(good, pa.bool_())], names=["doc_id", "ids", "round_trip"]))
            first = last
        del flat, numbers, table
        kernel.give_back()
        return pa.Table.from_batches(batches)

    # About one chunk for a task, however many there are.
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cut.where("number = 0").count())
    return met.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(assemble, "doc_id long, ids array<int>, round_trip boolean")


def _unpacked(head: np.ndarray, more: pa.ChunkedArray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all units, where each unit's begin, how many it has)."""
    id_of = np.array([0, *voc.ids], dtype=np.int32)
    bare = np.flatnonzero(head < 0)
    keys = np.where(head < 0, 0, head).astype("<i8").view("<u2").reshape(-1, PACK)
    first = (keys > 0).sum(axis=1)
    lists = more.combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    lone = [np.array([voc.byte_ids[b] for b in chr(-1 - int(head[i])).encode()], dtype=np.int32) for i in bare.tolist()]
    size[bare] = [len(x) for x in lone]
    lengths = first.astype(np.int64) + size
    start = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), dtype=np.int32)
    flat[_ranges(start, first)] = id_of[keys[keys > 0]]
    long = np.flatnonzero((size > 0) & (head >= 0))
    flat[_ranges(start[long] + first[long], size[long])] = id_of[values[_ranges(offsets[long], size[long])] + 1]
    for i, x in zip(bare.tolist(), lone, strict=True):
        flat[start[i] : start[i] + len(x)] = x
    return flat, start, lengths


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of each list of ids; null for null ids."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path).text_of_id)
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(np.array(x, dtype=np.int64), shared.value).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over the whole ``documents`` table."""
    import public_tokenizers

    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")
