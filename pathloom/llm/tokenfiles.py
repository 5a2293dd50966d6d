"""Token-id files: per-document zstandard frames under one shared dictionary.

A shard file holds, in ascending doc_id order, one frame for each document
(its ids as little-endian unsigned integers of 2 or 4 bytes), then an index and
a footer, so that one short document is read with three small reads:

    8 bytes   magic
    32 bytes  SHA-256 of the dictionary
    1 byte    width of an id
    frames
    index     n x int64 doc_id, n x uint8 id-is-null, (n + 1) x uint64 offset, n x uint32 length in ids
    24 bytes  offset of the index, n, magic

The dictionary file lies beside the shards and is named by its hash.  Files go
to the shared folder under a temporary name and are renamed when complete, so
a task that runs again, or twice, leaves the same file.

Edge cases: a null or empty text has only the end id; a null doc_id sorts
first and comes back as null; rows with equal ids keep both rows, by text; an
empty table gives no shard; texts are never truncated; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.storage import new_path, saved, setting
from pathloom.llm.textkernel import CHUNK, Words, chunks, give_back, split_words
from pathloom.llm.tokencount import PRETOKEN, Counter, _byte_chars

MAGIC = b"PLTOKEN1"
_FOOTER = struct.Struct("<QQ8s")
_HEADER = struct.Struct("<8s32sB")
_WHITE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass(frozen=True)
class Settings:
    """end_id: appended to every document. sample_docs, sample_ids: documents the dictionary is trained on, and ids of
    each, at most. dictionary_bytes: its size. level: of compression. memory: distinct words after which a worker
    forgets all but the half met most often. batch_rows: texts that a worker is sent at once. shard_chars: texts of a
    shard, about."""

    end_id: int = 1
    sample_docs: int = 2000
    sample_ids: int = 4096
    dictionary_bytes: int = 65536
    level: int = 3
    memory: int = 600_000
    batch_rows: int = 1000
    shard_chars: int = 256_000_000


class Encoder:
    """The library's ids of whole texts, with a bounded memory of words.

    The vocabulary drops white space and never merges across it, so the ids of
    a text are those of its words in turn; special strings hold no white space.
    New words are normalised and split once, and the library's model encodes
    all new pieces together: it ends every piece with an end-of-word id, which
    tells the pieces apart.  Words with special strings go through the whole
    library.
    """

    def __init__(self, path: str, memory: int) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        words = Counter(path)
        words.merges = None  # the library's model has its own
        self.split, self.normalised = regex.compile(PRETOKEN + "|\n"), words.normalised
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.chars = dict(enumerate(_byte_chars())) | {32: " "}
        self.is_last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.is_last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.memory = memory
        self.width = 2 if len(self.is_last) <= 1 << 16 else 4
        self.known = Words()
        self.flat = np.empty(1 << 16, dtype=np.uint16 if self.width == 2 else np.uint32)
        self.used = 0
        self.bounds = np.zeros((0, 2), dtype=np.int64)  # of each known word's ids
        self.met = np.zeros(0, dtype=np.int64)  # how often each known word was met

    def _forget(self) -> None:
        """Keep the half of the memory that was met most often."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: self.memory // 2])
        ends = self.known.ends
        pool = b" ".join([self.known.pool[i:j] for i, j in zip(ends[kept].tolist(), ends[kept + 1].tolist(), strict=True)])
        length = ends[kept + 1] - ends[kept]
        starts = np.cumsum(length + 1) - length - 1
        self.known = Words()
        number, _ = self.known.numbers(pool, starts, starts + length)
        kept = kept[np.argsort(number)]  # in the order of their new numbers
        begin, end = self.bounds[kept].T
        found = self.flat[_ranges(begin, end - begin)]
        self.used = 0
        self.flat = np.empty(max(1 << 16, len(found)), dtype=found.dtype)
        self.bounds = self._store(found, np.cumsum(end - begin))
        self.met = self.met[kept] // 2  # what is no longer met goes in the end
        give_back()

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their bounds)."""
        found = []
        for i in range(0, len(pieces), 4000):
            joined = " ".join(pieces[i : i + 4000])
            if not (joined.isascii() and joined.isprintable()):
                joined = joined.encode().decode("latin-1").translate(self.chars)
            found.append(np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32))
        ids = np.concatenate(found) if found else np.empty(0, dtype=np.uint32)
        return ids, np.concatenate(([0], np.flatnonzero(self.is_last[ids]) + 1))

    def _learn(self, words: list[str]) -> np.ndarray:
        normalised = self.normalised
        # No word has a line end, so it shows where the pieces of a word end.
        parts = self.split.findall("\n".join([*(w.lower() if w.isascii() else normalised(w) for w in words), ""]))
        number = dict.fromkeys(parts)
        number.pop("\n", None)
        pieces = list(number)
        number = dict(zip(pieces, range(len(pieces)), strict=True)) | {"\n": -1}
        at = np.fromiter(map(number.__getitem__, parts), dtype=np.int64, count=len(parts))
        upto = np.flatnonzero(at < 0) - np.arange(len(words))
        at = at[at >= 0]
        ids, bounds = self._pieces(pieces)
        length = bounds[at + 1] - bounds[at]
        ends = np.concatenate(([0], np.cumsum(length)))
        return self._store(ids[_ranges(bounds[at], length)], ends[upto])

    def _learn_special(self, words: list[str]) -> np.ndarray:
        found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        return self._store(np.array([i for f in found for i in f], dtype=np.uint32), np.cumsum([len(f) for f in found], dtype=np.int64))

    def _store(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keep the ids of words, which end at ``ends``; the bounds of each word's."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat) // 2, len(ids)), dtype=self.flat.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        ends = self.used + ends
        bounds = np.stack([np.concatenate(([self.used], ends))[:-1], ends], axis=1)
        self.used += len(ids)
        return bounds

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of every text, the end id last."""
        return list(self.encode_bytes((t.encode() for t in texts), end_id))

    def encode_bytes(self, texts: Iterable[bytes], end_id: int) -> Iterator[np.ndarray]:
        """Ids of every UTF-8 text, the end id last; a chunk of texts, or of one long text, is taken at once."""
        for _, some in chunks(texts):
            if len(some) > 1 or len(some[0]) <= CHUNK:
                yield from self._encode(some, np.array([end_id], dtype=np.uint32))
            else:
                none = np.empty(0, dtype=np.uint32)
                yield np.append(np.concatenate([ids for part in _parts(some[0]) for ids in self._encode([part], none)]), np.uint32(end_id))

    def _encode(self, texts: list[bytes], end: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of every text, then ``end``; only words not seen before become strings."""
        if len(self.known) > self.memory:
            self._forget()
        at, joined, starts, stops = split_words(texts)
        word, fresh = self.known.numbers(joined, starts, stops)
        if fresh:
            words = [w.decode() for w in fresh]
            special = [i for i, w in enumerate(words) if "<|" in w]
            plain = [i for i, w in enumerate(words) if "<|" not in w]
            bounds = np.empty((len(words), 2), dtype=np.int64)
            bounds[plain] = self._learn([words[i] for i in plain])
            if special:
                bounds[special] = self._learn_special([words[i] for i in special])
            self.bounds = np.concatenate([self.bounds, bounds])
            self.met = np.concatenate([self.met, np.zeros(len(words), dtype=np.int64)])
        self.met += np.bincount(word, minlength=len(self.met))
        begin, stop = self.bounds[word].T
        ids = self.flat[_ranges(begin, stop - begin)]
        ends = np.concatenate(([0], np.cumsum(stop - begin)))[at]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield np.concatenate([ids[a:b], end])


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in turn, cut at white space into parts of about CHUNK bytes, or of one longer word."""
    first = 0
    while first < len(text):
        cut = _WHITE.search(text, first + CHUNK)
        last = cut.end() if cut else len(text)
        yield text[first:last]
        first = last


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (length[0] of them), then those of begin[1], and so on."""
    before = np.cumsum(length) - length
    return np.repeat(begin - before, length) + np.arange(int(length.sum()))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memory: int) -> Encoder:
    """One per Python worker and vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, memory) not in _ENCODERS:
        _ENCODERS[path, memory] = Encoder(path, memory)
    return _ENCODERS[path, memory]


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, settings: Settings) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every row of (doc_id, text) batches, in order."""
    enc = encoder(vocabulary, settings.memory)
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        yield from zip(batch.column(0).to_pylist(), enc.encode_bytes((t.as_py() or b"" for t in texts), settings.end_id), strict=True)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_bytes(path: str, pieces: Iterator[bytes]) -> None:
    """Write a whole file or none: under a temporary name, then renamed."""
    system, name = file_system(path)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as out:
        for piece in pieces:
            out.write(piece)
    system.move(temporary, name)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; empty where the samples are too few or too short to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes, level: int | None = None):
    import zstandard

    about = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdDecompressor(**about) if level is None else zstandard.ZstdCompressor(level=level, **about)


def shard_bytes(rows: Iterator[tuple[int | None, np.ndarray]], dictionary: bytes, width: int, level: int, told: dict) -> Iterator[bytes]:
    """The pieces of one shard file; ``told`` gets its figures. Only compressed frames' offsets are held."""
    codec, at = _codec(dictionary, level), _HEADER.size
    keys, nulls, offsets, lengths = array("q"), array("b"), array("q", [at]), array("q")
    yield _HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), width)
    for key, ids in rows:
        frame = codec.compress(ids.astype("<u2" if width == 2 else "<u4").tobytes())
        yield frame
        at += len(frame)
        keys.append(key or 0)
        nulls.append(key is None)
        offsets.append(at)
        lengths.append(len(ids))
    index = (np.array(keys, "<i8"), np.array(nulls, "u1"), np.array(offsets, "<u8"), np.array(lengths, "<u4"))
    yield b"".join(x.tobytes() for x in index)
    yield _FOOTER.pack(at, len(keys), MAGIC)
    told |= {"n_docs": len(keys), "n_tokens": sum(lengths), "n_bytes": at}


class Shard:
    """Random access to one shard file, or to all of it in order."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        magic, digest, self.width = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        self.index_at, n, end = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"not a complete shard: {path}")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"another dictionary is needed: {digest.hex()}")
        raw = self.file.read_at(size - _FOOTER.size - self.index_at, self.index_at)
        self.keys = np.frombuffer(raw, "<i8", n)
        self.nulls = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 9 * n)
        self.lengths = np.frombuffer(raw, "<u4", n, 9 * n + 8 * (n + 1))
        self.codec = _codec(dictionary)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document: one read and one small decompression."""
        at, end = int(self.offsets[i]), int(self.offsets[i + 1])
        raw = self.codec.decompress(self.file.read_at(end - at, at), max_output_size=self.width * int(self.lengths[i]))
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype(np.uint32)

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document by its id."""
        first = int(self.nulls.sum())  # nulls sort first
        i = first + int(np.searchsorted(self.keys[first:], doc_id))
        return self.ids(i) if i < len(self.keys) and self.keys[i] == doc_id else None

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i, (key, null) in enumerate(zip(self.keys.tolist(), self.nulls.tolist(), strict=True)):
            yield None if null else key, self.ids(i)


_MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def write(docs: DataFrame, vocabulary: str, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write (doc_id, text) to ``folder``; returns the manifest, one row per shard in doc_id order."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_docs)
    spark = docs.sparkSession

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = "<u2" if encoder(vocabulary, settings.memory).width == 2 else "<u4"
        for key, ids in encoded(batches, vocabulary, settings):
            # The dictionary serves short documents; long ones would only fill it.
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key], pa.int64()), "ids": pa.array([ids[: settings.sample_ids].astype(width).tobytes()], pa.binary())})
        give_back()

    one_each = docs.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    picked = one_each.mapInArrow(sample, "doc_id long, ids binary")
    with setting(spark, _BATCH, settings.batch_rows):
        taken = picked.collect()
    samples = sorted((r["doc_id"], bytes(r["ids"])) for r in taken)  # sample_docs rows of sample_ids ids at most
    dictionary = train_dictionary([ids for _, ids in samples], settings.dictionary_bytes)
    shared = spark.sparkContext.broadcast(dictionary)
    system, name = file_system(folder)
    system.create_dir(name, recursive=True)
    write_bytes(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dict", iter([dictionary]))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        rows = encoded(batches, vocabulary, settings)
        head = next(rows, None)
        if head is None:
            return
        told: dict = {}
        path = f"{folder}/shard-{shard:06d}.tok"

        def all_rows() -> Iterator[tuple[int | None, np.ndarray]]:
            yield head
            yield from rows

        write_bytes(path, shard_bytes(all_rows(), shared.value, encoder(vocabulary, settings.memory).width, settings.level, told))
        give_back()
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [path]} | {k: pa.array([told[k]], pa.int64()) for k in ("n_docs", "n_tokens", "n_bytes")}
        )

    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // settings.shard_chars + 1)
    ranged = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    with setting(spark, _BATCH, settings.batch_rows):
        return saved(ranged.mapInArrow(put, _MANIFEST), "token-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    ``start`` needs the sum over all shards before; the manifest has one row
    per shard, so that window is as small as the list of files.
    """
    placed = manifest.withColumn("begin", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("path", F.coalesce("begin", F.lit(0)).alias("begin"))
    spark = manifest.sparkSession
    n = max(1, manifest.count())

    def told(rows: list[tuple[int | None, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path, _dictionary(folder, path))
                rows: list[tuple[int | None, int, int, int]] = []
                for key, ids in shard:
                    rows.append((key, begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    begin += len(ids)
                    if len(rows) == 10_000:
                        yield told(rows)
                        rows = []
                if rows:
                    yield told(rows)
        give_back()

    return placed.repartition(min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _dictionary(folder: str, path: str) -> bytes:
    """The dictionary that a shard's header names."""
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        digest = _HEADER.unpack(f.read_at(_HEADER.size, 0))[1]
    system, name = file_system(f"{folder}/{digest.hex()}.dict")
    with system.open_input_file(name) as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over the whole ``documents`` table: written to the shared folder and read back."""
    import public_tokenizers

    folder = new_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, public_tokenizers.path("word_bpe_49k.json"), folder), folder)
