"""Vectorised word kernels over batches of texts (numpy only, no Spark).

Texts are handled as UTF-8 bytes: the six ASCII white-space bytes never occur
inside a multi-byte character, so splitting bytes and splitting characters
give the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes taken at once; one longer text makes one longer chunk.
CHUNK = 1 << 20
#: The low n bytes of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words beyond two loads of eight bytes are hashed by a library.
LONG = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest(raw: bytes, size: int = 8) -> bytes:
    """A cryptographic digest, for whatever is too long to be its own key."""
    return hashlib.blake2b(raw, digest_size=size).digest()


def chunks(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of consecutive runs of about CHUNK bytes."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > CHUNK:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def eights(raw: bytes) -> np.ndarray:
    """The eight bytes from every place of ``raw`` as a little-endian integer; zeros follow the end."""
    return np.ndarray(len(raw) + LONG, dtype="<u8", buffer=raw + bytes(LONG + 8), strides=(1,))


def segment_hashes(raw: bytes, loads: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of UTF-8 text.

    Ranges of up to eight bytes have different hashes if they differ: their
    bytes are the key, and shorter ones carry their length in a top byte that
    UTF-8 never has.  Ranges beyond LONG bytes take a cryptographic digest.
    """
    n = stops - starts
    out = loads[starts] & _LOW[np.minimum(n, 8)]
    out = mix(np.where(n < 8, out | ((np.uint64(0xF8) + n.astype(np.uint64)) << np.uint64(56)), out))
    at = np.flatnonzero((n > 8) & (n <= LONG))
    if len(at):
        rest = loads[starts[at] + 8] & _LOW[n[at] - 8]
        out[at] = mix(out[at] * _MUL ^ mix(rest + n[at].astype(np.uint64) * _MUL))
    at = np.flatnonzero(n > LONG)
    if len(at):
        out[at] = np.frombuffer(b"".join([digest(raw[i:j]) for i, j in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]), dtype="<u8")
    return out


def same_bytes(raw: bytes, loads: np.ndarray, starts: np.ndarray, stops: np.ndarray, raw2: bytes, loads2: np.ndarray, starts2: np.ndarray, stops2: np.ndarray) -> np.ndarray:
    """Whether ranges of two byte strings are equal, pair by pair."""
    n = stops - starts
    same = n == stops2 - starts2
    for j in range(0, 64, 8):
        at = np.flatnonzero(same & (n > j)) if j else np.flatnonzero(same)
        if not len(at):
            break
        differ = ((loads[starts[at] + j] ^ loads2[starts2[at] + j]) & _LOW[np.minimum(n[at] - j, 8)]) != 0
        same[at[differ]] = False
    for i in np.flatnonzero(same & (n > 64)).tolist():
        same[i] = raw[starts[i] : stops[i]] == raw2[starts2[i] : stops2[i]]
    return same


class Words:
    """Numbers of distinct words, given in the order in which they are met.

    Hashes only narrow the search: a word has a number if its bytes are those
    of the word with that number.
    """

    def __init__(self) -> None:
        self.hashes, self.index = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # sorted by hash
        self.pool, self.ends = b"", np.zeros(1, dtype=np.int64)  # the bytes of all words
        self.other: dict[bytes, int] = {}  # words whose hash an earlier word has

    def __len__(self) -> int:
        return len(self.ends) - 1

    def numbers(self, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(number of every range of ``raw``, the words that are new)."""
        loads = eights(raw)
        here, first, back = np.unique(segment_hashes(raw, loads, starts, stops), return_index=True, return_inverse=True)
        begin, end = starts[first], stops[first]
        number = np.full(len(here), -1, dtype=np.int64)
        taken = np.zeros(len(here), dtype=bool)  # the hash is known
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, here), len(self.hashes) - 1)
            taken = self.hashes[place] == here
            at, known = np.flatnonzero(taken), self.index[place[taken]]
            equal = same_bytes(raw, loads, begin[at], end[at], self.pool, eights(self.pool), self.ends[known], self.ends[known + 1])
            number[at[equal]] = known[equal]
        new = np.flatnonzero(~taken)
        number[new] = len(self) + np.arange(len(new))
        words = [raw[i:j] for i, j in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
        out = number[back]
        if len(new):
            both = np.concatenate([self.hashes, here[new]])
            order = np.argsort(both, kind="stable")
            self.hashes, self.index = both[order], np.concatenate([self.index, number[new]])[order]
        count = len(self) + len(words)
        apart = np.flatnonzero((out < 0) | ~same_bytes(raw, loads, starts, stops, raw, loads, begin[back], end[back]))
        for i in apart.tolist():
            word = raw[starts[i] : stops[i]]
            if word not in self.other:
                self.other[word] = count
                words.append(word)
                count += 1
            out[i] = self.other[word]
        self.pool += b"".join(words)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(w) for w in words], dtype=np.int64)])
        return out, words


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, offsets of each text's words in that)."""
    at, joined, starts, stops = split_words(texts)
    return segment_hashes(joined, eights(joined), starts, stops), at


def split_words(texts: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(offsets of each text's words, the joined bytes, start and stop of every word)."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(([0], np.searchsorted(starts, ends))), joined, starts, stops


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows of one text.

    A text of fewer words has one window, the whole; no words, none.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    width = min(n, k)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : n - width + 1 + j]) * _MUL
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay alive beside later JVM stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
