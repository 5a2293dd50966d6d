"""The memory that a Python worker takes to encode texts goes with a chunk of them and the words kept, not with a batch."""

import random
import tracemalloc
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pathloom.llm import tokenfiles

BPE = public_tokenizers.path("word_bpe_49k.json")


def made_words(n):
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 8))) for _ in range(n)]


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids + [1]


def test_words_met_often_outlive_others():
    library, words = Tokenizer.from_file(BPE), made_words(6000)
    enc = tokenfiles.Encoder(BPE, 1000)
    learnt = []
    learn = enc._learn
    enc._learn = lambda some: (learnt.extend(some), learn(some))[1]
    for first in range(0, len(words), 500):
        texts = ["common words <|endoftext|> " * 3 + " ".join(words[first : first + 500]), ""]
        assert [x.tolist() for x in enc.encode(texts, 1)] == [ids_of(library, t) for t in texts]
        assert len(enc.known) == len(enc.met) == len(enc.bounds) <= 1502
    assert learnt.count("common") == 1 and enc.used < 20_000


def test_a_long_text_is_encoded_in_parts():
    library, words = Tokenizer.from_file(BPE), made_words(2000)
    for text in (" \n".join(words * 100) + " ", "\t" * 1_100_000 + "x", "ab" * 600_000 + " end", " ".join(words * 80) + " " + "y" * 2_000):
        assert tokenfiles.Encoder(BPE, 1000).encode([text, "a"], 1)[0].tolist() == ids_of(library, text)


def test_memory_does_not_go_with_the_batch():
    words = made_words(2000)
    text = " ".join(words)[:4000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array([text] * 4000)], names=["doc_id", "text"])
    settings = replace(tokenfiles.Settings(), memory=5_000)
    tokenfiles.encoder(BPE, settings.memory).encode([text], 1)
    tracemalloc.start()
    n = sum(len(ids) for _, ids in tokenfiles.encoded(iter([batch]), BPE, settings))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 * len(tokenfiles.Encoder(BPE, 5_000).encode([text], 1)[0])
    assert peak < 60e6, peak  # 16 MB of texts


def test_index_of_a_shard_takes_few_bytes_a_document():
    ids = np.array([1], np.uint32)
    tracemalloc.start()
    told = {}
    size = sum(len(piece) for piece in tokenfiles.shard_bytes(((i + 10**6, ids) for i in range(50_000)), b"", 2, 3, told))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told["n_docs"] == told["n_tokens"] == 50_000 and size > told["n_bytes"]
    assert peak < 100 * 50_000, peak
