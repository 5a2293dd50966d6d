"""Periodic runs against all periods tried one by one."""

import hashlib
import random

import numpy as np

from pathloom.llm import runs
from tests.llm.conftest import EDGE_TEXTS


def plain_runs(words, least):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples(rng):
    yield []
    yield [0]
    yield [0] * 40
    yield [0, 1] * 20
    yield fibonacci(90)
    yield [bin(i).count("1") % 2 for i in range(100)]
    yield list(range(30)) + list(range(30)) + [7] + list(range(30))
    for _ in range(400):
        letters, n = rng.randint(1, 4), rng.randint(0, 70)
        yield [rng.randrange(letters) for _ in range(n)]
    for _ in range(300):  # blocks that come back, whole or cut, with runs inside
        block = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
        text = []
        while len(text) < rng.randint(20, 160):
            text += block * rng.randint(1, 4) if rng.random() < 0.7 else [rng.randrange(50) for _ in range(rng.randint(1, 5))]
            if rng.random() < 0.3 and text:
                at = rng.randrange(len(text))
                text += text[at : at + rng.randint(1, 60)]
        yield text


def dense(text):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in text], dtype=np.int64)


def test_runs_equal_all_periods():
    rng = random.Random(12)
    texts = list(samples(rng))
    for least in (2, 5, 12):
        got = runs.runs_of([dense(t) for t in texts], runs.Settings(min_words=least))
        for text, some in zip(texts, got, strict=True):
            assert some == plain_runs(text, least), (least, text)


def test_long_repetition_stays_quick():
    import time

    n, began = 200_000, time.time()
    assert runs.runs_of([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    text = np.arange(n) % 777
    assert runs.runs_of([text]) == [[(0, n, 777)]]
    assert time.time() - began < 30


def brute(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    at = runs.planted(doc_id, len(words))
    if at is not None:
        words = [words[i] for i in at]
    found = plain_runs(words, 12)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    row = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    return (doc_id, len(found), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def key(row):
    return tuple((v is not None, v) for v in row)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    short = [r for r in docs if len((r["text"] or "").split()) <= 1500]
    got = {r["doc_id"]: tuple(r) for r in runs.query(spark, folder).collect()}
    assert len(got) == len(docs) and len(short) > 150
    for r in short:
        assert got[r["doc_id"]] == brute(r["doc_id"], r["text"])


def test_edges(spark, edge_docs, empty_docs):
    got = sorted((tuple(r) for r in runs.digests(edge_docs.select("doc_id", "text")).collect()), key=key)
    want = sorted((brute(r["doc_id"], r["text"]) for r in edge_docs.collect()), key=key)
    assert got == want
    assert runs.digests(empty_docs).collect() == [] and runs.find_runs(empty_docs).collect() == []
    texts = ["to be or not " * 5 + "end", None, "a b"]
    out = runs.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), runs.Settings(batch_words=3)).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r["runs"]] for r in out] == [[(0, 20, 4)], [], []]
    assert [r["collapsed"] for r in out] == ["to be or not end", "", "a b"]
    assert len(EDGE_TEXTS) + 2 == edge_docs.count()
