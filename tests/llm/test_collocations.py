"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np

from pathloom.llm import collocations as c


def plain(rows, s):
    lists, n = [], Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            lists.append((lang, words))
    f = Counter((lang, tuple(w[i : i + k])) for lang, w in lists for k in range(1, s.max_words + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= s.min_count}
    inside = {}
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside.get((lang, w[i : i + k]), 0), a)
    by_lang = {}
    for (lang, w), a in candidates.items():
        if 100 * inside.get((lang, w), -1) >= s.subsumed * a:
            continue
        score, _, l, r = min((s.scale * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for lang, some in by_lang.items() for i, (score, a, p, l, r) in enumerate(sorted(some)[: s.top]))


def rows_of(frame):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect())


def test_random_texts(spark):
    rng = random.Random(4)
    words = ["a", "B", "b", "the", "É", "é", "x" * 70, "日本", "-", "a b", "q\x00", "of"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "! ", " ; "]
    texts = ["".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choice(gaps) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(rng.choice(["en", "en", None, "", "fr"]), t) for t in texts] + [("en", None), (None, None), ("de", ""), ("it", " .,\n")]
    docs = spark.createDataFrame([(i % 7, lang, t, "clash", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, block int").repartition(3)
    for s in (c.Settings(min_count=3), c.Settings(min_count=2, max_words=5, top=40, salts=3, block_bytes=500), c.Settings(min_count=4, max_words=2, subsumed=90)):
        got = rows_of(c.collocations(docs, s))
        assert got == plain(rows, s) and got


def test_empty_table_and_texts(spark, empty_docs):
    from pyspark.sql import functions as F

    assert c.collocations(empty_docs.withColumn("lang", F.lit("en"))).collect() == []
    assert c.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).collect() == []


def test_scores_of_counts_beyond_64_bits(spark):
    a, l, r = 12_345_678_901_234, 23_456_789_012_345, 99_999_999_999_999
    one = spark.createDataFrame([(a, [l, a], [r, r])], "f long, heads array<long>, tails array<long>")
    got = one.select(c.lowest_cut(c.Settings()).alias("x")).first()["x"]
    want = min((1_000_000 * a * a // (p * q), k, p, q) for k, (p, q) in enumerate([(l, r), (a, r)], 1))
    assert tuple(got) == want


def test_lines_come_back():
    rng = np.random.default_rng(1)
    line = rng.integers(-1, 300, 5000).astype(np.int32)
    assert (c.unpacked(c.packed(line)) == line).all() and len(c.unpacked(c.packed(line[:0]))) == 0
    out, left, right, count = c.pairs(line)
    at = np.flatnonzero(out >= 0)
    assert (left[out[at]] == line[at]).all() and (right[out[at]] == line[at + 1]).all() and count.sum() == len(at)
