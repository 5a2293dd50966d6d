"""op1: its query against seeds of plain words, both ways of meeting the benchmark, and clashing columns."""

import math
import re

import pytest
from pyspark.sql import functions as F

from pathloom.llm import decontaminate

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").casefold())


def overlap(doc, item, shift, s):
    """The stretch rule and the share rule, spelled out."""
    at = [i for i in range(len(item)) if 0 <= shift + i < len(doc)]
    same = [doc[shift + i] == item[i] for i in at]
    score, begin, best = 0.0, 0, (0.0, 0, 0)
    for i, hit in enumerate(same):
        if score <= 0 and not (score == 0 and begin < i):
            score, begin = 0.0, i
        score += 1.0 if hit else -s.penalty
        if score < 0:
            score, begin = 0.0, i + 1
        if score > best[0]:
            best = (score, begin, i + 1)
    n = sum(same[best[1] : best[2]])
    if n >= s.min_words:
        return n, shift + at[0] + best[1], shift + at[0] + best[2]
    hits = [i for i, hit in enumerate(same) if hit]
    needed = len(item) if len(item) < len(s.masks[0]) else math.ceil(s.share * len(item))
    return (len(hits), shift + at[0] + hits[0], shift + at[0] + hits[-1] + 1) if len(hits) >= needed else None


def brute(doc, item, s):
    best = None
    shifts = set()
    for mask in decontaminate.masks_of(len(item), s):
        taken = [i for i, c in enumerate(mask) if c == "1"]
        seeds = {}
        for a in range(len(item) - len(mask) + 1):
            seeds.setdefault(tuple(item[a + i] for i in taken), []).append(a)
        for p in range(len(doc) - len(mask) + 1):
            shifts |= {p - a for a in seeds.get(tuple(doc[p + i] for i in taken), ())}
    for shift in sorted(shifts):
        got = overlap(doc, item, shift, s)
        if got and (best is None or got[0] > best[0]):
            best = got
    return best


def test_query_against_plain_words(spark):
    s = decontaminate.Settings()
    docs = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r["item_id"], words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in decontaminate.query(spark, SF).collect()}
    assert set(got) == set(docs)
    for doc_id, doc in docs.items():
        found = sorted((item_id, *hit) for item_id, item in items if item and (hit := brute(doc, item, s)))
        row = got[doc_id]
        assert row["contaminated"] == bool(found) and row["n_items"] == len(found) and row["item_ids"] == [f[0] for f in found]
        assert row["max_words"] == max((f[1] for f in found), default=0)
        assert row["spans"] == ",".join(f"{f[0]}:{f[2]}:{f[3]}" for f in found)
    assert any(r["contaminated"] for r in got.values())


def test_both_ways_find_the_same(spark):
    docs, tests = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = docs.select("doc_id", "text").unionByName(docs.limit(3).select(F.lit(None).cast("bigint").alias("doc_id"), "text")).unionByName(docs.limit(2).select("doc_id", F.lit(None).cast("string").alias("text")))
    tests = tests.select("item_id", "text").unionByName(tests.limit(2).select("item_id", "text"))
    one, two = (decontaminate.find_leaks(docs, tests, decontaminate.Settings(block_words=n)) for n in (500_000, 0))
    rows = lambda df: sorted((r["doc_id"] or -1, sorted(map(tuple, r["leaks"]))) for r in df.collect())
    assert rows(one) == rows(two)
    kept = [sorted((r["doc_id"] or -1, r["text"] or "") for r in decontaminate.without_leaks(docs, tests, decontaminate.Settings(block_words=n)).collect()) for n in (500_000, 0)]
    assert kept[0] == kept[1] and len(kept[0]) == sum(1 for r in one.collect() if not r["leaks"])


@pytest.mark.parametrize("block_words", [500_000, 0])
def test_columns_with_the_names_of_results(spark, block_words):
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([("a", 1, item, "b", 2.5), ("c", 2, "clean", "d", None)], "leaks string, doc_id bigint, text string, text_key string, item double")
    tests = spark.createDataFrame([("z", 7, item)], "words string, item_id bigint, text string")
    settings = decontaminate.Settings(block_words=block_words)
    assert {r["doc_id"]: len(r["leaks"]) for r in decontaminate.find_leaks(docs, tests, settings).collect()} == {1: 1, 2: 0}
    kept = decontaminate.without_leaks(docs, tests, settings)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [("c", 2, "clean", "d", None)]
    assert decontaminate.without_leaks(docs.limit(0), tests, settings).count() == 0
    assert decontaminate.without_leaks(docs, tests.limit(0), settings).count() == 2
