"""Seeds of op1 under changes of any pattern, and texts that repeat a word."""

import random
import resource
import time

import numpy as np
import pytest

from pathloom.llm import decontaminate

S = decontaminate.Settings()


def block_of(*items):
    words = [decontaminate.kernel.word_hashes([" ".join(i).encode()])[0] for i in items]
    return decontaminate.Block(list(range(len(items))), words).index(S)


def test_periodic_changes_at_all_lengths():
    """Every P-th word changed: found wherever three quarters are left, at every offset."""
    for length in (*range(9, 60), 75, 100, 128, 200):
        item = [f"w{i}" for i in range(length)]
        block = block_of(item)
        docs, want = [], []
        for period in range(2, 9):
            for first in range(period):
                docs.append(" ".join(["x", "y", *(f"c{i}" if i % period == first else w for i, w in enumerate(item)), "z"]).encode())
                left = sum(i % period != first for i in range(length))
                want.append(left >= np.ceil(0.75 * length))
        found = [bool(f) for f in decontaminate.leaks(docs, block, S)]
        assert all(f for f, w in zip(found, want, strict=True) if w), length


def test_a_seed_is_whole_wherever_the_share_is():
    """Over all patterns of changes at once: the most matches without a whole seed stay below the share."""
    for masks, lengths in ((S.short_masks, range(9, S.short)), (S.long_masks, range(S.short, 400))):
        span = max(map(len, masks))
        whole = lambda bits: any(all(bits >> i & 1 for i, c in enumerate(m) if c == "1") for m in masks)
        # State: the last span words as bits, newest lowest; a seed may end at any word.
        most = {0: 0}
        for length in range(1, max(lengths) + 1):
            after: dict[int, int] = {}
            for bits, n in most.items():
                for bit in (0, 1):
                    new = (bits << 1 | bit) & ((1 << span) - 1)
                    if not whole(new):
                        after[new] = max(after.get(new, 0), n + bit)
            most = after
            if length in lengths:
                assert max(most.values()) < np.ceil(S.share * length), length


def test_random_changes_of_a_quarter():
    rng = random.Random(2)
    for length in (20, 48, 49, 52, 80, 150):
        item = [f"w{i}" for i in range(length)]
        block = block_of(item)
        docs = []
        for _ in range(100):
            gone = set(rng.sample(range(length), length // 4))
            docs.append(" ".join(["x", *(f"c{i}" if i in gone else w for i, w in enumerate(item)), "y"]).encode())
        assert all(decontaminate.leaks(docs, block, S)), length


@pytest.mark.parametrize("size, item", [(20_000, 400), (100_000, 400)])
def test_one_repeated_word(size, item):
    block, before, began = block_of(["the"] * item), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert decontaminate.leaks([b"the " * size], block, S) == [[(0, item, 0, item)]]
    assert time.time() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_offsets_of_repeating_words_equal_plain_ones():
    rng = random.Random(9)
    for _ in range(40):
        items = [[rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 90))] for _ in range(3)]
        doc = [rng.choice("ab") for _ in range(rng.randint(0, 60))] + rng.choice(items) + [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        block = block_of(*items)
        words, at = decontaminate.kernel.word_hashes([" ".join(doc).encode()])
        got = {(item, int(s)) for _, item, shifts in decontaminate.offsets(words, at, block) for s in shifts}
        want = set()
        for k, item in enumerate(items):
            for mask in decontaminate.masks_of(len(item), S):
                taken = [i for i, c in enumerate(mask) if c == "1"]
                for a in range(len(item) - len(mask) + 1):
                    want |= {(k, p - a) for p in range(len(doc) - len(mask) + 1) if all(doc[p + i] == item[a + i] for i in taken)}
        assert got == want


@pytest.mark.parametrize("items", [3, 1000])
def test_both_ways_on_repeating_and_periodic_texts(spark, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", items)
    rng = random.Random(items)
    base = [f"w{i}" for i in range(60)]
    tests = [(i, " ".join(rng.choices("ab", k=30))) for i in range(8)] + [(20, " ".join(base)), (21, "the " * 70), (22, "the cat"), (None, " ".join(base[:30])), (24, None)]
    texts = [" ".join(rng.choices("ab", k=90)) for _ in range(6)] + ["the " * 300, " ".join("x" if i % 4 == 1 else w for i, w in enumerate(base)), "the cat sat", " ".join(base) * 2, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(tests, "item_id long, text string")
    one, two = ({r["doc_id"]: sorted((x["item_id"] or -1, *list(x)[1:]) for x in r["leaks"]) for r in decontaminate.find_leaks(docs, bench, decontaminate.Settings(block_words=n)).collect()} for n in (500_000, 0))
    assert one == two and len(one[6]) >= 1 and len(one[7]) == 2
