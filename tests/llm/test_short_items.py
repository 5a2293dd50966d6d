"""Items of every length with changed words, against brute force."""

import math
import random
from itertools import combinations

from pathloom.llm import decontaminate


def expected(doc, item):
    """By the definition: every offset, every stretch."""
    for shift in range(1 - len(item), len(doc)):
        same = [0 <= shift + i < len(doc) and doc[shift + i] == w for i, w in enumerate(item)]
        if sum(same) >= (len(item) if len(item) < 9 else math.ceil(0.75 * len(item))):
            return True
        stretches = [same[i:j] for i in range(len(item)) for j in range(i + 1, len(item) + 1)] if sum(same) >= 13 else []
        if stretches and sum(max(stretches, key=lambda s: 3 * sum(s) - 2 * len(s))) >= 13:
            return True
    return False


def test_items_of_5_to_30_words_with_changed_words():
    rng, settings = random.Random(7), decontaminate.Settings()
    for length in range(5, 31):
        item = [f"w{i}" for i in range(length)]
        block = decontaminate.Block([1], [decontaminate.kernel.word_hashes([" ".join(item).encode()])[0]]).index(settings)
        changes = [c for k in range(4) for c in combinations(range(length), k)]
        docs = []
        for gone in changes if length <= 12 else rng.sample(changes, 150):
            copy = [f"other{i}" if i in gone else w for i, w in enumerate(item)]
            docs.append(["before", "it", *copy, "after"])
        found = decontaminate.leaks([" ".join(d).encode() for d in docs], block, settings)
        assert [len(f) > 0 for f in found] == [expected(d, item) for d in docs], length


def test_a_short_item_is_found_up_to_its_share_only():
    settings = decontaminate.Settings()
    item = [f"w{i}" for i in range(13)]
    block = decontaminate.Block([1], [decontaminate.kernel.word_hashes([" ".join(item).encode()])[0]]).index(settings)
    docs = [" ".join(f"x{i}" if i % 4 == 0 and i < 4 * n else w for i, w in enumerate(item)).encode() for n in (1, 3, 4)]
    assert decontaminate.leaks(docs, block, settings) == [[(1, 12, 1, 13)], [(1, 10, 1, 13)], []]
