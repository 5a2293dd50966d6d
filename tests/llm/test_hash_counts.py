"""Counts of hashes: right, and in memory that neither the rows nor the tasks make larger."""

import numpy as np
import pyarrow as pa

from pathloom.llm import hashcounts


def _hashes(batch):
    yield (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def test_counts_and_codes_equal_a_plain_count(spark):
    for bits in (8, 19):
        rows = spark.range(0, 40_000, 1, 7).selectExpr("id % 9000 as id")
        want = np.bincount(((np.arange(40_000, dtype=np.uint64) % np.uint64(9000)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        assert (hashcounts.hash_counts(rows, _hashes, bits) == want).all()
        coded = hashcounts.hash_counts(rows, _hashes, bits, lambda n: np.minimum(n, 255))
        assert coded.dtype == np.uint8 and (coded == np.minimum(want, 255)).all()


def test_a_slice_and_its_blobs_stay_small():
    """At 6 GB of texts there are 2**25 buckets: with 32 slices one task added up a million buckets of each of 256 tasks at once."""
    for bits in range(8, 27):
        size = hashcounts.slice_size(bits)
        assert size * (1 << bits) // size == 1 << bits and size <= 1 << 17
        assert 8 * size * hashcounts.TOGETHER <= 1 << 26
