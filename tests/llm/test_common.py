import numpy as np

from retentio.llm import common as C


def test_counts_and_keys_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (C.unpack_keys(C.pack_keys(keys)) == keys).all()
        counts = rng.choice([0, 1, 2, 254, 255, 256, 10**12], n)
        assert (C.unpack_counts(C.pack_counts(counts)) == counts).all()
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert (C.unpack_keys(C.pack_keys(ends)) == ends).all()


def test_buckets_cover_all_keys():
    keys = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    for n in (1, 2, 3, 7):
        start, end = C.buckets_of(keys, n)
        assert len(start) == n and start[0] == 0 and end[-1] == 4 and (start[1:] == end[:-1]).all()


def test_blocks_grow_with_the_root_of_the_corpus(spark):
    small = spark.createDataFrame([(1, "x" * 1000)] * 100, "doc_id long, text string")
    assert C.block_count(small) == 1 and C.block_count(small, 1000) > 4
    assert C.block_count(small.limit(0)) == 1
