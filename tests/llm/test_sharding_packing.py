import zlib
from collections import defaultdict

import numpy as np
import pytest

from gaugemill.llm import packing, sharding


def test_difference_keeps_every_part_and_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 500)
    sums = np.zeros((500, 7), np.int64)
    sums[:, 0] = sizes
    to = sharding.difference(sums)
    assert (np.sort(to, 1) == np.arange(7)).all()
    total = np.bincount(to[:, 0], sizes, 7)
    assert total.max() - total.min() <= 2
    assert sharding.difference(np.array([[3, 0]])).shape == (1, 2) and sharding.difference(np.zeros((0, 4), np.int64)).shape == (0, 4)


def test_equal_texts_share_a_shard_and_slots_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ITEMS", 50)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    monkeypatch.setattr(sharding, "NUMBERED_ROWS", 100)
    rows = [(i, f"text é {i % 700} " * (1 + i % 9), 9) for i in range(1500)] + [(5000, None, 1), (5001, "", 1), (5001, "", 1), (None, "x" * 30000, 0)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    assert len(found) == len(rows)
    size, slots, places = defaultdict(int), defaultdict(list), defaultdict(set)
    text = dict((i, t or "") for i, t, _ in rows)
    for r in found:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in places.values())
    rest = sorted(size.values())[:-1]  # one text is larger than a shard's share
    assert set(size) == set(range(40)) and max(rest) - min(rest) < 20
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def least_padding(lengths, buckets):
    tops = sorted(set(lengths))
    cost = lambda i, j: sum(tops[j - 1] for x in lengths if tops[i] <= x <= tops[j - 1])
    best = {0: 0}
    for _ in range(buckets):
        best = {j: min([best[i] + cost(i, j) for i in best if i < j] + [best.get(j, float("inf"))]) for j in range(len(tops) + 1) if j == 0 or any(i < j for i in best)}
    return best[len(tops)]


@pytest.mark.parametrize("seed", range(5))
def test_boundaries_have_the_least_padding(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, 60).tolist()
    top, count = np.unique(lengths, return_counts=True)
    for buckets in (1, 2, 3, 5, 60):
        ends = packing.boundaries(top, count, buckets)
        assert len(ends) <= buckets and ends[-1] == top[-1]
        assert sum(min(e for e in ends if e >= x) for x in lengths) == least_padding(lengths, buckets)


def test_batches_fit_the_budget_and_hold_every_row_once(spark):
    rows = [(i, "w " * (i % 300), "x") for i in range(900)] + [(1000, None, "y"), (1001, "", "y"), (1001, "", "y"), (None, "a\tb", "z"), (1002, "long " * 5000, "z")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket string"), 6, 2000).collect()
    assert len(found) == len(rows) and sorted(r.n_tokens for r in found) == sorted(len((t or "").split()) + 1 for _, t, _ in rows)
    batches = defaultdict(list)
    for r in found:
        assert r.n_tokens <= r.padded
        batches[r.bucket, r.batch].append(r)
    for rs in batches.values():
        assert len(rs) * rs[0].padded <= 2000 or len(rs) == 1
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert len({r.bucket for r in found}) <= 6
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
