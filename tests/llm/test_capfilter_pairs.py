"""op9's comparison of a group against sets and all pairs."""

from __future__ import annotations

import numpy as np

from tidemark.llm import capfilter


def test_met_before_equals_set_intersection():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 60, rng.integers(0, 9))).astype(np.int32) for _ in range(40)]
    left, right = np.arange(0, 25), np.arange(20, 40)
    for number in (0, 7, 30, 99):
        got = capfilter.met_before(lists, left, right, number, step=8)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                assert got[i, j] == bool({f for f in lists[a] if f < number} & {f for f in lists[b] if f < number})


def test_each_pair_counts_in_its_first_common_filter_only():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 6)) * 0.2 + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    filters = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(30)]
    u, n = np.arange(30, dtype=np.int64), rng.integers(1, 4, 30)
    links = np.zeros(30, np.int64)
    for number in range(12):
        at = np.array([r for r in range(30) if number in filters[r]], int)
        for k1, k2 in ((0, 0), (0, 1), (1, 1)):
            of = at[np.isin(at % 2, (k1, k2))]
            a, b, c = capfilter.compare(number, k1, k2, of % 2, u[of], n[of], x[of], [filters[r] for r in of], 0.95)
            np.add.at(links, a[a == b], c[a == b])
    near = x @ x.T >= 0.95
    want = [sum(n[q] for q in range(30) if q != p and near[p, q] and set(filters[p]) & set(filters[q])) for p in range(30)]
    assert links.tolist() == want and sum(want) > 0


def test_pairs_at_the_threshold_share_filters_at_any_count():
    rng = np.random.default_rng(3)
    for count, dim in ((80_000, 64), (1_000_000, 64), (1_000_000, 6)):
        words, cap, number = capfilter.codes_for(count, dim, 0.9, 48, 32, 1e-5)
        x, y = rng.standard_normal((2, 300, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
        codes = capfilter.Codes(dim, words, cap, number, 0)
        shared = [len(np.intersect1d(a, b, True)) for a, b in zip(codes.decode(x), codes.decode(y), strict=True)]
        assert min(shared) > 0 and np.mean(shared) > 28
        assert all(len(f) == len(set(f.tolist())) and (np.diff(f) > 0).all() for f in codes.decode(x[:9]))
