"""op9's filters are dealt in rounds that hold a few copies of each vector."""

from __future__ import annotations

import numpy as np

from tidemark.llm import capfilter


def test_rounds_deal_few_copies_and_give_all_links(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "DEALT", 1, raising=False)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, 24))
    x[:80] = x[0] + 0.3 * rng.standard_normal((80, 24))
    dealt, whole = [], capfilter.map_groups

    def counted(df, *rest):
        dealt.append(df.count())
        return whole(df, *rest)

    monkeypatch.setattr(capfilter, "map_groups", counted)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in capfilter.link(df, per_filter=8).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(400, dtype=bool)
    assert [got[i] for i in range(400)] == near.sum(axis=1).tolist() and near.sum() > 100
    assert len(dealt) > 5 and max(dealt) <= 4 * capfilter.COPIES * 400
