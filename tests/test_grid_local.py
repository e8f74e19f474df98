"""A small grid is fitted inside tasks, each with all rows and some of the models."""

import numpy as np

from crivo.operators import multifit as MF
from crivo.session import materialise


def test_small_grids_take_no_job_per_step(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        idx = sorted(int(t) for t in rng.choice(60, 12, replace=False))
        rows.append((int(sum(t % 3 == 0 for t in idx) > 4), i % 3, idx, [12**-0.5] * 12))
    df = materialise(spark.createDataFrame(rows, MF.ROWS).repartition(3), "grid-test")
    settings = [MF.Setting(k, c, f) for k in (20, 60) for c in (0.1, 1.0) for f in (-1, 0)]
    sums, plain = [], MF._sum
    monkeypatch.setattr(MF, "_sum", lambda *a: sums.append(1) or plain(*a))
    apart = MF.fit_many(df, settings, 200, 1e-4)
    assert not sums
    monkeypatch.setattr(MF, "LOCAL_ENTRIES", 300 * 12 - 1)  # one term too many
    spread = MF.fit_many(df, settings, 200, 1e-4)
    assert sums and apart.shape == spread.shape == (61, len(settings))
    assert np.allclose(apart, spread, atol=2e-2)
    assert not apart[20:60, [i for i, s in enumerate(settings) if s.features == 20]].any()
    assert (MF.fold_counts(df, settings, apart) == MF.fold_counts(df, settings, spread)).mean() > 0.95
