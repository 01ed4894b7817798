"""Points sent to the cells that can hold their neighbours, a few thousand at a time."""

import tracemalloc

import numpy as np
import pandas as pd

from creditlake.operators import smote


def test_routes_are_handed_on_in_small_frames():
    rng = np.random.default_rng(1)
    points, pivot = rng.normal(size=(3000, 24)), rng.normal(size=(1200, 24))
    pdf = pd.DataFrame({"id": np.arange(3000), "vec": list(points)})
    size, radius = np.where(np.arange(1200) % 5 > 0, 3.0, 0.0), np.where(np.arange(1200) % 5 > 0, 4.0, -np.inf)
    found = rows = 0
    tracemalloc.start()
    for frame in smote._routed(pdf, pivot, size, radius, 5):
        assert len(frame) <= smote.HANDED_ON
        rows += len(frame)
        found += int((frame["id"].to_numpy().astype(np.int64) * 1200 + frame["cell"].to_numpy()).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = np.sqrt(((points[:, None, :] - pivot) ** 2).sum(axis=2))
    upper = np.where(size > 0, d + radius, np.inf)
    bound = np.sort(upper, axis=1)[:, 1]  # two cells of three hold six points
    who, cell = np.nonzero((size > 0) & (d - radius <= bound[:, None] * (1 + 1e-9)))
    assert rows == len(who) and found == int((who * 1200 + cell).sum())
    assert peak < 200e6 and rows > 1_000_000
