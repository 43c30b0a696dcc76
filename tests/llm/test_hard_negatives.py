import math

import numpy as np
import pytest

from quillspark.llm import hard_negatives as hn


def brute(rows, s=hn.Settings()):
    used = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [math.floor(s.scale * float(x)) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out, seen = [], set()
    first = lambda x: (-x[0], math.inf if x[1] is None else x[1])
    for i, q, label in used:
        if i is None or i % s.every or (i, tuple(q), label) in seen:
            continue
        seen.add((i, tuple(q), label))
        scored = [(sum(a * b for a, b in zip(q, w)), j, m) for j, w, m in used if j != i]
        for p, j, _ in sorted((x for x in scored if x[2] == label), key=first)[: s.positives]:
            window = [x for x in scored if x[2] != label and s.low * p <= 100 * x[0] <= s.high * p]
            out += [(i, j, n, k, p, score) for n, (score, k, _) in enumerate(sorted(window, key=first)[: s.negatives], 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    kept = [(i, v, label, "x", 0) for i, v, label in rows]
    return spark.createDataFrame(kept, "vec_id long, embedding array<float>, label int, cells string, q int").repartition(4)


def got(found):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect()), key=str)


@pytest.mark.parametrize("kind", ["plain", "blocks", "few cells", "outlier", "copies", "odd"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 12)).astype(np.float32) / 4 + 0.1
    rows = [(3 * i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(400)]
    s = hn.Settings()
    if kind == "blocks":
        s = hn.Settings(every=30, block=7, rows=16)
    elif kind == "few cells":
        s = hn.Settings(cells=4)
    elif kind == "outlier":
        rows[5] = (15, [3e5] + [0.0] * 11, 1)
    elif kind == "copies":  # a third of all vectors is one
        rows = [(i, x[0].tolist() if i % 150 < 50 * 2 else v, y) for i, v, y in rows]
    elif kind == "odd":
        rows += [(50, None, 1), (100, [None] * 12, 1), (200, [math.nan] * 12, 2), (250, [math.inf] + [0.0] * 11, 2), (350, x[1].tolist(), None)]
        rows += [(None, x[3].tolist(), 0), (None, x[4].tolist(), 1), (1000, [0.5, 0.25], 2), (1050, [], 2), (600, x[9].tolist(), 3), (31, x[2].tolist(), 1), (31, x[2].tolist(), 1)]
        rows += [r for r in rows if r[0] == 300]
    assert got(hn.mine(frame(spark, rows), s)) == brute(rows, s)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-200, 200, (300, 6)).astype(np.int64)
    at = np.stack([np.unique(np.clip(np.linspace(x[:, d].min(), x[:, d].max() + 1, 9).astype(int), None, None)) for d in range(6)])
    cells = np.stack([np.searchsorted(at[d, 1:-1], x[:, d], "right") for d in range(6)], 1).astype(np.uint8)
    b = hn.Block(np.arange(40), np.zeros(40, int), x[:40], at)
    low, high = (hn.looked_up(t, cells) for t in b.tables())
    exact = x @ b.x.T
    assert (low <= exact).all() and (exact <= high).all() and ((high - low) < np.abs(exact).max() * 2).all()


def test_empty_and_overflow(spark):
    rows = frame(spark, [(50, [1e18, 0.0], 1), (1, [1e18, 0.0], 1)])
    assert hn.mine(rows.limit(0)).count() == 0 and hn.mine(frame(spark, [(1, [1.0], 0)])).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        hn.mine(rows)
