import hashlib

import numpy as np
import pytest

from docloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n long, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 1, "v", 2, "c") for i, x in rows], SCHEMA)


def plain(rows, k=16, rounds=3):
    """Every vector against every centroid, in whole numbers."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(y is not None and np.isfinite(np.float32(y)) for y in x):
            kept.append((i, [int(np.floor(64 * float(np.float32(y)))) for y in x]))
    mark = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=mark)[:k]]

    def assign():
        out = []
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cs]
            out.append((i, far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(cs)):
            own = [v for (_, v), (_, x, _) in zip(kept, found, strict=True) if x == c]
            if own:
                cs[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for _, x, d in found if x == c) for c in range(len(cs))]
    return sorted(((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def cloud(seed, n, groups=5, spread=0.05):
    r = np.random.default_rng(seed)
    middles = r.normal(0, 0.4, (groups, 64))
    return [(k, (middles[r.integers(groups)] + r.normal(0, spread, 64)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("spread", [0.001, 0.2])
def test_equals_comparison_with_all_centroids(spark, monkeypatch, spread):
    monkeypatch.setattr(centroids, "BLOCK", 64)
    rows = cloud(3, 500, spread=spread)
    want = plain(rows)
    assert result(centroids.cluster(frame(spark, rows).repartition(3))) == want
    assert result(centroids.cluster(frame(spark, rows).coalesce(1))) == want


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = cloud(5, 40)
    odd = [(100, None), (101, []), (102, [0.1] * 63), (103, [0.1] * 65), (104, [0.1] * 63 + [None]), (105, [nan] + [0.1] * 63), (106, [inf] + [0.1] * 63), (107, [-inf] + [0.1] * 63)]
    edge = [(None, [0.3] * 64), (3, good[3][1]), (3, good[3][1]), (3, [-0.25] * 64), (200, [-0.0] * 64), (201, [1e-30] * 64), (202, [-1e-30] * 64), (203, [900.5] * 64), (204, [0.0] * 64)]
    rows = good + odd + edge
    assert result(centroids.cluster(frame(spark, rows))) == plain(rows)


def test_ties_and_equal_vectors(spark):
    rows = [(k, [0.5 if j == k % 4 else 0.0 for j in range(64)]) for k in range(300)] + [(k, [0.25] * 64) for k in range(300, 500)]
    assert result(centroids.cluster(frame(spark, rows))) == plain(rows)


def test_few_and_no_vectors(spark):
    for n in (0, 1, 5):
        rows = cloud(1, n)
        df = centroids.cluster(frame(spark, rows))
        assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert result(df) == plain(rows)


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(frame(spark, [(1, [1e30] * 64)])).collect()


def test_filtering_assigns_whole_nodes_and_prunes_only_what_is_strictly_farther():
    r = np.random.default_rng(0)
    v = np.concatenate([r.integers(-3, 4, (200, 8)) + 50 * c for c in (-1, 0, 1)])
    v = v[centroids.tree_order(v)]
    starts = [b[:-1] for b in centroids.levels(len(v))]
    low, high = (np.concatenate([f.reduceat(v, s) for s in starts]) for f in (np.minimum, np.maximum))
    cs = np.array([[-50] * 8, [0] * 8, [50] * 8, [0] * 8])
    got, whole = centroids.filtered(len(v), v, low, high, cs)
    far = ((v[:, None] - cs[None]) ** 2).sum(2)
    assert (got == far.argmin(1)).all() and sum(b - a for _, a, b, _ in whole) >= 300


def test_large_components_stay_exact():
    r = np.random.default_rng(1)
    v = r.integers(-(1 << 27), 1 << 27, (100, 64))
    cs = r.integers(-(1 << 27), 1 << 27, (7, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in cs] for x in v]
    order = centroids.tree_order(v)
    v = v[order]
    starts = [b[:-1] for b in centroids.levels(len(v))]
    low, high = (np.concatenate([f.reduceat(v, s) for s in starts]) for f in (np.minimum, np.maximum))
    got, _ = centroids.filtered(len(v), v, low, high, cs)
    assert got.tolist() == [want[k].index(min(want[k])) for k in order]
