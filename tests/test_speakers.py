"""Speaker clusters against a slow k-means."""

import numpy as np

from cuelake.operators import media


def slow_kmeans(x, k, rng):
    """Lloyd's steps from random points until nothing moves: labels and cost."""
    centres = x[rng.choice(len(x), k, replace=False)]
    while True:
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
        if np.allclose(moved, centres):
            return label, ((x - centres[label]) ** 2).sum()
        centres = moved


def clusters(spark, x, k):
    rows = [(1, i, v.tolist()) for i, v in enumerate(x)]
    got = media.speaker_cluster(spark.createDataFrame(rows, "media_id long, start_ms long, features array<double>"), k=k).orderBy("start_ms").collect()
    assert len(got) == len(x)
    label = np.array([r["speaker_id"] for r in got])
    centres = {c: x[label == c].mean(0) for c in np.unique(label)}
    nearest = np.array([min(centres, key=lambda c: ((v - centres[c]) ** 2).sum()) for v in x])
    assert (nearest == label).mean() > 0.98  # nothing would move
    return label, sum(((x[label == c] - m) ** 2).sum() for c, m in centres.items())


def test_clusters_are_those_of_a_slow_kmeans(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (n, 4)) for c, n in (((0, 0, 0, 0), 40), ((6, 0, 1, 0), 25), ((0, 7, 0, 2), 15))])
    label, cost = clusters(spark, x, 3)
    best = min((slow_kmeans(x, 3, rng) for _ in range(20)), key=lambda r: r[1])
    assert abs(cost - best[1]) < 1e-6 * best[1] and sorted(np.bincount(label)) == sorted(np.bincount(best[0])) == [15, 25, 40]


def test_number_of_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(8 * c, 0.3, (20, 3)) for c in range(3)])
    label, cost = clusters(spark, x, None)
    assert 2 <= len(np.unique(label)) <= 6 and cost <= slow_kmeans(x, 2, rng)[1] + 1e-9
    assert len(np.unique(clusters(spark, x[:4], None)[0])) == 2
