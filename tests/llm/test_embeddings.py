"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from corvane.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, cid string, n_links int"


def brute(rows):
    """(vec_id, n_links, component_id) by all pairs in double precision."""
    def sound(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    p = list(range(len(rows)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    links = [0] * len(rows)
    scaled = [np.array(r[1]) / np.abs(r[1]).max() if sound(r[1]) else None for r in rows]
    units = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95:
                links[i] += 1
                links[j] += 1
                p[max(find(i), find(j))] = min(find(i), find(j))
    low: dict[int, list] = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r[0])
    return [(r[0], links[i], r[0] if units[i] is None else min((x for x in low[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    far = lambda n, d: [list(map(float, x)) for x in rng.standard_normal((n, d))]
    rows = [(i, v) for i, v in enumerate(far(300, 24))]
    for i in range(0, 60, 3):  # at many cosines around the threshold
        v = np.array(rows[i][1])
        for k, scale in enumerate((0.02, 0.2, 0.3, 0.36)):
            rows.append((1000 + 10 * i + k, list(map(float, v + scale * rng.standard_normal(24)))))
    center = rng.standard_normal(24)
    rows += [(5000 + i, list(map(float, center + 0.1 * rng.standard_normal(24)))) for i in range(120)]
    rows += [(6000 + i, list(map(float, center))) for i in range(30)]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 24), (7003, [float("nan")] * 24), (7004, [1.0, None] * 12), (7005, [float("inf")] + [1.0] * 23), (7006, [0.0] * 24)]
    rows += [(7010, [1.0, 2.0]), (7011, [2.0, 4.0]), (7012, [1.0]), (7013, [3.0]), (7014, [-3.0]), (7015, [1.0, 2.0, 0.0])]
    rows += [(None, list(map(float, center))), (None, far(1, 24)[0]), (7020, [1e300] * 24), (7021, [1e-300] * 24), (5, rows[6][1]), (-3, rows[9][1]), (-(1 << 63), rows[12][1]), ((1 << 63) - 1, rows[12][1])]
    return rows


@pytest.mark.parametrize("most", [4_096, 40])
def test_equals_all_pairs(spark, vectors, most):
    df = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in vectors], SCHEMA).repartition(4)
    got = embed_dedup.dedup_embeddings(df, most=most).collect()
    found, want = order([(r.vec_id, r.n_links, r.component_id) for r in got]), order(brute(vectors))
    total = sum(w[1] for w in want)
    assert sum(f[1] for f in found) <= total and sum(f[1] for f in found) >= 0.995 * total
    assert sum(f != w for f, w in zip(found, want, strict=True)) <= 0.02 * len(want)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_unlike_sizes_of_one_bucket(spark, monkeypatch):
    """Buckets are told apart by the vectors' size too, whatever numbers their hashes make."""
    monkeypatch.setattr(embed_dedup, "keys_of", lambda x, k, tables, probes: np.zeros((len(x), tables, probes), np.int64))
    rows = [(i, [float(i % 3 == k) for k in range(2 + i % 4)] + [1.0]) for i in range(40)]
    got = embed_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert order([(r.vec_id, r.component_id) for r in got]) == order([(w[0], w[2]) for w in brute(rows)])


def test_empty_table(spark):
    assert embed_dedup.dedup_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((3_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((3_000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    for k, (tables, probes) in embed_dedup.PLAN.items():
        a, b = embed_dedup.keys_of(x, k, tables, probes), embed_dedup.keys_of(y, k, tables, probes)
        met = ((a[:, :, :1] == b).any(axis=2) | (a == b[:, :, :1]).any(axis=2)).any(axis=1)
        assert met.mean() > 0.998, k


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(11).standard_normal((5, 64))
    assert np.linalg.norm(embed_dedup.hadamard(x), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    assert embed_dedup.hadamard(embed_dedup.hadamard(x)) == pytest.approx(x)
