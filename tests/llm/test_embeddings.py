import numpy as np
import pytest

from sievework.llm import embeddings


def make(seed=0, n=160, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    out = [base[i] for i in range(n)]
    for i in range(n // 2):
        for scale in (0.1, 0.17, 0.2, 0.205, 0.25):
            noise = rng.normal(size=dim)
            noise -= noise @ base[i] * base[i] / (base[i] @ base[i])
            out.append(3 * (base[i] + noise * scale * np.linalg.norm(base[i]) / np.linalg.norm(noise)))
    rows = [(k, v.astype(np.float32).tolist(), int(k % 3)) for k, v in enumerate(out)]
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(40)] + [(2000 + k, rows[0][1], 0) for k in range(10)]
    rows += [(3000, None, 1), (3001, [0.0] * dim, 1), (3002, [None] + [1.0] * (dim - 1), 1), (3003, [float("nan")] * dim, 1), (3004, rows[3][1], None), (3005, [], 1), (3006, [float("inf")] * dim, 1), (3007, [1.0, 2.0], 0), (3008, [2.0, 4.0], 0), (None, rows[5][1], rows[5][2]), (7, rows[7][1], rows[7][2]), (3009, [-0.0, 1.0], 2), (3010, [0.0, 1.0], 2)]
    return rows


def brute(rows, threshold=0.98):
    vectors = []
    for _, v, label in rows:
        good = v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, float) if good else None)
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            x, y = vectors[i], vectors[j]
            if x is None or y is None or rows[i][2] != rows[j][2] or len(x) != len(y):
                continue
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted(((k, links[i], low.get(root(i)), k is not None and k == low.get(root(i))) for i, (k, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile", [32, 4096])
def test_equals_brute_force(spark, tile):
    rows = make()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, kept string")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df, tile=tile).collect()), key=str)
    assert got == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64)) * rng.lognormal(0, 3, (400, 1))
    x[:200] *= rng.lognormal(0, 2, (200, 64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes, step, error = embeddings.quantise(unit)
    assert np.abs(codes).max() <= 127
    approximate = (codes @ codes.T) * (step[:, None] * step[None, :])
    slack = error[:, None] * (1 + error[None, :]) + error[None, :] * (1 + error[:, None])
    assert (np.abs(unit @ unit.T - approximate) <= slack).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).count() == 0


def test_huge_and_tiny_vectors_link_by_direction(spark):
    base = np.array([3.0, -4.0, 0.5])
    rows = [(k, (base * s).tolist(), 1) for k, s in enumerate((1.0, 1e200, 1e-200, 1e-310, 7e307 / 4))] + [(10, [0.0, 0.0, 1e300], 1), (11, [0.0, 5e-324, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert found == {**{k: (4, 0) for k in range(5)}, 10: (0, 10), 11: (0, 11)}
