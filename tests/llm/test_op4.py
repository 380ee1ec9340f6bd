import numpy as np

from folioquill.llm import op4_embeddings
from folioquill.llm.op4_embeddings import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def brute(rows, cosine=0.98):
    ok = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None for x in v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        if np.isfinite(x).all() and x.any():
            ok[i] = (x / np.linalg.norm(x), label, len(x))
    links = {i: [] for i, _, _ in rows}
    for a in ok:
        for b in ok:
            if a < b and ok[a][1:] == ok[b][1:] and ok[a][0] @ ok[b][0] >= cosine:
                links[a].append(b)
                links[b].append(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        base = rng.standard_normal(64)
        for k in range(rng.integers(1, 12)):
            noise = rng.choice([0.0, 0.02, 0.08, 0.13, 0.2])
            rows.append((len(rows), [float(x) for x in (base + noise * rng.standard_normal(64)) * rng.uniform(0.1, 9)], int(rng.integers(0, 2)) if k % 5 == 4 else 0))
    base = rng.standard_normal(64)
    rows += [(len(rows) + k, [float(x) for x in base + 0.05 * rng.standard_normal(64)], 1) for k in range(700)]
    rows += [(len(rows) + k, [float(x) for x in base], 1) for k in range(40)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [None, 1.0], 1), (n + 4, [1.0, 2.0], None), (n + 5, [1.0, 2.0], 3), (n + 6, [1.0, 2.0], 3), (n + 7, [float("inf"), 2.0], 3), (n + 8, [], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    want = brute(rows)
    assert got == {i: (*w, w[1] == i) for i, w in want.items()}


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shape_keeps_the_recall():
    chance = op4_embeddings.bucket_chance(0.98, 1.0)
    miss = lambda tables, k: (1 - chance**k) ** tables
    assert op4_embeddings.shape(1) == op4_embeddings.shape(100_000) == (40, 8)
    for n in (200_000, 10**7, 10**10):
        tables, k = op4_embeddings.shape(n)
        assert 8 < k <= 18 and miss(tables, k) <= miss(40, 8) < 2e-5
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20_000, 16))
    near = x / np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * near).sum(1, keepdims=True) * near
    other = 0.98 * near + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    code = op4_embeddings.hasher(16, 400, 1, 1.0)
    assert abs((code(near) == code(other)).mean() - chance) < 0.01


def test_more_tables_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op4_embeddings, "VECTORS", 20)
    monkeypatch.setattr(op4_embeddings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((8, 32))
    rows = [(i, [float(x) for x in base[i % 8] + 0.1 * rng.standard_normal(32)], i % 3) for i in range(300)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got == brute(rows)
