"""Whitening and hard negatives against plain versions, and their edge cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import catalog, negatives, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
NAN = float("nan")
ODD = [
    (0, [0.5, -0.25, 0.1], 1),
    (0, [0.5, -0.25, 0.1], 1),
    (1, [0.5, -0.25, 0.1], 1),
    (2, None, 1),
    (3, [0.1, None, 0.2], 1),
    (4, [0.1, NAN, 0.2], 2),
    (5, [0.1, float("-inf"), 0.2], 2),
    (6, [0.4, -0.2], 2),
    (7, [0.5, -0.3, 0.2], None),
    (8, [], 3),
    (None, [0.3, 0.3, -0.3], 3),
    (9, [0.45, -0.2, 0.15], 3),
    (10, [-0.4, 0.25, 0.9], 1),
    (14, [0.4, -0.25, 0.05], 1),
    (50, [0.4, -0.25, 0.05], 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, VECTORS).withColumns({c: F.lit("x") for c in ("id", "x", "component", "rank", "score", "i", "n")})


def plain_whitening(vectors, k=16):
    """Distinct whole vectors, their mean and covariance, and numpy's eigenvectors."""
    x = np.floor(64 * vectors.astype(float)) + 1_000_000
    fit = np.unique(x, axis=0)
    z = fit - fit.mean(axis=0)
    values, vecs = np.linalg.eigh(z.T @ z / len(fit))
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    return x, fit, values, vecs, np.trace(z.T @ z / len(fit))


def test_whitening_equals_a_plain_version(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x, fit, values, vecs, trace = plain_whitening(np.array([r.embedding for r in rows], np.float32))
    out = whitening.whiten(table.unionByName(table)).distinct().orderBy("vec_id", "component").collect()
    assert len(out) == 16 * len(rows) and {r.n for r in out} == {len(fit)}
    got = np.array([r.whitened for r in out]).reshape(-1, 16)
    want = (x - fit.mean(axis=0)) @ vecs / np.sqrt(values)
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-6)
    assert np.allclose([r.explained for r in out[:16]], values / trace, rtol=1e-9)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9
    s, n = [int(c) for c in fit.sum(axis=0)], len(fit)
    assert [r.deviation for r in out[::16]] == [sum((n * int(c) - t) ** 2 for c, t in zip(v, s)) for v in x]


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0.5], [3] * 6, [1, 0, 0, 0, 0, 0], [2, 2 - 1e-9, 2 - 2e-9, 1, 1e-7, 0], [7], [4, 4]])
def test_components_of_clusters(values):
    """Equal, close and vanishing eigenvalues, rotated and as a diagonal."""
    size, rng = len(values), np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
    for matrix in (turn @ np.diag(values) @ turn.T, np.diag(values[::-1]).astype(float)):
        found, vectors = whitening.leading_components(matrix, size)
        assert np.allclose(found, sorted(values, reverse=True), atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-10)
        assert np.allclose(matrix @ vectors, vectors * found, atol=1e-8)


def test_components_of_random_matrices():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 40, 130):
        a = rng.standard_normal((size, 2 * size))
        matrix = a @ a.T + np.eye(size)
        found, vectors = whitening.leading_components(matrix, 16)
        values = np.linalg.eigvalsh(matrix)[::-1][:16]
        assert np.allclose(found, values, rtol=1e-12)
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * values[0]
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
    d, e, _ = whitening.tridiagonal(matrix)
    at = np.linspace(0, 1.01 * values[0], 50)
    assert whitening.counts_below(d, e, at).tolist() == [(np.linalg.eigvalsh(matrix) < t).sum() for t in at]


def test_whitening_of_odd_rows(spark, odd):
    out = whitening.whiten(odd).collect()
    assert len(out) == 11 * 3 and {r.component for r in out} == {1, 2, 3}
    assert {r.vec_id for r in out} == {0, 1, 6, 7, 8, None, 9, 10, 14, 50} and {r.n for r in out} == {8}
    assert out[0].identity_error < 1e-9 and abs(sum(r.explained for r in out if r.vec_id == 6) - 1) < 1e-9
    same = spark.createDataFrame([(k, [0.5, 0.25], 1) for k in range(5)], VECTORS)
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).collect()} == {(1, 0, None, 0.0, 0.0)}
    for rows in ([], [(1, [], 1)], [(1, None, 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    far = spark.createDataFrame([(k, [3e38 * (-1) ** k, float(k)], 1) for k in range(4)], VECTORS)
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}


def test_products_over_residues_are_exact():
    rng = np.random.default_rng(3)
    for size, most in ((1, 1), (64, 256), (65, 300), (700, 2**18), (3, 2**26)):
        a, b = (rng.integers(-most, most + 1, (7, size)) for _ in range(2))
        a[0], b[0], b[1] = most, most, -most
        primes = negatives.primes_for(size * most * most)
        want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
        assert negatives.product(negatives.residues(a, primes), negatives.residues(b, primes), primes).tolist() == want
    with pytest.raises(ValueError):
        negatives.primes_for(1 << 60)


def plain_negatives(rows):
    held = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        x = [math.floor(256 * float(c)) for c in vector]
        held[vec_id] = min(held.get(vec_id, (label, x)), (label, x))
    out = []
    for a, (la, xa) in held.items():
        if a % 50:
            continue
        scores = sorted((-sum(p * q for p, q in zip(xa, xb)), b, lb) for b, (lb, xb) in held.items() if b != a)
        for sp, p, _ in [s for s in scores if s[2] == la][:5]:
            fits = [s for s in scores if s[2] != la and 50 * -sp <= 100 * -s[0] <= 95 * -sp]
            out += [(a, p, r + 1, s[1], -sp, -s[0]) for r, s in enumerate(fits[:3])]
    return sorted(out)


def test_negatives_equal_a_plain_version(spark, sf, odd, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in table.collect()]
    again = [(r[0] + 10_000, r[1], (r[2] + 1) % 10) for r in rows[:200]] + [(20_000 + k, rows[0][1], k % 2) for k in range(120)]
    every = spark.createDataFrame(rows + again, VECTORS)
    want = plain_negatives(rows + again)
    assert len(want) > 100 and sorted(map(tuple, negatives.mine(every).collect())) == want
    # Many blocks, tiles and pieces.
    for name, value in (("ANCHORS", 3), ("ROWS", 50), ("TILE_ANCHORS", 2), ("TILE_ROWS", 7), ("DEPTH", 10)):
        monkeypatch.setattr(negatives, name, value)
    assert sorted(map(tuple, negatives.mine(every).collect())) == want
    odd_rows = [tuple(r)[:3] for r in odd.collect()]
    assert sorted(map(tuple, negatives.mine(odd).collect())) == plain_negatives(odd_rows) != []
    assert negatives.mine(odd.limit(0)).count() == 0 and negatives.mine(odd.where("vec_id = 2")).count() == 0


def test_negatives_equal_their_sql(spark, odd, sf, tmp_path):
    for name, table in (("odd", odd.select("vec_id", "embedding", "label")), ("whole", spark.read.parquet(f"{sf}/embeddings.parquet"))):
        table.write.parquet(f"{tmp_path}/{name}")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        assert sorted(db.execute(negatives.ORACLE_SQL).fetchall()) == sorted(map(tuple, negatives.mine(table).collect()))


def test_vector_queries_read_their_tables(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    queries = catalog.queries()
    assert queries["op11_embedding_whitening"](spark, sf).count() == 16 * n
    assert queries["op13_hard_negatives"](spark, sf).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
