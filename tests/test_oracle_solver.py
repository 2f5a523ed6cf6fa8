"""The SQL Gauss-Jordan solver behind the ridge and logistic-regression oracles, against numpy (DuckDB only)."""

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.plans.oracle import _gauss_jordan


def _solve_sql(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = len(b)
    rows = [(i, j, float(a[i, j])) for i in range(n) for j in range(n)] + [(i, n, float(b[i])) for i in range(n)]
    con = duckdb.connect()
    con.execute("CREATE TABLE aug (i INTEGER, j INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO aug VALUES (?, ?, ?)", rows)
    out = con.execute(f"WITH RECURSIVE {_gauss_jordan('gj', 'aug', str(n))} "
                      f"SELECT i, v FROM gj WHERE k = {n} AND j = {n} ORDER BY i").fetchall()
    return np.array([v for _, v in out])


@settings(max_examples=25, deadline=None)
@given(n=st.integers(1, 8), seed=st.integers(0, 10_000))
def test_gauss_jordan_matches_numpy_on_spd(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3 * n, n))
    a = x.T @ x + np.eye(n)          # ridge-shaped: symmetric positive definite
    b = rng.normal(size=n)
    np.testing.assert_allclose(_solve_sql(a, b), np.linalg.solve(a, b), rtol=1e-9, atol=1e-12)


def test_gauss_jordan_collinear_columns_with_penalty():
    # one-hot levels summing to the intercept column: singular X'X, made definite by the penalty
    x = np.array([[1, 0, 1], [0, 1, 1], [1, 0, 1], [0, 1, 1]], dtype=float)
    a = x.T @ x + np.eye(3)
    b = np.array([1.0, 2.0, 3.0])
    np.testing.assert_allclose(_solve_sql(a, b), np.linalg.solve(a, b), rtol=1e-12)
