"""Small matrices to and from the tables of the library."""

import numpy as np

from wavemill.operators.matrix import cells
from wavemill.operators.selection import positions


def dense_of(spark, matrices, **more):
    """Dense records of numpy matrices by id; further keyword arguments are arrays of the same shapes."""
    rows = []
    for name, m in matrices.items():
        m = np.asarray(m, dtype=float)
        extra = [np.asarray(more[k][name], dtype=float).ravel().tolist() for k in more]
        rows.append((name, m.shape[0], m.shape[1], m.ravel().tolist(), *extra))
    columns = "".join(f", {k} array<double>" for k in more)
    return spark.createDataFrame(rows, f"matrix_id string, n_rows int, n_cols int, vals array<double>{columns}")


def rows_of(spark, matrices):
    rows = [(n, i, [float(x) for x in r]) for n, m in matrices.items() for i, r in enumerate(np.asarray(m, float))]
    return spark.createDataFrame(rows, "matrix_id string, i bigint, row array<double>")


def matrix_from(dense, column):
    return {r.matrix_id: np.array(r[column]).reshape(r.n_rows, r.n_cols) for r in dense.collect()}


def places(dense, keep="keep"):
    """Kept places by matrix, from records."""
    out = {}
    for r in positions(dense, keep).collect():
        out.setdefault(r.matrix_id, set()).add((r.k, r.l))
    return out


def basis(n):
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    b = np.sqrt(2.0 / n) * np.cos(np.pi * (2 * i + 1) * k / (2.0 * n))
    b[0] = np.sqrt(1.0 / n)
    return b


def dct(m):
    return basis(m.shape[0]) @ m @ basis(m.shape[1]).T


__all__ = ["basis", "cells", "dct", "dense_of", "matrix_from", "places", "rows_of"]
