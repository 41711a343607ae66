"""Mean-field couplings, fields and direct information against dense numpy."""

import os

import numpy as np
import pytest

from sitewise.operators import alignment as A
from sitewise.operators import linear as L
from sitewise.operators import meanfield as M
from sitewise.operators.stored import shared_dir

LENGTH, Q, PSEUDO = 5, 3, 0.5


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.integers(0, Q, (200, LENGTH))
    x[:, 3] = np.where(rng.random(200) < 0.7, x[:, 0], x[:, 3])
    return x


@pytest.fixture(scope="module")
def dense(rows):
    one = np.eye(Q)[rows]
    fi = (1 - PSEUDO) * one.mean(0) + PSEUDO / Q
    fij = (1 - PSEUDO) * np.einsum("nia,njb->ijab", one, one) / len(rows) + PSEUDO / Q**2
    for i in range(LENGTH):
        fij[i, i] = np.diag(fi[i])
    c = fij - np.einsum("ia,jb->ijab", fi, fi)
    c = c[:, :, : Q - 1, : Q - 1].transpose(0, 2, 1, 3).reshape(LENGTH * (Q - 1), -1)
    e = np.zeros((LENGTH, LENGTH, Q, Q))
    e[:, :, : Q - 1, : Q - 1] = -np.linalg.inv(c).reshape(LENGTH, Q - 1, LENGTH, Q - 1).transpose(0, 2, 1, 3)
    return fi, e


@pytest.fixture(scope="module")
def model(spark, rows):
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "seq_idx long, residues array<int>")
    sites = M.regularized_sites(A.site_frequencies(frame, Q), Q, PSEUDO)
    pairs = M.regularized_pairs(A.pair_frequencies(frame), LENGTH, Q, PSEUDO)
    return sites, M.couplings(pairs, sites, LENGTH, Q)


def test_couplings(model, dense):
    got = model[1].collect()
    assert len(got) == LENGTH * (LENGTH - 1) // 2 * Q * Q
    assert all(abs(r.v - dense[1][r.i - 1, r.j - 1, r.a, r.b]) < 1e-9 for r in got)


def test_fields(model, dense):
    fi, e = dense
    got = {(r.i, r.a): r.v for r in M.fields(model[1], model[0], Q).collect()}
    for i in range(LENGTH):
        for a in range(Q):
            want = np.log(fi[i, a] / fi[i, -1]) - sum(e[i, j, a] @ fi[j] for j in range(LENGTH) if j != i)
            assert abs(got[i + 1, a] - want) < 1e-9


def test_direct_information(model, dense):
    fi, e = dense
    got = {(r.i, r.j): r.di for r in M.direct_information(model[1], model[0], Q).collect()}
    assert len(got) == LENGTH * (LENGTH - 1) // 2
    for (i, j), di in got.items():
        p = np.exp(e[i - 1, j - 1])
        for _ in range(2000):
            p = p * (fi[i - 1] / p.sum(1))[:, None]
            p = p * (fi[j - 1] / p.sum(0))[None, :]
        assert abs(di - (p * np.log(p / np.outer(fi[i - 1], fi[j - 1]))).sum()) < 2e-3
    assert max(got, key=got.get) == (1, 4)


def test_independent_fields_are_stationary(spark, rows):
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "seq_idx long, residues array<int>")
    f = np.eye(Q)[rows].mean(0)
    h = np.zeros((LENGTH, Q))
    for r in M.independent_fields(A.site_frequencies(frame, Q), len(rows)).collect():
        h[r.i - 1, r.a] = r.v
    p = np.exp(h) / np.exp(h).sum(1, keepdims=True)
    assert np.abs(f - p - 2 * 0.01 / len(rows) * h).max() < 1e-9


def test_couplings_by_tiles_equal_one_inverse(spark):
    length, q = 11, 4
    rng = np.random.default_rng(5)
    x = rng.integers(0, q, (150, length))
    x[:, 7] = np.where(rng.random(150) < 0.8, x[:, 2], x[:, 7])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "seq_idx long, residues array<int>")
    sites = M.regularized_sites(A.site_frequencies(frame, q), q, PSEUDO)
    pairs = M.regularized_pairs(A.pair_frequencies(frame), length, q, PSEUDO)
    one = np.eye(q)[x]
    fi = (1 - PSEUDO) * one.mean(0) + PSEUDO / q
    fij = (1 - PSEUDO) * np.einsum("nia,njb->iajb", one, one) / len(x) + PSEUDO / q**2
    for i in range(length):
        fij[i, :, i] = np.diag(fi[i])
    c = (fij - np.einsum("ia,jb->iajb", fi, fi))[:, : q - 1, :, : q - 1].reshape(length * (q - 1), -1)
    want = np.zeros((length, q, length, q))
    want[:, : q - 1, :, : q - 1] = -np.linalg.inv(c).reshape(length, q - 1, length, q - 1)
    got = M.couplings(pairs, sites, length, q, tile_rows=6).collect()  # six tiles a side, the last of one position
    assert len({(r.i, r.j, r.a, r.b) for r in got}) == len(got) == length * (length - 1) // 2 * q * q
    assert max(abs(r.v - want[r.i - 1, r.a, r.j - 1, r.b]) for r in got) < 1e-8


def _tiled(spark, matrix, n):
    places = [(i, j) for i in range(0, len(matrix), n) for j in range(i, len(matrix), n)]
    rows = [(i // n, j // n, np.ascontiguousarray(matrix[i : i + n, j : j + n]).tobytes()) for i, j in places]
    return spark.createDataFrame(rows, L.TILES), -(-len(matrix) // n)


def test_tiled_inverse(spark):
    rng = np.random.default_rng(6)
    half = rng.normal(size=(37, 60))
    matrix = half @ half.T / 60
    tiles, n_tiles = _tiled(spark, matrix, 7)
    before = set(os.listdir(shared := shared_dir(spark).removeprefix("file:")))
    got = np.full(matrix.shape, np.nan)
    for r in L.negative_inverse(tiles, n_tiles).collect():
        tile = np.frombuffer(r.m).reshape(min(7, 37 - 7 * r.row), -1)
        got[7 * r.row : 7 * r.row + 7, 7 * r.col : 7 * r.col + 7] = tile
        got[7 * r.col : 7 * r.col + 7, 7 * r.row : 7 * r.row + 7] = tile.T
    assert n_tiles == 6
    assert np.abs(got + np.linalg.inv(matrix)).max() < 1e-8
    assert len([f for f in set(os.listdir(shared)) - before if f.startswith("tiles-")]) == 1  # what the last sweep reads


def test_an_update_gathers_three_tiles_at_most(spark):
    tiles, n_tiles = _tiled(spark, np.eye(24), 3)
    for k in (0, 3, 7):
        rows = L.dealt(tiles, k, n_tiles).groupBy("row", "col").count().collect()
        assert len(rows) == 36 and max(r["count"] for r in rows) == 3
        assert all(r["count"] == 1 for r in rows if k in (r.row, r.col))
