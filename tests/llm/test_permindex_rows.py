import numpy as np

from tidemark.llm import permindex as P


def test_rerank_equals_a_full_sort():
    """Also where many rows are equal or differ by less than rounding."""
    rng = np.random.default_rng(4)
    u = P.unit(rng.normal(size=(300, 16)))
    u[40:120] = u[5]
    u[120:140] = P.unit(u[5:6] + 1e-12 * rng.normal(size=(20, 16)))
    firsts = rng.permutation(300)
    for q in (u[5], u[200], P.unit(rng.normal(size=(1, 16)))[0]):
        for rows in (np.arange(300), np.arange(3), np.arange(0, 300, 2)):
            score = P.cosines(u[rows], q)
            want = np.lexsort((firsts[rows], -score))[:6]
            got, near = P.nearest_rows(u, rows, firsts, q, 6)
            assert got.tolist() == rows[want].tolist() and near.tolist() == score[want].tolist()


def test_files_hold_every_place_once():
    lists = np.array([[2, 0], [1, 2], [2, 1]], np.int16)
    assert P.Shard(lists, 4).files.tolist() == [[1, 0, 0], [0, 2, 1], [2, 1, 2], [0, 0, 0]]
