"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from lendwell.llm import multiindex


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for label in (1, 2, 3):
        rows += [(x, label) for x in rng.normal(size=(120, 16))]
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * s, label) for s in rng.uniform(0.01, 0.45, 60)]
        rows += [(centre * 2.0, label)] * 5
    rows += [(rows[0][0], 9), (rows[0][0], None), (np.zeros(16), 1), (rows[0][0][:8], 1), (rows[0][0][:8], 1)]
    order = rng.permutation(len(rows))
    out = [(int(k), [float(np.float32(v)) for v in rows[i][0]], rows[i][1]) for k, i in enumerate(order)]
    out += [(1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] * 16, 1), (1004, [], 1)]
    out += [(None, out[3][1], out[3][2]), (out[5][0], out[5][1], out[5][2])]
    return out


def brute(rows, threshold=0.93):
    good = [v is not None and len(v) > 1 and all(c is not None and np.isfinite(c) for c in v) and any(v) and lab is not None for _, v, lab in rows]
    n, links, name = len(rows), [], [r[0] for r in rows]
    adjacent = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold or rows[i][1] == rows[j][1]:
                    adjacent[i].append(j)
                    adjacent[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in adjacent[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        names = [name[j] for j in seen if name[j] is not None]
        out.append((name[i], len(adjacent[i]), min(names) if names else None))
    return out


@pytest.mark.parametrize("blocks", [(4096, 8192), (16, 32)])
def test_links_and_components_equal_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(multiindex, "MEMBERS", blocks[0])
    monkeypatch.setattr(multiindex, "QUERIES", blocks[1])
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cls string")
    got = multiindex.near_duplicates(df).collect()
    want = brute(rows)
    assert len(got) == len(want)
    found, all_links = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert all_links > 1000 and 0.97 * all_links <= found <= all_links
    linked = {w[0]: w for w in want}
    assert np.mean([r.component_id == linked[r.vec_id][2] for r in got]) > 0.97
    assert all(r.n_links <= linked[r.vec_id][1] for r in got)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) or r.vec_id is None for r in got)
    for k in (1000, 1001, 1002, 1003, 1004):
        assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id == k] == [(0, k, True)]


def test_cells_come_in_multi_sequence_order():
    rng = np.random.default_rng(1)
    grid = multiindex.Grid(rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), 20)
    x = rng.normal(size=(30, 8))
    d1, d2 = grid.distances(x)
    sums = (d1[:, :, None] + d2[:, None, :]).reshape(30, -1)
    assert (np.take_along_axis(sums, grid.cells(x), 1) == np.sort(sums, 1)[:, :20]).all()


def test_visits_reach_the_wanted_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = multiindex.Grid.fit(x, 4000, 0.93, 0.95)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * off / np.linalg.norm(off, axis=1)[:, None]
    hit = (grid.cells(x) == grid.cells(y)[:, :1]).any(1)
    assert 0.92 <= hit.mean() <= 0.99


def test_recall_on_planted_neighbours(spark):
    """20,000 vectors, half of them at a cosine just above the threshold of another."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1)[:, None] * x
    y = 0.9302 * x + np.sqrt(1 - 0.9302**2) * off / np.linalg.norm(off, axis=1)[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    got = multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = {r.vec_id for r in got.filter("n_links > 0").collect()}
    recall = sum(i in found for i in range(20_000)) / 20_000
    assert recall >= 0.99, recall


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multiindex.near_duplicates(df).count() == 0
