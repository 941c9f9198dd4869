import os
import tracemalloc
from datetime import datetime

import numpy as np
import pytest

from quarrylens.llm import vectors
from quarrylens.llm.vectors import Quantizer, fit, similar_pairs

SCHEMA = "id string, embedding array<float>, ingested_at timestamp_ntz, vector string, cell long"
AT = datetime(2026, 1, 1)


def clusters(n, size, seed, noise=0.5, d=384):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n, d))
    x = np.repeat(centres, size, 0) + noise * rng.standard_normal((n * size, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(ids, x, k, t):
    x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= t)[:k]
        out |= {(ids[i], j) for _, j in near}
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in e], AT, "x", 1) for i, e in zip(ids, x)], SCHEMA)


@pytest.mark.parametrize(("cell", "block"), [(500, 20_000), (16, 20_000), (100, 40)])
def test_recall_against_brute_force(spark, cell, block):
    x = clusters(60, 9, 3)
    ids = [f"{i:08x}-0000-0000-0000-{i:012x}" for i in range(len(x))]
    got = {(r["id"], r["other"]) for r in similar_pairs(frame(spark, ids, x), block_rows=block, cell_rows=cell, task_rows=100).collect()}
    want = brute(ids, x, 5, 0.75)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_equal_vectors_and_odd_ids(spark):
    x = clusters(5, 2, 1, 0.3)
    ids = [f"v{i}" for i in range(len(x))]
    same = [f"copy{i:02d}" for i in range(12)]
    rows = frame(spark, ids, x).unionByName(frame(spark, same + ["fifteen-letters"], np.repeat(x[:1], 13, 0)))
    got = {}
    for r in similar_pairs(rows).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert got["copy00"] == {"copy01", "copy02", "copy03", "copy04", "copy05"}
    assert got["copy11"] == got["v0"] == got["fifteen-letters"] == {"copy00", "copy01", "copy02", "copy03", "copy04"}
    assert all(len(v) <= 5 for v in got.values()) and got["v1"] == {"copy00", "copy01", "copy02", "copy03", "copy04"} and got["v2"] == {"v3"}


def test_unusable_rows_versions_and_empty(spark):
    x = clusters(1, 4, 2, 0.1)
    good = [[float(v) for v in e] for e in x]
    bad = [None, [], good[0][:383], [0.0] * 384, [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], [None, *good[0][1:]]]
    rows = [(f"b{i}", e, AT, "x", 1) for i, e in enumerate(bad)] + [("A", good[0], AT, "x", 1), ("b", good[1], AT, None, None), (None, good[2], AT, "x", 1)]
    rows += [("old", good[2], AT, "x", 1), ("OLD ", [0.0] * 384, datetime(2026, 1, 2), "x", 1), ("b", good[1], AT, None, None), ("n", good[3], None, "x", 1)]
    got = {(r["id"], r["other"]) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "b"), ("b", "a"), ("a", "n"), ("n", "a"), ("b", "n"), ("n", "b")}
    assert similar_pairs(spark.createDataFrame(rows[:3], SCHEMA)).count() == 0
    assert similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_decode_to_what_is_scored():
    x = clusters(20, 10, 5)
    model = fit(x, 0.75, codewords=16)
    codes, norms, cells = model.encode(x)
    decoded = sum(model.books[j][codes[:, j]] for j in range(codes.shape[1]))
    assert np.allclose(np.linalg.norm(decoded, axis=1), norms, atol=1e-3)
    assert np.allclose(model.scores(model.tables(x[:5]), codes, norms), x[:5] @ decoded.T / norms, atol=1e-4)
    greedy = Quantizer(model.books)
    beam_error = ((x - decoded) ** 2).sum()
    c1 = greedy.encode(x, beam=1)[0]
    assert beam_error <= ((x - sum(model.books[j][c1[:, j]] for j in range(c1.shape[1]))) ** 2).sum() + 1e-3
    assert (cells[:, 0] == codes[:, 0]).mean() > 0.5


def hot_group(seed, n=3000):
    """A third of the vectors around one centre at cosine about 0.8, the rest in groups of 8."""
    rng = np.random.default_rng(seed)
    hot = rng.standard_normal(384) + 0.5 * rng.standard_normal((n // 3, 384))
    x = np.concatenate([(hot / np.linalg.norm(hot, axis=1, keepdims=True)).astype(np.float32), clusters(n * 2 // 3 // 8, 8, seed + 1)])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize(("block", "cell"), [(20_000, 16), (400, 16), (400, 500)])
def test_recall_in_a_hot_group(spark, block, cell):
    x = hot_group(11)
    ids = [f"{i:08x}-0000-0000-0000-{i:012x}" for i in range(len(x))]
    got = {(r["id"], r["other"]) for r in similar_pairs(frame(spark, ids, x), block_rows=block, cell_rows=cell).collect()}
    want = brute(ids, x, 5, 0.75)
    hot = {ids[i] for i in np.flatnonzero((x @ x.T > 0.7).sum(1) > 100)}
    in_hot = {p for p in want if p[0] in hot}
    assert len(hot) == 1000 and len(got & in_hot) >= 0.9 * len(in_hot)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_more_cells_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_CELLS", 64)
    x = hot_group(12, 1500)
    ids = [f"{i:08x}-0000-0000-0000-{i:012x}" for i in range(len(x))]
    want = brute(ids, x, 5, 0.75)
    for cell in (500, 100, 20):
        got = {(r["id"], r["other"]) for r in similar_pairs(frame(spark, ids, x), cell_rows=cell).collect()}
        assert len(got & want) >= 0.95 * len(want)


def test_one_version_of_an_id_holds(spark):
    x = clusters(2, 2, 4, 0.1)
    v = [[float(e) for e in row] for row in x]
    rows = [("a", v[0], AT, "", 1), ("a", v[2], None, "", 1), ("b", v[1], AT, "", 1), ("c", v[3], AT, "", 1), ("t", v[0], AT, "", 1), ("t", v[2], AT, "", 1)]
    got = {(r["id"], r["other"]) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    t_with = {o for i, o in got if i == "t"}
    assert ("a", "b") in got and ("a", "c") not in got and t_with in ({"a", "b"}, {"c"})


def test_model_is_made_away_from_the_driver(spark, monkeypatch):
    driver = os.getpid()

    def away(*args, **kwargs):
        assert os.getpid() != driver
        return fit(*args, **kwargs)

    monkeypatch.setattr(vectors, "fit", away)
    x = clusters(20, 4, 6, 0.2)
    rows = frame(spark, [f"v{i}" for i in range(len(x))], x)
    assert similar_pairs(rows.unionByName(rows)).count() == len(x) * 3


def test_encoding_takes_bounded_memory():
    rng = np.random.default_rng(1)
    model = Quantizer([rng.standard_normal((k, 384), dtype=np.float32) for k in (4096, 256)])
    x = rng.standard_normal((8000, 384), dtype=np.float32)
    tracemalloc.start()
    codes, norms, cells = model.encode(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(codes) == len(norms) == len(cells) == len(x) and peak < 150e6


def test_copies_match_brute_force_and_pairs_are_sent_once(spark):
    x = np.repeat(clusters(6, 4, 7, 0.2), [1, 2, 1, 3, 7, 1, 1, 1, 2, 2, 2, 2, 1, 9, 1, 1, 6, 5, 4, 1, 1, 1, 1, 8], 0)
    ids = [f"{i * 37 % 97:02d}" for i in range(len(x))]
    pairs = similar_pairs(frame(spark, ids, x))
    rows = [(r["id"], r["other"]) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(ids, x, 5, 0.75)
    # vectors go to their cells, pairs to their id
    assert pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ShuffleQueryStage") == 2
    edges = [(r["a"], r["b"]) for r in vectors.similar_edges(frame(spark, ids, x)).collect()]
    assert len(edges) == len(set(edges)) and set(edges) == {tuple(sorted(p)) for p in rows}


def test_a_pair_met_twice_counts_once():
    names = np.array([b"a", b"b", b"c", b"a"], dtype=object)
    left, right = np.array([0, 3, 0, 1]), np.array([1, 1, 2, 2])
    got = vectors._best(names, left, right, np.array([0.8, 0.800001, 0.8, 0.9]), 1).to_pylist()
    assert [(r["id"], r["other"], r["similarity"]) for r in got] == [(b"a", b"b", 0.800001), (b"b", b"c", 0.9)]
