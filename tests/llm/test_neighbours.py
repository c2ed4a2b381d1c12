import numpy as np
import pytest

from lectern.llm import neighbours as nn


def brute(ids, x, k):
    d = ((x[:, None, :].astype(float) - x[None].astype(float)) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {int(i): {int(ids[j]) for j in np.lexsort((ids, d[r].round(7)))[:k]} for r, i in enumerate(ids)}


def recall(rows, truth):
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, set()).add(r.neighbour_id)
    return sum(len(found.get(i, set()) & t) for i, t in truth.items()) / sum(map(len, truth.values()))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_stored_vectors(spark, size):
    vectors = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    pdf = vectors.toPandas()
    truth = brute(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]), nn.K)
    rows = nn.neighbours(vectors).collect()
    truth = {i: t for i, t in truth.items() if i % nn.EVERY == 0}
    assert recall(rows, truth) >= 0.9
    assert {r.vec_id for r in rows} == set(truth)
    every = {r.vec_id for r in nn.neighbours(vectors, every=1).select("vec_id").distinct().collect()} if size == "sf0.01" else set(pdf["vec_id"].tolist())
    assert every == set(pdf["vec_id"].tolist())
    assert all(r.vec_id != r.neighbour_id for r in rows)


@pytest.mark.parametrize("shard, cell", [(64, 16), (8192, 2048)])
def test_recall_over_several_shards(spark, monkeypatch, shard, cell):
    """Small shards and cells, so lists span several of them and queries travel."""
    monkeypatch.setattr(nn, "SHARD", shard)
    monkeypatch.setattr(nn, "CELL", cell)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(700, 24)), r.normal(size=(300, 24)) * 0.1 + r.normal(size=24)]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    rows = nn.neighbours(vectors, every=1).collect()
    assert recall(rows, brute(np.arange(1000), x, nn.K)) >= 0.9
    assert {r.vec_id for r in rows} == set(range(1000)) and {r.vec_id for r in nn.neighbours(vectors).collect()} == set(range(0, 1000, 50))
    exact = {(a.vec_id, a.neighbour_id): a.distance for a in rows}
    for (a, b), d in list(exact.items())[:50]:
        assert abs(((x[a].astype(float) - x[b].astype(float)) ** 2).sum() - d) < 1e-3


def test_abandoned_candidates_are_far():
    r = np.random.default_rng(6)
    turn = nn.rotation(64)
    q, x = r.normal(size=(40, 64)) @ turn, r.normal(size=(500, 64)) @ turn
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    bounds = np.sort(d, axis=1)[:, 9]
    i, j, part = nn.scan(q, bounds, x)
    kept = set(zip(i.tolist(), j.tolist()))
    true = {(a, b) for a in range(40) for b in np.flatnonzero(d[a] <= bounds[a])}
    assert len(kept & true) >= 0.95 * len(true) and kept <= true
    assert np.allclose(part, d[i, j])


def test_bound_tightens_and_lists_are_respected():
    r = np.random.default_rng(7)
    q, x = r.normal(size=(20, 32)), r.normal(size=(600, 32))
    member_lists, lists = r.integers(0, 12, 600), [np.sort(r.choice(12, 5, replace=False)) for _ in range(20)]
    i, j, d = nn.probe(np.full(20, -1), q, np.full(20, np.inf), lists, np.arange(600), x, member_lists, 5)
    truth = ((q[:, None] - x[None]) ** 2).sum(2)
    hits = 0
    for row in range(20):
        mine = np.flatnonzero(np.isin(member_lists, lists[row]))
        best = set(mine[np.argsort(truth[row, mine])[:5]].tolist())
        assert set(j[i == row].tolist()) <= set(mine.tolist())
        hits += len(best & set(j[i == row].tolist()))
    assert hits >= 0.9 * 100


def test_odd_rows(spark):
    schema = "list int, vec_id bigint, VEC_ID string, embedding array<float>, v string"
    nan, inf = float("nan"), float("inf")
    good = [(0, i, "c", [float(i), 0.0], "v") for i in range(5)]
    odd = [(0, None, "c", [1.0, 1.0], "v"), (0, 10, "c", None, "v"), (0, 11, "c", [], "v"), (0, 12, "c", [nan, 1.0], "v"), (0, 13, "c", [inf, 1.0], "v"), (0, 14, "c", [1.0, None], "v"), (None,) * 5, (0, 4, "c", [4.0, 0.0], "v"), (0, 20, "c", [0.0, 0.0], "v")]
    other = [(0, 30, "c", [1.0, 2.0, 3.0], "v"), (0, 31, "c", [1.0, 2.0, 5.0], "v"), (0, 3, "c", [100.0, 0.0], "v"), (0, 40, "c", [1.0] * 4, "v")]
    rows = nn.neighbours(spark.createDataFrame(good + odd + other, schema), k=2, every=1).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 3, 4, 20, 30, 31}
    by = {(r.vec_id, r.rank): (r.neighbour_id, r.distance) for r in rows}
    assert by[(0, 1)] == (20, 0.0) and by[(1, 1)] == (0, 1.0) and by[(1, 2)] == (2, 1.0)  # ties by id
    assert by[(30, 1)] == (31, 4.0) and (30, 2) not in by  # only its own dimension
    assert by[(3, 1)] == (2, 1.0)  # of its two vectors the nearer counts
    assert nn.neighbours(spark.createDataFrame([], schema)).collect() == []
    assert nn.neighbours(spark.createDataFrame(good[:1], schema), every=1).collect() == []
