import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import neighbours, projections

KIND = "vec_id long, embedding array<float>, score int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "z") for i, v in rows], KIND)


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, []), (9006, [float("inf")] + [1.0] * 15)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 16)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD + [(None, x[0].tolist()), (9100, [1.0, 2.0]), (7, x[7].tolist())]
    got = neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, block_rows=64).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    full = x.astype(np.float64)
    for q in range(0, 500, 20):
        s = np.zeros(500)
        for d in range(16):
            s += full[:, d] * full[q, d]
        want = sorted((-s[i], i) for i in range(500) if i != q)[:20]
        assert sorted(found[q]) == [(k + 1, i, -m) for k, (m, i) in enumerate(want)]
    assert sorted(found) == list(range(0, 500, 20))


def test_nearest_of_few(spark):
    df = table(spark, [(0, [1, 0]), (1, [0, 1]), (2, [2, 0])])
    assert [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2, 2.0), (0, 2, 1, 0.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_query_blocks_are_not_sent_through_the_driver(spark, monkeypatch):
    plans = []

    def staged(df, name, put=neighbours.stage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name)

    monkeypatch.setattr(neighbours, "stage", staged)
    df = table(spark, [(0, [1, 0]), (1, [0, 1]), (2, [2, 0])])
    assert neighbours.nearest(df, F.col("vec_id") == 0).count() == 2
    assert len(plans) == 3 and "Join" in plans[2] and "Broadcast" not in plans[2]


def test_projections_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((20, 16))
    x = [rng.standard_normal(16) for _ in range(300)]
    for b in base:
        x += [b + rng.standard_normal(16) * s for s in rng.uniform(0.02, 0.5, 12)]
    x += [base[0]] * 3
    x = np.array(x, np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD + [(None, x[-1].tolist())]
    got = {r.vec_id: r for r in projections.near_duplicates(table(spark, rows)).collect() if r.vec_id is not None}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    near = u @ u.T >= 0.9
    links = near.sum(1) - 1
    root = list(range(len(x)))
    for _ in range(10):
        for a, b in np.argwhere(near):
            root[a] = root[b] = min(root[a], root[b])
    assert sum(got[i].n_links for i in range(len(x))) >= 0.9 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(len(x)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) >= 0.9
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in ODD)
    assert projections.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_counts_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(projections, "TILE_ROWS", 5)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16) + rng.standard_normal((40, 16)) * 0.1
    got = projections.near_duplicates(table(spark, [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))])).collect()
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))


def test_rounds_go_on_while_they_find_links(spark):
    """Pairs in a crowded cone, which a single narrow pass loses."""
    rng = np.random.default_rng(5)
    axis = rng.standard_normal(64)
    axis /= np.linalg.norm(axis)

    def around(n):
        y = rng.standard_normal((n, 64))
        y -= (y @ axis)[:, None] * axis
        return y / np.linalg.norm(y, axis=1)[:, None]

    x = np.sqrt(0.6) * axis + np.sqrt(0.4) * around(4000)
    noise = rng.standard_normal((200, 64))
    near = x[:200]
    noise -= (noise * near).sum(1)[:, None] * near
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    x = np.concatenate((x, 0.92 * near + np.sqrt(1 - 0.92**2) * noise)).astype(np.float32)
    got = {r.vec_id: r for r in projections.near_duplicates(table(spark, list(enumerate(x.tolist()))), passes=1, window=4).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert want.sum() >= 400
    found = sum(got[i].n_links for i in range(len(x)))
    print("recall", found / want.sum())
    assert found >= 0.99 * want.sum()
    assert all(got[i].n_links <= want[i] for i in range(len(x)))
