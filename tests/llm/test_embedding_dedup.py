import numpy as np
import pandas as pd
import pytest

from splitboard.llm import embedding_dedup as e


def brute(rows, cosine=0.9):
    """vec_id -> (links, component) by all pairs; equal ids are told apart by their place."""
    vectors = [None if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    return sorted((str(r[0]), links[i], least.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("tasks", [20_000, 2])
def test_small_tables_are_exact(spark, monkeypatch, tasks):
    """Also where a task works through several small shards and blocks."""
    if tasks == 2:
        for name, value in (("MOST_TASKS", tasks), ("SHARD_ROWS", 20), ("BLOCK_ROWS", 50)):
            monkeypatch.setattr(e, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16) * 0.12]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(5, rows[5][1]), (None, rows[7][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] + [1.0] * 15), (305, [float("inf")] * 16)]
    rows += [(306, [1e200] * 16), (307, [1e-200] * 16), (308, [1.0] * 4), (309, [2.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n int")
    got = e.near_duplicates(df).collect()
    unit = [(i, v if v is None or not v or any(c is None for c in v) or max(map(abs, v)) in (0, float("inf")) or v[0] != v[0] else [c / max(map(abs, v)) for c in v]) for i, v in rows]
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == brute(unit)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert e.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_table(spark, sf_small):
    got = {r.vec_id: r.n_links for r in e.op8_embedding_dedup(spark, sf_small).collect()}
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet").orderBy("vec_id").collect()
    x = e.unit(pd.Series([r.embedding for r in table]))
    want = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    found = np.array([got[r.vec_id] for r in table])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum() and len(got) == len(table)


@pytest.mark.parametrize("spread", [0.02, 0.12, 2.0])
def test_recall_of_one_shard(spread):
    """Tight groups, loose groups and noise; wide beams and the whole shard take over where a beam is full."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 32))
    x = centres[np.arange(2400) % 8] + rng.normal(size=(2400, 32)) * spread
    rows = pd.DataFrame({"cls": np.arange(1200), "n": 1, "embedding": list(x[:1200])})
    shard = e.Shard(e.build_shard((32, 0), rows)["payload"][0], 0.9)
    q = e.unit(pd.Series(list(x)))
    found = sum(shard.search(np.arange(i, i + 200), q[i : i + 200])["n"].sum() for i in range(0, 2400, 200))
    true = ((q @ q[:1200].T) >= 0.9).sum() - 1200
    assert 0.97 * true <= found <= true


@pytest.mark.parametrize("rare", [True, False])
def test_a_graph_that_cannot_reach_falls_back_to_the_shard(rare):
    """With the graph's links cut, sparse pairs (one search in ten, or in two, has one) are found by the whole shard."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    q = rng.normal(size=(3000, 32))
    near = np.arange(0, 3000, 10 if rare else 2)
    q[near] = x[near] + rng.normal(size=(len(near), 32)) * 0.05
    rows = pd.DataFrame({"cls": np.arange(3000), "n": 1, "embedding": list(x)})
    shard = e.Shard(e.build_shard((32, 0), rows)["payload"][0], 0.9)
    shard.graph.layers = [np.full_like(links, -1) for links in shard.graph.layers]
    unit = e.unit(pd.Series(list(q)))
    found = sum(shard.search(10_000 + np.arange(i, min(i + 250, 3000)), unit[i : i + 250])["n"].sum() for i in range(0, 3000, 250))
    assert found >= 0.97 * ((unit @ e.unit(rows["embedding"]).T) >= 0.9).sum() > 0.9 * len(near)
