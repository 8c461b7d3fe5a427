import numpy as np
import pytest

from packwright.llm import embed

SF = "/root/testdata/sf0.001"


def plain(rows, least=0.98):
    """Links by all pairs: {position: (n_links, component)}."""
    ok = [i for i, (k, v, l) in enumerate(rows) if k is not None and l is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    links = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
                 and unit[i] @ unit[j] >= least] for i in ok}
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return out


def same(df, rows):
    want = plain(rows)
    got = embed.near_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted(
        (str(rows[i][0]), n, str(c)) for i, (n, c) in want.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    same(df, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("block,leaf,interval", [(512, 128, 16), (7, 3, 2)])
def test_clusters_and_copies(spark, monkeypatch, block, leaf, interval):
    monkeypatch.setattr(embed, "BLOCK_ROWS", block)
    monkeypatch.setattr(embed, "LEAF_ROWS", leaf)
    monkeypatch.setattr(embed, "INTERVAL_BLOCKS", interval)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(8):
        centre = rng.normal(size=9)
        for _ in range(15):
            v = (centre + rng.normal(size=9) * rng.choice([0, 0.05, 0.2])) * rng.choice([1.0, 1e-3, 100.0])
            rows.append((len(rows), v.astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + i, rows[3][1], rows[3][2]) for i in range(20)]
    same(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
            (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [1.0, -0.0], 1),
            (11, [2.0, 0.0], 1), (12, [1.0, 0.0], 2), (13, [1.0], 1), (14, [5.0], 1), (15, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    same(df.selectExpr("*", "'x' AS rep", "1 AS key", "2 AS block"), rows)
    assert embed.near_vectors(df.limit(0)).count() == 0
    same(df.limit(3), rows[:3])
    with pytest.raises(ValueError):
        embed.near_vectors(df, min_cosine=0.1)


def test_boxes_prune():
    x = np.eye(4)[:2] * 1.0
    found = []
    embed._linked(x[:1], x[1:], x[:1], x[1:], 0.2, 0.98, found)
    assert not found
