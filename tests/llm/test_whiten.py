import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packwright.llm import whiten

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """The rows by loops over all vectors, repeats included: {position: (x, deviation)}, n, V, sums."""
    xs = {i: [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for i, (_, v) in enumerate(rows)
          if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    n, dims = len(xs), len(next(iter(xs.values())))
    sums = [sum(x[d] for x in xs.values()) for d in range(dims)]
    centred = np.array([[x[d] - sums[d] / n for d in range(dims)] for x in xs.values()])
    return {i: (x, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in xs.items()}, n, centred.T @ centred / n, sums


def same(df, rows):
    got = whiten.whiten(df, "vec_id").collect()
    vectors, n, cov, sums = plain(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    some = min(8, sum(values > values[0] * 1e-12))
    assert len(got) == some * len(vectors) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((str(r.vec_id), r.component), []).append(r)
    signs = np.zeros(some)
    for c in range(some):
        want = {}
        for i, (x, deviation) in vectors.items():
            z = (np.array(x) - np.array(sums) / n) @ axes[:, c] / np.sqrt(values[c])
            want.setdefault(str(rows[i][0]), []).append((z, deviation))
        for key, zs in want.items():
            found = sorted((r.whitened, r.deviation) for r in by[key, c + 1])
            for sign in (1, -1):
                if np.allclose([f[0] for f in found], sorted(sign * z for z, _ in zs), atol=1e-6):
                    signs[c] += sign if abs(zs[0][0]) > 1e-3 and len(zs) == 1 else 0
                    break
            else:
                raise AssertionError((key, c, found, zs))
            assert sorted(f[1] for f in found) == sorted(d for _, d in zs)
            assert all(int(r.deviation_digits) == r.deviation for r in by[key, c + 1])
        assert all(abs(r.explained - values[c] / np.trace(cov)) < 1e-9 for r in by.get((str(rows[0][0]), c + 1), ()))
    assert all(abs(s) > 1 or len(vectors) < 4 for s in signs)
    assert max(r.identity_error for r in got) < 1e-8
    return got


def test_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    same(df, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("share", [3, 1000])
def test_copies_and_odd_rows(spark, monkeypatch, share):
    monkeypatch.setattr(whiten, "HOT_SHARE", share)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 10)).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(40)] + [(100 + i, base[3].tolist()) for i in range(30)]
    rows += [(None, base[4].tolist()), (7, base[4].tolist()), (7, base[7].tolist()), (900, [70.0] * 10), (901, [1e3] * 10)]
    odd = [(1, None), (2, [None] + [1.0] * 9), (3, [float("nan")] * 10), (4, [float("inf")] * 10), (5, []), (6, [1.0]), (7, [3e38] * 10)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "dims", "copies", "_0")})
    same(df, rows)
    assert whiten.whiten(df.limit(0), "vec_id").count() == 0
    assert whiten.whiten(spark.createDataFrame(odd[:5], SCHEMA), "vec_id").count() == 0
    assert whiten.whiten(spark.createDataFrame([rows[3], rows[3]], SCHEMA), "vec_id").count() == 0


def test_few_directions(spark):
    rows = [(i, [float(i % 5), float(i % 3), float(i % 5)]) for i in range(30)]
    got = same(spark.createDataFrame(rows, SCHEMA), rows)
    assert {r.component for r in got} == {1, 2}


def test_beyond_long():
    model = whiten.Whitening(10 ** 9, [10 ** 9 * 100_000, 0], np.ones(1), np.eye(2)[:, :1], 1.0)
    x = np.array([[100_000 + 7, 10 ** 9], [100_000, 1]])
    assert model.deviations(x) == [49 * 10 ** 18 + 10 ** 36, 10 ** 18]
    packed = whiten._packed(np.array([[100_001, 99_999], [5 * 10 ** 12, 3], [10 ** 6, 0], [32_768 + 100_000, 100_000], [-32_768 + 100_000, 100_000]]))
    assert [len(p) for p in packed] == [4, 16, 8, 8, 8]
