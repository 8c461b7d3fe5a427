"""Whitening of vectors by the covariance of their distinct values, weighted by how often each occurs.

Entries become whole numbers, so equal vectors are found by grouping and sums are exact. Only distinct vectors are
multiplied and whitened, each once; rows get the result of theirs by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import materialize, starts_of, take_runs

#: x = floor(SCALE * entry) + SHIFT
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: A vector that makes up more than one in so many rows is joined by broadcast; there are fewer such vectors than this.
HOT_SHARE = 1000
#: Whole numbers beyond this are no entries.
_LIMIT = float(1 << 62)
_WIDTHS = ((1 << 15, "<i2"), (1 << 31, "<i4"), (None, "<i8"))
_EXACT = pa.decimal128(38, 0)


@dataclass
class Whitening:
    """n and the exact sums of x, the leading eigenvalues, their unit vectors as columns, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean; the whole part is taken off in whole numbers, so nothing is lost for large x."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n x - S) squared."""
        reach = max(abs(int(x.min())), abs(int(x.max())), 1) * self.n + max(map(abs, self.sums), default=0) if x.size else 0
        kind = np.int64 if reach * reach * max(1, x.shape[1]) < 1 << 62 else object
        d = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) for v in (d * d).sum(axis=1)]


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the narrowest width that holds it, so equal rows have equal bytes."""
    far = np.abs(x - SHIFT).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    low = 0
    for limit, kind in _WIDTHS:
        rows = np.flatnonzero((far >= low) & (far < limit) if limit else far >= low)
        for i, raw in zip(rows.tolist(), (x[rows] - SHIFT).astype(kind)):
            out[i] = raw.tobytes()
        low = limit or low
    return out


def _unpacked(packed: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers, each of ``dims``, from their bytes."""
    raw = [b.as_buffer() for b in packed]
    out = np.empty((len(raw), dims), np.int64)
    for i, b in enumerate(raw):
        out[i] = np.frombuffer(b, f"<i{len(b) // dims}") if dims else 0
    return out + SHIFT


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("__vector")
        names = [c for c in batch.schema.names if c != "__vector"]
        lengths = np.array(lists.value_lengths().fill_null(-1))
        starts = starts_of(np.maximum(lengths, 0))[:-1]
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths[lengths >= 0]).tolist():
            rows = np.flatnonzero(lengths == dims)
            entries = flat[take_runs(starts[rows], np.full(len(rows), dims))].reshape(len(rows), dims)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(SCALE * entries)
                fine = (np.abs(scaled) < _LIMIT).all(axis=1)
            rows, x = rows[fine], scaled[fine].astype(np.int64) + SHIFT
            chosen = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*(chosen.column(c) for c in names), pa.array(np.full(len(rows), dims, np.int32)), pa.array(_packed(x), pa.binary())],
                [*names, "dims", "x"])


def quantised(df: DataFrame, *keep: str, vector: str = "embedding") -> DataFrame:
    """The columns ``keep`` as ``_0``, ``_1``, ... with ``dims`` and ``x``, a vector's whole numbers as bytes.

    Rows without a vector, or with an entry that is null, not finite or beyond the long range as x, are left out.
    """
    chosen = df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(vector).cast("array<double>").alias("__vector"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema if f.name != "__vector")
    return chosen.mapInArrow(_quantise, kinds + "dims int, x binary")


def _weighted_sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x, w = _unpacked(batch.column("x"), dims), batch.column("copies").to_numpy()
            reach = int(np.abs(x).max(initial=0)) * int(w.sum())
            kind = np.int64 if reach < 1 << 62 else object
            total = [t + int(s) for t, s in zip(total, w.astype(kind) @ x.astype(kind))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array(total, pa.int64() if max(map(abs, total), default=0) < 1 << 62 else _EXACT).cast(_EXACT)],
            ["i", "total"])
    return run


def _products(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = len(model.sums)
        total = np.zeros((dims, dims))
        for batch in batches:
            c = model.centred(_unpacked(batch.column("x"), dims))
            total += (c * batch.column("copies").to_numpy()[:, None]).T @ c
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["i", "line"])
    return run


def add_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of doubles, as bytes, added up by their index."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, line in zip(batch.column("i").to_pylist(), batch.column("line")):
            line = np.frombuffer(line.as_buffer())
            total[i] = total[i] + line if i in total else line
    yield pa.RecordBatch.from_arrays(
        [pa.array(total, pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["i", "line"])


def fit(groups: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The covariance's leading eigenvectors from distinct vectors ``x`` of ``dims`` entries and their ``copies``.

    Tasks add up exact sums, then products of centred rows weighted by copies; lines of the covariance are added up by
    line, and the driver gets one number for each pair of dimensions. Eigenvalues that are zero to double precision have no
    component.
    """
    n = int(groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    sums = [0] * dims
    for r in groups.mapInArrow(_weighted_sums(dims), "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect():
        sums[r["i"]] = int(r["total"])
    model = Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    if not n or not dims:
        return model
    lines = groups.mapInArrow(_products(model), "i int, line binary").repartition("i").mapInArrow(add_lines, "i int, line binary")
    cov = np.zeros((dims, dims))
    for r in lines.toLocalIterator():
        cov[r["i"]] = np.frombuffer(r["line"])
    cov = (cov + cov.T) / 2 / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    some = min(components, int((values > values[0] * dims * np.finfo(float).eps).sum()))
    return Whitening(n, sums, values[:some].copy(), axes[:, :some].copy(), float(np.trace(cov)))


def _whiten(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column("x"), len(model.sums))
            z = model.whitened(x)
            exact = model.deviations(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("copies"),
                 pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64())),
                 pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()), pa.array(list(map(str, exact)), pa.string())],
                ["x", "copies", "whitened", "deviation", "deviation_digits"])
    return run


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened``, weighted by ``copies``, less the identity."""
    z, w = [F.col("whitened")[i] for i in range(components)], F.col("copies")
    means = whitened.agg(*(F.sum(w * c) / n for c in z)).first()
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = whitened.agg(*(F.sum(w * (z[i] - means[i]) * (z[j] - means[j])) / n for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(df: DataFrame, *keep: str, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row of ``df`` with a vector and each component, up to ``components``.

    Result: the columns ``keep``, then component (from 1, by falling eigenvalue), n, deviation (null where it is beyond
    the long range), whitened, explained, identity_error, and deviation_digits (the deviation as text, always). Left out are rows whose
    vector is null, holds a null or non-finite entry or one whose x is beyond the long range, or is not of the most frequent
    length (of equally frequent ones the greatest), as it has no covariance with the others. Repeated rows are repeated in the result, and
    count as often in the fit; ``keep`` may hold nulls. Directions without variance have no component, so fewer rows than eight a
    vector, or none, come from tables whose vectors span less; an empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    rows = quantised(df, *keep, vector=vector)
    counted = materialize(rows.groupBy("dims", "x").agg(F.count("*").alias("copies")))
    lengths = counted.groupBy("dims").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    groups = counted.where(F.col("dims") == dims).select("x", "copies")
    model = fit(groups, dims, components)
    found = "whitened array<double>, deviation long, deviation_digits string"
    distinct = groups.mapInArrow(_whiten(model), "x binary, copies long, " + found)
    some, error = len(model.values), 0.0
    if some:
        distinct = materialize(distinct)
        error = identity_error(distinct, model.n, some)
    else:
        distinct = distinct.where(F.lit(False))
    own = rows.where(F.col("dims") == dims).drop("dims")
    # Fewer than HOT_SHARE vectors can be so frequent, which bounds the broadcast; no other meets more than its share in one task.
    frequent = F.col("copies") * HOT_SHARE > model.n
    hot = own.join(F.broadcast(distinct.where(frequent).drop("copies")), "x")
    cold = (own.join(F.broadcast(distinct.where(frequent).select("x")), "x", "left_anti")
            .join(distinct.where(~frequent).drop("copies"), "x"))
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values)) if some else F.array(F.lit(0.0))
    return hot.unionByName(cold).select("*", F.posexplode("whitened").alias("__at", "__value")).select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), (F.col("__at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"), "deviation", F.col("__value").alias("whitened"),
        F.element_at(shares, F.col("__at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"), "deviation_digits")
