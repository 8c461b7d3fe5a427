"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of c are sqrt(2 - 2c) apart. They are sorted by the cells of a grid of
that width over their leading principal dimensions, and cut into blocks with bounding boxes. Boxes
of whole intervals of the sequence are joined first, then the blocks of the intervals that remain, then, within a
pair of blocks, halves of halves; whatever is provably farther apart is skipped. Only what
is left is compared, as small matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import list_array, materialize, starts_of
from packwright.llm.components import connected

MIN_COSINE = 0.98
#: Leading principal dimensions that carry the grid.
GRID_DIMS = 6
BLOCK_ROWS = 512
#: Blocks of an interval, the first level of the join.
INTERVAL_BLOCKS = 16
#: Rows below which a pair of runs is compared rather than halved.
LEAF_ROWS = 128
#: Room for rounding when boxes are compared.
SLACK = 1e-6
#: Pairs of blocks that a task takes from one Arrow batch.
_BLOCK_SCHEMA = ("block long, interval long, label string, dims int, first_cell array<int>, lo array<double>, "
                 "hi array<double>, ids array<long>, copies array<long>, vectors binary")


def _unit(flat: np.ndarray, dims: int) -> np.ndarray:
    m = flat.reshape(-1, dims).astype(np.float64)
    # Scaled first, so that no square overflows or vanishes.
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        flat, sizes = _lists(batch.column(0))
        starts = starts_of(sizes)
        for d in np.unique(sizes).tolist():
            m = _unit(np.concatenate([flat[starts[i]:starts[i + 1]] for i in np.flatnonzero(sizes == d)]), d)
            one = np.hstack([np.ones((len(m), 1)), m])
            sums[d] = sums.get(d, 0) + one.T @ one
    for d, m in sums.items():
        n = m.size
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, d, np.int32)), pa.array(np.arange(n)), pa.array(m.ravel())], ["dims", "at", "x"])


def principal_axes(vectors: DataFrame, axes: int = GRID_DIMS) -> dict[int, np.ndarray]:
    """For each number of dimensions, the leading principal axes of the unit vectors in ``vectors`` (one array column).

    Sums of products over all rows are added up by Spark; the driver gets one matrix for each number of dimensions.
    """
    rows = (vectors.mapInArrow(_moments, "dims int, at long, x double")
            .groupBy("dims", "at").agg(F.sum("x").alias("x")).collect())
    out = {}
    for d in {r["dims"] for r in rows}:
        m = np.zeros((d + 1) ** 2)
        for r in rows:
            if r["dims"] == d:
                m[r["at"]] = r["x"]
        m = m.reshape(d + 1, d + 1)
        mean = m[0, 1:] / m[0, 0]
        _, axis = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[d] = np.ascontiguousarray(axis[:, ::-1][:, :min(axes, d)])
    return out


def _cells(axes: dict[int, np.ndarray], width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _lists(batch.column("vector"))
            starts = starts_of(sizes)
            cells = np.zeros((len(sizes), GRID_DIMS), np.int32)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                m = _unit(np.concatenate([flat[starts[i]:starts[i + 1]] for i in rows]), d) @ axes[d]
                cells[rows, :m.shape[1]] = np.floor(m / width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes.astype(np.int32)), *(pa.array(c) for c in cells.T)],
                [*batch.schema.names, "dims", *(f"c{i}" for i in range(GRID_DIMS))])
    return run


def _blocks(axes: dict[int, np.ndarray], width: float):
    """Cut sorted rows into blocks of one label and length each, and take their boxes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, last, run_start = 0, None, 0
        open_rows: list = []

        def close(rows, label, dims):
            nonlocal number
            vectors = np.concatenate([r[2] for r in rows])
            m = _unit(vectors, dims) @ axes[dims]
            box = [m.min(axis=0), m.max(axis=0)]
            first = np.floor(np.array([box[0][0], box[1][0]]) / width).astype(np.int32)
            block = (task << 32) + number
            number += 1
            ids = np.concatenate([r[0] for r in rows])
            yield pa.RecordBatch.from_pylist([{
                "block": block, "interval": (task << 32) + run_start + (number - 1 - run_start) // INTERVAL_BLOCKS,
                "label": label, "dims": dims, "first_cell": first.tolist(), "lo": box[0].tolist(),
                "hi": box[1].tolist(), "ids": ids.tolist(),
                "copies": np.concatenate([r[1] for r in rows]).tolist(), "vectors": vectors.astype(np.float64).tobytes()}],
                schema=schema)

        schema = pa.schema([("block", pa.int64()), ("interval", pa.int64()), ("label", pa.string()), ("dims", pa.int32()),
                            ("first_cell", pa.list_(pa.int32())), ("lo", pa.list_(pa.float64())),
                            ("hi", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())),
                            ("copies", pa.list_(pa.int64())), ("vectors", pa.binary())])
        held = 0
        for batch in batches:
            flat, sizes = _lists(batch.column("vector"))
            starts = starts_of(sizes)
            labels = batch.column("label").to_pylist()
            ids = batch.column("rep").to_numpy(zero_copy_only=False)
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(sizes)) if (labels[i], sizes[i]) != (labels[i - 1], sizes[i - 1])),
                     len(sizes)] if len(sizes) else []
            for a, b in zip(edges, edges[1:]):
                kind = (labels[a], int(sizes[a]))
                if kind != last:
                    if held:
                        yield from close(open_rows, *last)
                    open_rows, held, last, run_start = [], 0, kind, number
                while a < b:
                    n = min(b - a, BLOCK_ROWS - held)
                    open_rows.append((ids[a:a + n], copies[a:a + n], flat[starts[a]:starts[a + n]]))
                    a, held = a + n, held + n
                    if held == BLOCK_ROWS:
                        yield from close(open_rows, *last)
                        open_rows, held = [], 0
        if held:
            yield from close(open_rows, *last)
    return run


def _apart(a: str, b: str) -> Column:
    """Squared distance between the boxes of a and b."""
    gap = lambda lo, hi: F.greatest(lo - hi, F.lit(0.0))
    one = F.zip_with(f"{a}.lo", f"{b}.hi", gap)
    two = F.zip_with(f"{b}.lo", f"{a}.hi", gap)
    return F.aggregate(F.zip_with(one, two, lambda x, y: x * x + y * y), F.lit(0.0), lambda s, x: s + x)


def block_pairs(boxes: DataFrame, width: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks of one label and length whose boxes are within reach."""
    reach = (width + SLACK) ** 2
    bound = lambda c, f, k: F.array(*(f(F.get(c, F.lit(i))) for i in range(k)))
    intervals = boxes.groupBy("interval", "label", "dims").agg(
        bound("lo", F.min, GRID_DIMS).alias("lo"), bound("hi", F.max, GRID_DIMS).alias("hi"),
        F.min(F.get("first_cell", F.lit(0))).alias("first"), F.max(F.get("first_cell", F.lit(1))).alias("last"))
    # Fewer dimensions than the grid has leave nulls behind.
    intervals = intervals.withColumns({c: F.filter(c, lambda x: x.isNotNull()) for c in ("lo", "hi")})
    own = intervals.withColumn("cell", F.explode(F.sequence("first", "last"))).alias("x")
    other = intervals.withColumn("cell", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1))).alias("y")
    near = (own.join(other, ["label", "dims", "cell"]).where("x.interval <= y.interval")
            .where(_apart("x", "y") <= reach)
            .select(F.col("x.interval").alias("p"), F.col("y.interval").alias("q")).distinct())
    of = lambda c, name: boxes.select(F.col("interval").alias(c), F.struct("block", "lo", "hi").alias(name))
    return (near.join(of("p", "x"), "p").join(of("q", "y"), "q").where("x.block <= y.block or p < q")
            .where(_apart("x", "y") <= reach)
            .select(F.least("x.block", "y.block").alias("a"), F.greatest("x.block", "y.block").alias("b")).distinct())


def _linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, width: float, least: float, found: list,
            x0: int = 0, y0: int = 0) -> None:
    """Join two runs of the sequence: skip them if their boxes are apart, compare them if short, else join their halves."""
    gap = np.maximum(np.maximum(px.min(0) - py.max(0), py.min(0) - px.max(0)), 0.0)
    if gap @ gap > (width + SLACK) ** 2:
        return
    if len(x) <= LEAF_ROWS and len(y) <= LEAF_ROWS:
        i, j = np.nonzero(x @ y.T >= least)
        found.append((i + x0, j + y0))
        return
    halves = lambda m: ((0, len(m) // 2), (len(m) // 2, len(m))) if len(m) > LEAF_ROWS else ((0, len(m)),)
    for a, b in halves(x):
        for c, d in halves(y):
            _linked(x[a:b], y[c:d], px[a:b], py[c:d], width, least, found, x0 + a, y0 + c)


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that links (i, j) reach, for each of n."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(axes: dict[int, np.ndarray], width: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d, same = row["dims"], row["a"] == row["b"]
                x, y = (_unit(np.frombuffer(row[c]), d) for c in ("vectors_a", "vectors_b"))
                found: list = []
                _linked(x, y, x @ axes[d], y @ axes[d], width, least, found)
                i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                j = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                if same:
                    i, j = i[i != j], j[i != j]
                if not i.size:
                    continue
                ids = np.array(row["ids_a"] if same else row["ids_a"] + row["ids_b"])
                copies = np.array(row["copies_a"] if same else row["copies_a"] + row["copies_b"])
                if not same:
                    j = j + len(x)
                links = np.bincount(i, copies[j], len(ids))
                if not same:
                    links += np.bincount(j, copies[i], len(ids))
                label = _stars(len(ids), i, j)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[label[some]])],
                    ["rep", "links", "root"])
    return run


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, one not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.coalesce(F.size(vector), F.lit(0)) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per row of ``df``: key, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length link if their cosine, in double precision, is ``min_cosine`` or
    more (0.5 at least, below which the grid prunes nothing). n_links counts the other vectors linked directly,
    component_id is the smallest key that links reach. Equal vectors are compared once and counted as often as
    they occur. Null, empty and zero vectors, those with a null or non-finite component, null labels and null
    keys link with nothing; their component is their own key. Rows that share a key count
    one by one and share their links. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    if not 0.5 <= min_cosine <= 1:
        raise ValueError("min_cosine must be within 0.5 and 1")
    width = float(np.sqrt(max(0.0, 2 - 2 * min_cosine))) + 1e-9
    # Adding zero turns a negative zero into a zero, so equal vectors are equal as keys.
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    fit = F.col("label").isNotNull() & F.col("key").isNotNull() & usable(F.col("vector"))
    flat = F.transform("vector", lambda x: x.cast("double") + 0.0)
    fitting = rows.where(fit).select("key", "label", flat.alias("vector"))
    groups = materialize(fitting.groupBy("label", "vector").agg(F.min("key").alias("rep"), F.count("*").alias("copies")))
    axes = principal_axes(groups.select("vector"))
    cells = [f"c{i}" for i in range(GRID_DIMS)]
    placed = groups.select("vector", "label", "rep", "copies").mapInArrow(
        _cells(axes, width), "vector array<double>, label string, rep long, copies long, dims int, "
        + ", ".join(f"{c} int" for c in cells))
    order = ["label", "dims", *cells, "rep"]
    blocks = materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInArrow(_blocks(axes, width), _BLOCK_SCHEMA))
    pairs = block_pairs(blocks.select("block", "interval", "label", "dims", "first_cell", "lo", "hi"), width)
    data = lambda c: blocks.select(F.col("block").alias(c), "dims" if c == "a" else F.lit(0).alias("_"),
                                   *(F.col(x).alias(f"{x}_{c}") for x in ("ids", "copies", "vectors")))
    compared = materialize(pairs.join(data("a"), "a").join(data("b").drop("_"), "b")
                           .mapInArrow(_compare(axes, width, min_cosine), "rep long, links long, root long"))
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    least = component.groupBy("label").agg(F.min("id").alias("component_id"))
    component = component.join(least, "label").select(F.col("id").alias("rep"), "component_id")
    known = (groups.join(links, "rep", "left").join(component, "rep", "left")
             .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component_id", "rep").alias("component_id")))
    linked = fitting.join(known, ["label", "vector"]).select("key", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fit, F.lit(False))).select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
