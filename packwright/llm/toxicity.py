"""Toxicity by a factorization machine over hashed terms.

Besides a weight, every term has a short vector; the product of two terms' vectors is the weight of their meeting
in one text. So an insult may count more, or only, beside the mention of a group, which no sum of weights says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.chars import code_points, letters, run_hashes, runs
from packwright.llm.common import list_array, materialize, pieces, starts_of
from packwright.llm.whiten import add_lines

#: Terms are hashed to so many buckets, as a power of two.
BUCKET_BITS = 26
#: Labelled rows that a model is fitted on: about so many are drawn by a hash of the key, all if fewer.
TRAIN_ROWS = 20_000
#: Terms that a model knows: those that tell the classes apart best alone.
TERMS = 4096
#: Besides, terms that tell them apart in pairs: all pairs of so many terms are looked at, those that split the texts most evenly.
PAIRED_TERMS = 1024
#: Chi-squared of a pair (both there, or just one) that it must reach, and by what factor that must surpass its terms alone.
MIN_PAIR_CHI2, PAIR_GAIN = 30.0, 1.5
#: Texts of the sample in which a term must occur.
MIN_TEXTS = 5
#: Chi-squared of a term against the class that it must reach.
MIN_CHI2 = 20.0
#: Beginnings of words of so many letters are terms as well, which finds a stem in all its inflections.
STEMS = (3, 4, 5, 6)
FACTORS = 8
EPOCHS = 30
BATCH = 256
RATE = 0.05
#: Weight of a toxic text, as there are far fewer of them.
RARE = 3.0
#: Pull towards zero of weights and of factors.
DECAY = (2e-4, 1e-3)


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w x + sum over pairs <v, v'> x x'), x: a term is there or not."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _buckets(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's words and stems, flat, and where each text's begin.

    With ``known`` (sorted), places in it are given instead, of known buckets only.
    """
    codes, starts = code_points(texts)
    begins, ends = runs(letters(codes), starts)
    text = np.searchsorted(starts, begins, side="right") - 1
    pairs = []
    if known is not None:
        there = np.zeros(1 << 20, bool)
        there[known >> (BUCKET_BITS - 20)] = True
    for n in (None, *STEMS):
        some = slice(None) if n is None else np.flatnonzero(ends - begins > n)
        b = begins[some]
        terms = (run_hashes(codes, b, ends[some] if n is None else b + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        own = text[some]
        if known is not None and len(known):
            hit = np.flatnonzero(there[terms >> (BUCKET_BITS - 20)])
            terms, own = terms[hit], own[hit]
            place = np.minimum(np.searchsorted(known, terms), len(known) - 1)
            same = known[place] == terms
            terms, own = place[same], own[same]
        elif known is not None:
            terms = own = np.zeros(0, np.int64)
        pairs.append((own << BUCKET_BITS) | terms)
    pair = np.unique(np.concatenate(pairs))
    return pair & ((1 << BUCKET_BITS) - 1), np.searchsorted(pair >> BUCKET_BITS, np.arange(len(texts) + 1))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in pieces(batch.column(0).to_pylist()):
            flat, starts = _buckets(texts)
            yield pa.RecordBatch.from_arrays(
                [list_array(pa.array(flat), starts), batch.column(1).slice(at, len(texts))], ["terms", "y"])


def _placed(kept: np.ndarray):
    """Terms as places among the terms kept; what is not kept stays in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy()
            place = np.searchsorted(kept, flat)
            hit = place < len(kept)
            hit[hit] = kept[place[hit]] == flat[hit]
            starts = starts_of(hit)[starts_of(lists.value_lengths().to_numpy())]
            yield pa.RecordBatch.from_arrays([list_array(pa.array(place[hit].astype(np.int32)), starts), batch.column(1)], ["places", "y"])
    return run


def _pair_counts(kept: np.ndarray):
    """Texts of either class that hold both of two terms, as lines of a matrix; the lines of class 1 come after those of class 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(kept)
        total = np.zeros((2, size, size))
        for batch in _placed(kept)(batches):
            lists, y = batch.column("places"), batch.column("y").to_numpy()
            starts = starts_of(lists.value_lengths().to_numpy())
            flat = lists.flatten().to_numpy()
            for at in range(0, len(y), 1 << 11):
                end = min(len(y), at + (1 << 11))
                x = np.zeros((end - at, size), np.float32)
                x[np.repeat(np.arange(end - at), np.diff(starts[at:end + 1])), flat[starts[at]:starts[end]]] = 1
                for label in (0, 1):
                    own = x[y[at:end] == label]
                    total[label] += own.T @ own
        lines = total.reshape(2 * size, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * size), pa.int32()), pa.array([r.tobytes() for r in lines], pa.binary())], ["i", "line"])
    return run


def chi2(toxic: np.ndarray, all_: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Chi-squared of a feature, found in ``toxic`` of ``all_`` texts, against the class."""
    gap = toxic * n - all_ * n_toxic
    return gap * gap / np.maximum(1.0, all_ * (n - all_ + 1.0) * max(1, n_toxic * (n - n_toxic)) / max(1, n))


def telling_pairs(counts: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Indices of terms that stand in a telling pair, from the numbers of texts of both classes that hold each two terms."""
    toxic, both = counts[1], counts.sum(axis=0)
    alone = chi2(np.diag(toxic), np.diag(both), n, n_toxic)
    either, either_toxic = (np.add.outer(np.diag(m), np.diag(m)) - 2 * m for m in (both, toxic))
    best = np.maximum(chi2(toxic, both, n, n_toxic), chi2(either_toxic, either, n, n_toxic))
    return np.flatnonzero(((best >= MIN_PAIR_CHI2) & (best > PAIR_GAIN * np.maximum.outer(alone, alone))).any(axis=1))


def _margin(model: FactorizationMachine, cols: np.ndarray, starts: np.ndarray):
    """bias + linear + pairwise part for texts given by their terms' places, and the sums of factors."""
    sizes = np.diff(starts)
    of = np.repeat(np.arange(len(sizes)), sizes)
    linear = np.bincount(of, model.weights[cols], len(sizes))
    sums = np.zeros((len(sizes), model.factors.shape[1]))
    some = np.flatnonzero(sizes)
    v = model.factors[cols]
    if some.size:
        sums[some] = np.add.reduceat(v, starts[some], axis=0)
    squares = np.bincount(of, (v * v).sum(axis=1), len(sizes))
    return model.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, of


def _train(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
    """Fit by Adam on shuffled batches of the bounded sample."""
    rng = np.random.default_rng(1)
    m = FactorizationMachine(terms, 0.0, np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS)))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    m.bias = float(np.log(rate / (1 - rate)))
    if not len(terms) or not 0 < y.sum() < len(y):
        return m
    grads = [np.zeros(1), np.zeros_like(m.weights), np.zeros_like(m.factors)]
    first, second = [np.zeros_like(g) for g in grads], [np.zeros_like(g) for g in grads]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at:at + BATCH]
            own = [rows[i] for i in pick]
            starts, cols = starts_of(np.array([len(r) for r in own])), np.concatenate(own)
            z, sums, of = _margin(m, cols, starts)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * np.where(y[pick] > 0, RARE, 1.0) / len(pick)
            grads[0] = np.array([err.sum()])
            grads[1] = np.bincount(cols, err[of], len(terms)) + DECAY[0] * m.weights
            each = err[of][:, None] * (sums[of] - m.factors[cols])
            g = np.stack([np.bincount(cols, each[:, k], len(terms)) for k in range(FACTORS)], axis=1)
            grads[2] = g + DECAY[1] * m.factors
            step += 1
            new = []
            for j, (x, g) in enumerate(zip((np.array([m.bias]), m.weights, m.factors), grads)):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.99 * second[j] + 0.01 * g * g
                new.append(x - RATE * (1 - epoch / EPOCHS) * (first[j] / (1 - 0.9 ** step))
                           / (np.sqrt(second[j] / (1 - 0.99 ** step)) + 1e-8))
            m.bias, m.weights, m.factors = float(new[0][0]), new[1], new[2]
    return m


def fit(df: DataFrame, text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, terms: int = TERMS) -> FactorizationMachine:
    """A model of the 0/1 column ``label`` from about ``rows`` rows of ``df`` with a text and a label.

    Terms are counted by Spark; the driver gets the ``terms`` most telling of them, the counts of all pairs of ``PAIRED_TERMS``
    terms, and the bounded sample in places of the terms kept.
    Equal texts of the sample count once. Without rows of both classes every text gets the same score.
    """
    labelled = df.select(F.col(text).alias("text"), F.col(label).cast("int").alias("y")).where(
        F.col("text").isNotNull() & F.col("y").isin(0, 1))
    known = labelled.count()
    if known > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text", F.lit(12)), F.lit(1 << 30)) < int(rows / known * (1 << 30)))
    sample = materialize(labelled.dropDuplicates().mapInArrow(_terms, "terms array<long>, y int"))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("y").alias("toxic")).where(F.col("n") >= MIN_TEXTS)
    # Chi-squared of the term against the class.
    gap = F.col("toxic") * float(n) - F.col("n") * float(toxic)
    against = F.col("n") * (float(n) - F.col("n") + 1) * max(1.0, float(toxic) * (n - toxic)) / max(1.0, float(n))
    telling = seen.withColumn("chi2", gap * gap / against).where(F.col("chi2") >= MIN_CHI2)
    alone = {r["term"] for r in telling.orderBy(F.desc("chi2"), "term").limit(terms).collect()}
    spread = F.col("n") * (float(n) - F.col("n"))
    common = np.array(sorted(r["term"] for r in seen.orderBy(F.desc(spread), "term").limit(PAIRED_TERMS).collect()), np.int64)
    counts = np.zeros((2 * len(common), len(common)))
    if len(common):
        for r in sample.mapInArrow(_pair_counts(common), "i int, line binary").repartition("i").mapInArrow(add_lines, "i int, line binary").toLocalIterator():
            counts[r["i"]] = np.frombuffer(r["line"])
    paired = common[telling_pairs(counts.reshape(2, len(common), len(common)), n, toxic)]
    kept = np.array(sorted(alone | set(paired.tolist())), np.int64)
    found = sample.mapInArrow(_placed(kept), "places array<int>, y int").toArrow()
    lists = found["places"].combine_chunks()
    flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    return _train(kept, [flat[a:b] for a, b in zip(starts, starts[1:])], found["y"].to_numpy().astype(float))


def score_texts(model: FactorizationMachine, texts: list[str]) -> np.ndarray:
    """Scores from 0 to 1."""
    z, _, _ = _margin(model, *_buckets(texts, model.terms))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(df: DataFrame, model: FactorizationMachine, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with ``score``, from 0 to 1, higher for toxic texts.

    A null text counts as an empty one, whose score is the bias alone. Terms are the words of the whole text in lower
    case and their beginnings; how often or where one occurs does not matter. Repeated rows get equal scores; an empty table gives no rows.
    """
    chosen = df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text).alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_texts(model, texts) for _, texts in pieces(batch.column("__text").to_pylist())]
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names),
                                              pa.array(np.concatenate([np.zeros(0), *scores]))], [*names, "score"])

    return chosen.mapInArrow(run, kinds + "score double").select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "score")
