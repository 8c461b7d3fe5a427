"""Language mixtures: expectation-maximisation over words with n-gram likelihoods.

A model holds, for every language, smoothed log-probabilities of letter trigrams. Each word of a text is one
observation whose likelihood in a language is the product of its trigrams'. EM finds the
proportions of languages that explain the words best; languages are then admitted one by one, in the order of their
proportions, as long as the likelihood gains more than a penalty for one more of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from packwright.llm.chars import code_points, letters, runs
from packwright.llm.common import pieces

#: Trigrams are hashed to so many buckets, as a power of two.
BUCKET_BITS = 16
#: Labelled rows that a model is fitted on: about so many are drawn by a hash of the text, all if fewer.
TRAIN_ROWS = 20_000
SMOOTHING = 0.5
ROUNDS = 12
#: Weight of the penalty, log(1 + words), for every language beyond the first.
PENALTY = 4.0
#: A word counts at most so much (as a logarithm) for one language against another, which keeps a
#: misspelt or foreign word from outweighing a text.
MOST = 12.0
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Log-probabilities by bucket (rows) and language (columns)."""

    languages: list[str]
    table: np.ndarray


def _trigrams(codes: np.ndarray, is_letter: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around every letter; what is no letter counts as a blank."""
    blank = np.where(is_letter, codes, np.uint32(0)).astype(np.uint32)
    before = np.zeros_like(blank)
    before[1:] = blank[:-1]
    after = np.zeros_like(blank)
    after[:-1] = blank[1:]
    inner = starts[(starts > 0) & (starts < codes.size)]
    before[inner] = 0
    after[inner - 1] = 0
    with np.errstate(over="ignore"):
        h = (before * np.uint32(0x9E3779B1) + blank) * np.uint32(0x85EBCA77) + after
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - BUCKET_BITS))[is_letter]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for at, texts in pieces(batch.column(0).to_pylist()):
            codes, starts = code_points(texts)
            is_letter = letters(codes)
            grams = _trigrams(codes, is_letter, starts)
            n = np.concatenate([[0], np.cumsum(is_letter)])[starts]
            for i in range(len(texts)):
                got = np.bincount(grams[n[i]:n[i + 1]], minlength=1 << BUCKET_BITS)
                lang = langs[at + i]
                total[lang] = total[lang] + got if lang in total else got
    for lang, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])],
            ["lang", "bucket", "n"])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model of the non-null values of ``lang`` in about ``rows`` rows of ``df``.

    Trigrams are counted in tasks and added up by Spark; the driver gets one number for each
    language and bucket seen. No labelled rows give a model without languages.
    """
    labelled = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = labelled.count()
    if known > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < int(rows / known * (1 << 30)))
    found = (labelled.mapInArrow(_counts, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = sorted(set(found["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((1 << BUCKET_BITS, len(names)))
    if names:
        counts[found["bucket"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    counts += SMOOTHING
    return LanguageModel(names, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32))


def _maximise(p: np.ndarray, of: np.ndarray, begins: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int):
    """EM from ``share`` (texts x languages): new shares, and each text's log-likelihood."""
    for _ in range(rounds):
        r = p * share[of]
        r /= r.sum(axis=1, keepdims=True)
        share = np.add.reduceat(r, begins, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((p * share[of]).sum(axis=1)), begins)


def mixtures(texts: list[str], model: LanguageModel, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each text: rows add up to 1, or are all 0 where a text has no letter."""
    k = len(model.languages)
    out = np.zeros((len(texts), k))
    if not k:
        return out
    codes, starts = code_points(texts)
    is_letter = letters(codes)
    begins, ends = runs(is_letter, starts)
    if not begins.size:
        return out
    place = np.concatenate([[0], np.cumsum(is_letter)])[begins]
    words = np.add.reduceat(model.table[_trigrams(codes, is_letter, starts)], place, axis=0).astype(np.float64)
    top = words.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(words - top, -MOST))
    text = np.searchsorted(starts, begins, side="right") - 1
    some, first, of, n = np.unique(text, return_index=True, return_inverse=True, return_counts=True)
    share, _ = _maximise(p, of, first, n, np.full((len(some), k), 1 / k), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    best[np.arange(len(some)), order[:, 0]] = 1
    # Among sets of one, the likelihood decides, whatever the proportions were.
    alone = np.add.reduceat(np.log(p), first, axis=0)
    single = alone.argmax(axis=1)
    best[:] = 0
    best[np.arange(len(some)), single] = 1
    value = alone.max(axis=1)
    active = np.arange(len(some))
    for size in range(2, k + 1):
        active = active[n[active] >= size]
        if not active.size:
            break
        start = np.zeros((len(active), k))
        np.put_along_axis(start, order[active, :size], np.take_along_axis(share[active], order[active, :size], 1) + 1e-9, 1)
        start /= start.sum(axis=1, keepdims=True)
        rows = np.isin(of, active) if len(active) < len(some) else slice(None)
        own, counts = of[rows], n[active]
        edges = np.concatenate([[0], np.cumsum(counts)[:-1]])
        got, fit_ = _maximise(p[rows], np.repeat(np.arange(len(active)), counts), edges, counts, start, ROUNDS)
        assert len(own) == counts.sum()
        fit_ = fit_ - penalty * (size - 1) * np.log1p(counts)
        better = fit_ > value[active]
        best[active[better]], value[active[better]] = got[better], fit_[better]
        active = active[better]
    out[some] = best
    return out


_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                      StructField("proportions", MapType(StringType(), DoubleType()))])


def _predict(model: LanguageModel, penalty: float):
    names = np.array([*model.languages, UNKNOWN], object)

    def run(column: pa.Array) -> pa.Array:
        share = np.vstack([np.zeros((0, len(model.languages))),
                           *(mixtures(texts, model, penalty) for _, texts in pieces(column.to_pylist()))])
        known = share.sum(axis=1) > 0
        top = np.where(known, share.argmax(axis=1) if model.languages else 0, len(model.languages))
        score = np.where(known, share.max(axis=1) if model.languages else 0.0, 0.0)
        row, language = np.nonzero(share)
        mix = pa.MapArray.from_arrays(
            pa.array(np.searchsorted(row, np.arange(len(share) + 1)), pa.int32()),
            pa.array(names[language].tolist(), pa.string()), pa.array(share[row, language]))
        return pa.StructArray.from_arrays(
            [pa.array(names[top].tolist(), pa.string()), pa.array(np.minimum(score, 1.0)), mix], ["lang_pred", "score", "proportions"])

    # Hints are looked at as they are, and this module keeps its own as text.
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _RESULT)


def identify(df: DataFrame, model: LanguageModel, *keep: str, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with lang_pred, score and proportions.

    lang_pred is the language with the largest proportion, score that proportion, proportions
    (map) those of the selected set. A null or empty text, one without a letter, or any text under a model without languages is
    ``und`` with score 0 and no proportions. Ties go to the language first in order. Rows are judged one by one, so
    repeated rows get equal results; very long texts are read whole; an empty table gives no rows. Only the text
    goes to Python and only the verdict comes back.
    """
    own = df.select(F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"),
                    _predict(model, penalty)(F.col(text)).alias("verdict"))
    return own.select(*(F.col("kept")[c].alias(c) for c in keep), "verdict.*")


def held_out(key: Column, mod: int, rest: int) -> Column:
    """Whether the CRC-32 of a key's text leaves ``rest``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(mod)) == rest
