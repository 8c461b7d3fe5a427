"""Benchmark decontamination: q-gram filtering in diagonal bands, verified by banded alignment.

An item of m characters that occurs in a text with at most k edits keeps at least m - q + 1 - kq of its q-grams (the
q-gram lemma), all on diagonals of the (text, item) matrix that lie within k of each other. Shared
q-grams are therefore counted in overlapping bands of 2(k + 1) diagonals, of which one holds any k + 1 neighbouring ones; only bands
that reach the bound can hold an occurrence, and those are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.chars import code_points, letters, mix
from packwright.llm.common import pieces, starts_of, take_runs

Q = 8
#: Edits that an occurrence may have, as a share of the item's length.
EDIT_RATE = 0.1
#: Characters of the items that one pass over the texts looks for; more items take more passes.
BLOCK_CHARS = 4_000_000
#: Shared q-grams that are looked at together.
HITS = 1 << 20
_BLANK = np.uint32(32)
_BITS = 20


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits in lower case, whatever is between them as one blank: codes, starts, and places in the texts."""
    codes, starts = code_points(texts)
    word = letters(codes, digits=True)
    first = np.zeros(codes.size, bool)
    first[starts[:-1][starts[:-1] < codes.size]] = True
    keep = word.copy()
    # A blank stands where a word follows what is no word, unless the text begins there.
    gap = ~word
    gap[:-1] &= word[1:]
    gap[-1:] = False
    seen = np.concatenate([[0], np.cumsum(word)])
    gap[np.flatnonzero(gap)] &= (seen[:-1] > np.repeat(seen[starts[:-1]], np.diff(starts)))[gap]
    inner = starts[1:-1]
    gap[inner[inner > 0] - 1] = False
    keep |= gap
    places = np.flatnonzero(keep)
    out = np.where(gap[places], _BLANK, codes[places])
    return out, np.concatenate([[0], np.cumsum(keep)])[starts], places


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q code points from each place on."""
    n = codes.size - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(q):
            h *= base
            h += codes[j:j + n]
    return mix(h)


@dataclass
class Items:
    """Query items, normalised, with an index of their q-grams."""

    ids: list
    codes: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    begins: np.ndarray
    counts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    there: np.ndarray


def index_items(ids: list, texts: list[str], rate: float = EDIT_RATE, q: int = Q) -> Items:
    """Items of q characters or more, after normalising. The edit budget is the length's share, lowered for short items so
    that at least one q-gram must stay."""
    flat, starts, _ = normalise(texts)
    use = [i for i in range(len(texts)) if starts[i + 1] - starts[i] >= q]
    codes = [flat[starts[i]:starts[i + 1]] for i in use]
    size = np.array([len(c) for c in codes], np.int64)
    budgets = np.minimum((size * rate + 1e-9).astype(np.int64), (size - q) // q)
    hashes = [_grams(c, q) for c in codes]
    item = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
    all_ = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(all_, kind="stable")
    grams, begins, counts = np.unique(all_[order], return_index=True, return_counts=True)
    there = np.zeros(1 << _BITS, bool)
    there[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Items([ids[i] for i in use], codes, budgets, size - q + 1 - budgets * q, grams, begins, counts, item[order], place[order], there)


def align(item: np.ndarray, text: np.ndarray, budget: int, low: int | None = None, high: int | None = None) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of ``item`` in ``text`` with at most ``budget`` edits, the one ending first at ties.

    Only cells on the diagonals from ``low`` to ``high`` (place in the text less place in the item) are
    computed, a row of them at once; all diagonals by default. Rows end as soon as every cell is over the budget.
    """
    low = -len(item) if low is None else low
    high = len(text) if high is None else high
    # What lies outside the text matches nothing.
    padded = np.zeros(len(item) + high - low + 1, np.int64)
    a, b = max(0, low), min(len(text), low + len(padded))
    padded[a - low:b - low] = text[a:b]
    steps = np.arange(high - low + 1)
    row = np.zeros(len(steps), np.int64)
    # Occurrences start within the text.
    row[:max(0, -low)] = budget + 1
    for i, c in enumerate(item):
        new = row + (padded[i:i + len(steps)] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > budget:
            return None
    end = int(row.argmin())
    return int(row[end]), min(len(text), max(0, low + end + len(item)))


def _candidates(items: Items, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, band) of every band with as many shared q-grams as its item's bound."""
    grams = _grams(codes)
    at = np.flatnonzero(items.there[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
    entry = np.minimum(np.searchsorted(items.grams, grams[at]), max(0, len(items.grams) - 1))
    same = items.grams[entry] == grams[at] if len(items.grams) else np.zeros(0, bool)
    at, entry = at[same], entry[same]
    width = items.budgets + 1
    # Bands are numbered from below, as diagonals may be negative.
    span = codes.size + int(max((len(c) for c in items.codes), default=0)) + 2
    shift = int(max((len(c) for c in items.codes), default=0))
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(items.counts[entry])
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) + HITS, HITS)) if len(ends) else [0]
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        if a == b:
            continue
        n = items.counts[entry[a:b]]
        hit = take_runs(items.begins[entry[a:b]], n)
        item, diagonal = items.item[hit], np.repeat(at[a:b], n) - items.place[hit] + shift
        band = diagonal // width[item] + 1
        new = np.concatenate([item * (span + 2) + band, item * (span + 2) + band - 1])
        keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, np.ones(len(new), np.int64)]), len(keys)).astype(np.int64)
    item = keys // (span + 2)
    full = counts >= items.bounds[item]
    item, band = item[full], keys[full] % (span + 2)
    # Band b holds the diagonals of cells b - 1 and b.
    return item, (band - 1) * width[item] - shift


def search(items: Items, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, begin, end) of the best occurrence of each item in each text; places are those of the texts."""
    codes, starts, places = normalise(texts)
    origins = starts_of(np.array([len(t) for t in texts], np.int64))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, low in zip(*(x.tolist() for x in _candidates(items, codes))):
        size, k = len(items.codes[i]), int(items.budgets[i])
        a, b = max(0, low - k), min(len(codes), low + 2 * (k + 1) + size + k)
        for t in range(np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b, side="left")):
            x, y = max(a, starts[t]), min(b, starts[t + 1])
            if y - x < size - k:
                continue
            found = align(items.codes[i], codes[x:y], k, low - k - x, low + 2 * (k + 1) + k - x)
            if found and ((t, i) not in best or (found[0], x + found[1]) < best[t, i][:2]):
                best[t, i] = (found[0], x + found[1], x)
    out = []
    for (t, i), (edits, end, x) in best.items():
        # The begin is where the reversed item ends in the reversed text before the end.
        back = align(items.codes[i][::-1], codes[x:end][::-1], edits)
        begin = end - back[1]
        out.append((t, i, edits, int(places[begin] - origins[t]), int(places[end - 1] + 1 - origins[t])))
    return sorted(out)


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(key, text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """(key, text_hash, item, edits, begin, end): the best occurrence of each benchmark item in each row's text.

    Every row of ``df`` is compared with every item, the items in blocks of bounded size. Letters and digits count, in lower
    case; what is between words counts as one blank. An occurrence has at most ``rate`` times the item's length in
    edits (fewer for items under Q / (1 - Q * rate) characters); begin and end are places in the text. Items of fewer than
    eight characters, null texts and empty texts match nothing; ties go to the occurrence that ends first. Repeated rows
    and items give repeated results; very long texts are read whole; no rows or no items give none.
    """
    chosen = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("text is not null")
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema} | {
        "item": benchmark.select(item_key).schema[0].dataType.simpleString()}
    schema = f"key {kinds['key']}, text_hash long, item {kinds['item']}, edits int, begin int, end int"
    empty = df.sparkSession.createDataFrame([], schema)

    def finder(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for at, texts in pieces(batch.column("text").to_pylist()):
                    found += [(at + t, *rest) for t, *rest in search(items, texts)]
                if found:
                    rows = pa.array([f[0] for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(rows), batch.column("text_hash").take(rows),
                         pa.array([items.ids[f[1]] for f in found]),
                         *(pa.array([f[j] for f in found], pa.int32()) for j in (2, 3, 4))],
                        ["key", "text_hash", "item", "edits", "begin", "end"])
        return run

    out = None
    for ids, texts in _blocks(benchmark, item_key, item_text):
        part = chosen.mapInArrow(finder(index_items(ids, texts, rate)), schema)
        out = part if out is None else out.unionByName(part)
    out = empty if out is None else out
    return out.withColumnsRenamed({"key": key})


def drop_leaked(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` without the rows whose text holds an item of ``benchmark``; columns are those of ``df``.

    Whether a text leaks depends on the text alone, so rows are told by a hash of it; null and repeated keys do no harm.
    """
    bad = leaks(df, benchmark, key, text, **how).select("text_hash").distinct().select(F.col("text_hash").alias("__leaked"))
    rows = df.select(F.struct("*").alias("row"))
    return rows.join(bad, F.xxhash64(F.col("row")[text]) == F.col("__leaked"), "left_anti").select("row.*")
