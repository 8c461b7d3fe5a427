"""Log-probabilities of texts by context-tree weighting over bytes, beside a smoothed unigram model of words.

A byte is eight binary decisions, each with a tree of its own whose contexts are the last ``DEPTH`` bytes. Every node of
a tree estimates its decision by Krichevsky and Trofimov's rule from all training texts and weighs that estimate
against its children's, so all depths are mixed; how much a depth counts follows from the code lengths of the whole corpus. A text
begins after, and ends with, a byte that no UTF-8 text holds.

A gram is a byte with its context in one number: the byte lowest, then the bytes before it, the last one first. A node
is a context of some depth with the decision's place in the byte (the leading bits so far, after a one). Both are
rolled up to a shallower context by a mask.

The model grows with the corpus and is never held in one place. Every task lists the distinct grams and words of its
rows, a block; grams are counted and get their log-probability by subtrees of ``SUBTREE`` bytes of context; and every block is sent
the values of its own grams and words only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packwright.llm.common import arrow_batches, discard, materialize, starts_of

#: Bytes of context, and of the contexts whose subtrees one task works out; a subtree has at most 2 ** 16 contexts.
DEPTH, SUBTREE = 5, 3
#: Begins and ends every text.
MARK = b"\xff"
#: Bytes of text worked on at a time; distinct words, and half of the distinct grams, that a task collects before it hands them on; bytes of
#: text below which partitions are put together to one block; entries sent in one row; bytes of an Arrow batch, which the JVM holds in buffers
#: of up to twice its size and a worker holds beside the next one.
WINDOW = 1 << 20
HELD = 1 << 19
BLOCK_BYTES = 1 << 26
PACKED = 1 << 7
BATCH_BYTES = 1 << 23
#: Grams whose subtrees are worked out together, in whole subtrees.
CHUNK = 1 << 16
_GRAM, _WORD, _TEXTS = range(3)
_DEALT = "rows of the table come in other partitions than before; write the table first"
_LN2 = float(np.log(2.0))


def mask(depth: int) -> int:
    """Bits of a gram or node that are left at a depth."""
    return (1 << 8 * (depth + 1)) - 1


def gram_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of all texts in a row, some at a time, with the index of the text of each."""
    raw = np.frombuffer(b"".join(MARK * DEPTH + t + MARK for t in texts), np.uint8)
    starts = starts_of(np.array([len(t) + DEPTH + 1 for t in texts], np.int64))
    place = np.arange(DEPTH)
    for at in range(0, len(raw), WINDOW):
        end = min(len(raw), at + WINDOW)
        low = max(0, at - DEPTH)
        own = raw[low:end]
        skip = at - low
        grams = np.zeros(end - at, "<i8")
        placed = grams.view(np.uint8).reshape(-1, 8)
        for j in range(DEPTH + 1):
            # The first bytes of all are no symbols, so what they lack before them does not matter.
            shifted = own[max(0, skip - j):len(own) - j]
            placed[end - at - len(shifted):, j] = shifted
        first, last = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, end)
        inner = np.ones(end - at, bool)
        pads = (starts[first:last, None] + place - at).ravel()
        inner[pads[(pads >= 0) & (pads < end - at)]] = False
        text = np.repeat(np.arange(first, last, dtype=np.int32), np.diff(np.clip(starts[first:last + 1], at, end)))
        grams, text = grams[inner], text[inner]
        del placed, shifted, inner
        yield grams, text


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where each of the sorted keys comes first."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def add_up(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts, from runs of distinct keys in order."""
    keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in runs)])
    keys.sort()
    keys = keys[_begins(keys)]
    counts = np.zeros(len(keys), np.int64)
    for own, n in runs:
        counts[np.searchsorted(keys, own)] += n
    return keys, counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    begins = _begins(keys)
    return keys[begins], np.diff(np.append(begins, len(keys)))


_LISTED = pa.schema([("block", pa.int32()), ("kind", pa.int8()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


class _Listing:
    """Distinct grams and words of a task's texts, with counts in training texts; handed on when there are many."""

    def __init__(self) -> None:
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter[bytes] = Counter()
        self.size = self.texts = 0

    def add(self, texts: list[bytes], trained: bool) -> None:
        self.texts += trained * len(texts)
        for grams, _ in gram_runs(texts):
            keys, n = _distinct(grams)
            self.grams.append((keys, n if trained else np.zeros(len(keys), np.int64)))
            self.size += len(keys)
        for text in texts:
            if trained:
                self.words.update(text.split())
            else:
                for w in text.split():
                    self.words.setdefault(w, 0)

    def rows(self, block: int, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What is handed on: grams if many of them are distinct, words likewise; in the end all that is left."""
        if last or self.size > 4 * HELD:
            keys, n = add_up(self.grams)
            self.grams, self.size = [(keys, n)], len(keys)
            if last or self.size > 2 * HELD:
                self.grams, self.size = [], 0
                yield from _listed(block, _GRAM, keys, None, n)
        if last or len(self.words) > HELD:
            words = sorted(self.words)
            yield from _listed(block, _WORD, None, words, [self.words[w] for w in words])
            self.words = Counter()
        if last:
            yield from _listed(block, _TEXTS, None, None, [self.texts])


def _listed(block: int, kind: int, grams: np.ndarray | None, words: list[bytes] | None, counts) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(counts), 1 << 16):
        own = pa.array(counts[at:at + (1 << 16)], pa.int64())
        size = len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, block, np.int32)), pa.array(np.full(size, kind, np.int8)),
             pa.nulls(size, pa.int64()) if grams is None else pa.array(grams[at:at + size]),
             pa.nulls(size, pa.binary()) if words is None else pa.array(words[at:at + size], pa.binary()), own], schema=_LISTED)


def _raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Texts as UTF-8 in which A to Z are lower case; null is empty."""
    return [(t or b"").lower() for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``WINDOW`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= WINDOW or i + 1 == len(sizes):
            yield start, i + 1
            start, size = i + 1, 0


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the texts of one block hold."""
    listing, block = _Listing(), None
    for batch in batches:
        for low, high in _windows(batch):
            rows = batch.slice(low, high - low)
            block = rows.column("block")[0].as_py() if block is None else block
            for held in (False, True):
                texts = _raw(rows.filter(pc.equal(rows.column("held"), held)), "text")
                if texts:
                    listing.add(texts, not held)
            yield from listing.rows(block)
    if block is not None:
        yield from listing.rows(block, last=True)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7) + 1 / (1188 * z ** 9)
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series
    for i in range(8):
        out = out - np.log(x + i)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of Krichevsky and Trofimov's estimate of ``a`` zeros and ``b`` ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


def weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of a node's weighted probability and the share of its own estimate, from the sum of its children's."""
    own = estimate(a.astype(float), b.astype(float))
    if below is None:
        return own, np.ones(len(own))
    return np.logaddexp(own, below) - _LN2, 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Subtrees:
    """Nodes of depths ``SUBTREE`` to ``DEPTH`` over sorted grams with their counts, deepest last."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.symbols = grams & 255
        steps = np.arange(8)
        nodes = ((grams & ~255)[:, None] | ((256 | self.symbols)[:, None] >> (8 - steps))).ravel()
        ones = ((self.symbols[:, None] >> (7 - steps)) & 1).ravel().astype(bool)
        n = np.repeat(counts, 8)
        keys, self.of = np.unique(nodes, return_inverse=True)
        a = np.bincount(self.of, np.where(ones, 0, n), len(keys)).astype(np.int64)
        b = np.bincount(self.of, np.where(ones, n, 0), len(keys)).astype(np.int64)
        self.ones = ones
        weighted, share = weigh(a, b, None)
        self.levels = [(keys, a, b, weighted, share)]
        for depth in range(DEPTH - 1, SUBTREE - 1, -1):
            upper, at = np.unique(keys & mask(depth), return_inverse=True)
            a, b = (np.bincount(at, c, len(upper)).astype(np.int64) for c in (a, b))
            weighted, share = weigh(a, b, np.bincount(at, weighted, len(upper)))
            keys = upper
            self.levels.insert(0, (keys, a, b, weighted, share))

    def log10(self, node: np.ndarray, zero: np.ndarray, one: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log-probability of every gram's byte after its context, from what the nodes of depth ``SUBTREE`` mix and leave."""
        above = node
        for depth in range(SUBTREE + 1, DEPTH + 1):
            keys, a, b, _, share = self.levels[depth - SUBTREE]
            at = np.searchsorted(above, keys & mask(depth - 1))
            own = rest[at] * share / (a + b + 1.0)
            zero, one, rest = zero[at] + own * (a + 0.5), one[at] + own * (b + 0.5), rest[at] * (1 - share)
            above = keys
        return np.log10(np.where(self.ones, one[self.of], zero[self.of])).reshape(-1, 8).sum(axis=1)


_NODES = "node long, a long, b long, weighted double, share double"
_MIXED = "zero double, one double, rest double"


def _whole_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in runs of whole subtrees, of ``CHUNK`` rows or more each but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            rows = pa.Table.from_batches(held)
            subtree = rows["subtree"].to_numpy()
            cut = int(np.searchsorted(subtree, subtree[-1]))
            if cut:
                yield rows.slice(0, cut)
            held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
            if not cut:  # one large subtree so far: look again when it has doubled
                size = -size
    if held:
        yield pa.Table.from_batches(held)


def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_subtrees(batches):
        top = Subtrees(rows["gram"].to_numpy(), rows["n"].to_numpy()).levels[0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in top], ["node", "a", "b", "weighted", "share"])


def _weigh_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        weighted, share = weigh(a, b, batch.column("below").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("a"), batch.column("b"), pa.array(weighted), pa.array(share)],
                                         ["node", "a", "b", "weighted", "share"])


def _downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_subtrees(batches):
        tops = rows["gram"].is_null().to_numpy()
        nodes, grams = rows.filter(pa.array(tops)), rows.filter(pa.array(~tops))
        order = np.argsort(nodes["node"].to_numpy())
        keys = grams["gram"].to_numpy()
        found = Subtrees(keys, grams["n"].to_numpy()).log10(*(nodes[c].to_numpy()[order] for c in ("node", "zero", "one", "rest")))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found)], ["gram", "value"])


def gram_values(counted: DataFrame) -> DataFrame:
    """(gram, value) from distinct grams and their training counts ``n``: log10 of the byte's probability after its context.

    Counts go up the tree, a depth at a time, to the contexts without a byte; mixtures come down again the same way. A gram that
    training texts do not hold counts zero and gets what shallower contexts and the empty estimate make of it.
    """
    subtree = F.shiftright("gram", 8).bitwiseAND(mask(SUBTREE - 1)).alias("subtree")
    grams = counted.select(subtree, "gram", "n")
    levels = {SUBTREE: materialize(grams.repartition("subtree").sortWithinPartitions("subtree", "gram").mapInArrow(_upward, _NODES))}
    for depth in range(SUBTREE - 1, -1, -1):
        rolled = levels[depth + 1].groupBy(F.col("node").bitwiseAND(mask(depth)).alias("node")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("below"))
        levels[depth] = materialize(rolled.mapInArrow(_weigh_rows, _NODES))
    mixed = None
    for depth in range(SUBTREE + 1):
        own = levels[depth].select("node", F.col("node").bitwiseAND(mask(depth - 1)).alias("above"), "a", "b", "share")
        if mixed is None:
            own = own.withColumns({"zero0": F.lit(0.0), "one0": F.lit(0.0), "rest0": F.lit(1.0)})
        else:
            own = own.join(mixed.select(F.col("node").alias("above"), *(F.col(c).alias(f"{c}0") for c in ("zero", "one", "rest"))), "above")
        part = F.col("rest0") * F.col("share") / (F.col("a") + F.col("b") + 1.0)
        mixed = own.select("node", (F.col("zero0") + part * (F.col("a") + 0.5)).alias("zero"),
                           (F.col("one0") + part * (F.col("b") + 0.5)).alias("one"), (F.col("rest0") * (1 - F.col("share"))).alias("rest"))
    tops = mixed.select(F.shiftright("node", 8).alias("subtree"), "*")
    both = grams.unionByName(tops, allowMissingColumns=True)
    out = materialize(both.repartition("subtree").sortWithinPartitions("subtree", "gram").mapInArrow(_downward, "gram long, value double"))
    discard(*levels.values())
    return out


def look_up(keys: np.ndarray, values: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The value of every gram; ``keys`` are sorted. Each distinct gram is searched for once; from those, which are few, values go out by a hash table."""
    distinct = np.sort(grams)
    distinct = distinct[_begins(distinct)]
    place = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    if (keys[place] != distinct).any():
        raise ValueError(_DEALT)
    found = values[place]
    bits = len(distinct).bit_length() + 1
    slots = _slots(distinct, bits)
    order = np.argsort(slots)
    distinct, found = distinct[order], found[order]
    # Grams of a slot follow one another.
    first = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << bits))])
    out = np.empty(len(grams))
    for at in range(0, len(grams), 1 << 15):
        run = grams[at:at + (1 << 15)]
        place = np.take(first, _slots(run, bits), mode="clip")
        left = np.flatnonzero(np.take(distinct, place, mode="clip") != run)
        while len(left):
            place[left] += 1
            left = left[distinct[place[left]] != run[left]]
        np.take(found, place, mode="clip", out=out[at:at + (1 << 15)])
    return out


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


_SENT = pa.schema([("block", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("values", pa.binary()), ("types", pa.int64())])
_SENT_DDL = "block int, kind byte, keys binary, values binary, types long"


def _grams_joined(grams: pa.Array, begins: np.ndarray) -> pa.Array:
    """The grams from each of the places on, as bytes."""
    raw = np.ascontiguousarray(grams.to_numpy(), "<i8")
    ends = pa.array(8 * np.append(begins, len(raw)), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, ends.buffers()[1], pa.py_buffer(raw)])


def _words_joined(words: pa.Array, begins: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begins, len(words)), pa.int32()), words), b" ")


def _pack(kind: int, key: str, joined, number):
    """Rows sorted by block as few rows: keys and numbers of a block as bytes, with how many words of training texts come first here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            runs = _begins(blocks)
            sizes = np.diff(np.append(runs, len(blocks)))
            # Every run of a block anew in rows of PACKED entries.
            since = np.arange(len(blocks)) - np.repeat(runs, sizes)
            begins = np.flatnonzero(since % PACKED == 0)
            values = batch.column("n" if kind == _WORD else "value").to_numpy().astype(number)
            first = batch.column("first").to_numpy(zero_copy_only=False) & (values > 0) if kind == _WORD else np.zeros(len(values), bool)
            types = np.diff(starts_of(first)[np.append(begins, len(first))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks[begins], pa.int32()), pa.array(np.full(len(begins), kind, np.int8)), joined(batch.column(key), begins),
                 _grams_joined(pa.array(values.view(np.int64)), begins), pa.array(types, pa.int64())], schema=_SENT)

    return run


def _score(known_texts: int, train_tokens: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, end = float(np.log10(train_tokens + types + 1.0)), float(np.log10(known_texts + 1.0))
        block, model = None, _Block()
        for batch in batches:
            kinds, blocks = batch.column("kind").to_numpy().astype(np.int64), batch.column("block").to_numpy().astype(np.int64)
            runs = 4 * blocks + kinds
            begins = np.flatnonzero(np.diff(runs, prepend=-1))
            for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(runs)]):
                if blocks[low] != block:
                    block, model = blocks[low], _Block()
                rows = batch.slice(low, high - low)
                if kinds[low] == _TEXTS:
                    for a, b in _windows(rows):
                        yield model.scored(rows.slice(a, b - a), total, end)
                else:
                    model.take(kinds[low], rows)
    return run


class _Block:
    """What one block was sent: values of its grams and words."""

    def __init__(self) -> None:
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[pa.Array] = []
        self.logs: list[np.ndarray] = []
        self.ready = False

    def take(self, kind: int, rows: pa.RecordBatch) -> None:
        keys, values = rows.column("keys").to_pylist(), b"".join(rows.column("values").to_pylist())
        if kind == _GRAM:
            self.grams.append((np.frombuffer(b"".join(keys), np.int64), np.frombuffer(values)))
        else:
            self.words.append(pa.array(b" ".join(keys).split(), pa.binary()))
            self.logs.append(np.log10(np.frombuffer(values, np.int64) + 1.0))

    def _settle(self) -> None:
        if not self.ready:
            keys, values = map(np.concatenate, zip(*self.grams))
            self.grams = []
            order = np.argsort(keys)
            self.keys, self.values, self.ready = keys[order], values[order], True
            self.known = pa.concat_arrays([pa.array([], pa.binary()), *self.words])
            self.known_logs = np.concatenate([np.zeros(0), *self.logs])
            self.words, self.logs = [], []

    def _logs(self, words: pa.Array) -> np.ndarray:
        """Logarithms of the counts of distinct words. The table that is made anew each time is that of these, far fewer than a block's."""
        place = pc.index_in(self.known, value_set=words)
        at = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        if len(at) != len(words):
            raise ValueError(_DEALT)
        logs = np.empty(len(words))
        logs[place.drop_null().to_numpy()] = self.known_logs[at]
        return logs

    def scored(self, rows: pa.RecordBatch, total: float, end: float) -> pa.RecordBatch:
        self._settle()
        texts = _raw(rows, "text")
        score = np.zeros(len(texts))
        for grams, text in gram_runs(texts):
            score += np.bincount(text, look_up(self.keys, self.values, grams), len(texts))
        base, known, tokens = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for low, high, words in _word_runs(texts):
            of = np.repeat(np.arange(low, high), [len(w) for w in words])
            coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
            logs = self._logs(coded.dictionary)[coded.indices.to_numpy()]
            base += np.bincount(of, logs, len(texts))
            known += np.bincount(of[logs > 0], minlength=len(texts))
            tokens += np.bincount(of, minlength=len(texts))
        tokens += 1
        return pa.RecordBatch.from_arrays(
            [rows.column("row"), rows.column("held"), pa.array(tokens), pa.array(known + (end > 0)), pa.array(base + end - total * tokens),
             pa.array(score), pa.array([len(t) for t in texts], pa.int64())],
            ["row", "held", "n_tokens", "n_known", "base_score", "score", "n_bytes"])


def _word_runs(texts: list[bytes]) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Words of texts, of some texts at a time; those of a very long text come in several runs."""
    low, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if len(text) > WINDOW:
            if held:
                yield low, i, held
            found = text.split()
            for at in range(0, len(found), WINDOW // 4):
                yield i, i + 1, [found[at:at + WINDOW // 4]]
            low, held, size = i + 1, [], 0
            continue
        held.append(text.split())
        size += len(text)
        if size >= WINDOW:
            yield low, i + 1, held
            low, held, size = i + 1, [], 0
    if held:
        yield low, len(texts), held


def score(df: DataFrame, held_out: Column, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with its probability, learned from the rows that are not ``held_out`` (null: learned from).

    Result: ``keep``, held_out, n_tokens (words and one end), n_known (those in training texts), train_tokens, base_score (log10 by
    counts of words, one added to each), score (log10 of the probability of the text's bytes and its end, A to Z in lower case) and
    bits_per_byte (code length over the text's bytes and its end). A null text counts as an empty one: one token, the end. Repeated rows count as often as they
    occur and get equal scores. No training rows leave every decision even and base_score 0; an empty table gives no rows. Very long
    texts are read in windows. Other columns are ignored, whatever their names.

    The table is read twice and must come in the same partitions both times, as written tables do; this is checked, and others raise.
    """
    with arrow_batches(df.sparkSession, BATCH_BYTES):
        return _scored(df, held_out, keep, text)


def _scored(df: DataFrame, held_out: Column, keep: tuple[str, ...], text: str) -> DataFrame:
    sizes = df.select(F.spark_partition_id().alias("part"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n")).groupBy("part").agg(
        F.sum("n").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, min(sizes[0], -(-sizes[1] // BLOCK_BYTES)))
    rows = df.coalesce(blocks).select(
        F.spark_partition_id().alias("block"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep))).alias("row"))
    listed = materialize(rows.select("block", "held", "text").mapInArrow(_list, "block int, kind byte, gram long, word binary, n long"))
    totals = {r["kind"]: r["n"] for r in listed.where(F.col("kind") != _GRAM).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    texts = totals.get(_TEXTS, 0)
    train_tokens = totals.get(_WORD, 0) + texts

    # A word has one row a block or a few; the sum of a very common one streams by.
    per_word = W.partitionBy("word")
    words = (listed.where(F.col("kind") == _WORD).groupBy("word", "block").agg(F.sum("n").alias("n"))
             .select("block", "word", F.sum("n").over(per_word).alias("n"), (F.min("block").over(per_word) == F.col("block")).alias("first")))
    words = materialize(words.sortWithinPartitions("block", "word").mapInArrow(
        _pack(_WORD, "word", _words_joined, np.int64), _SENT_DDL))
    types = words.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0] + (texts > 0)

    grams = listed.where(F.col("kind") == _GRAM)
    counted = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")))
    valued = gram_values(counted)
    sent = materialize(grams.select("block", "gram").join(valued, "gram").groupBy("gram", "block").agg(F.max("value").alias("value"))
                       .sortWithinPartitions("block", "gram").mapInArrow(
                           _pack(_GRAM, "gram", _grams_joined, np.float64), _SENT_DDL))
    discard(listed, counted, valued)

    together = sent.unionByName(words).drop("types").unionByName(
        rows.select("block", F.lit(_TEXTS).cast("byte").alias("kind"), "held", "text", "row"), allowMissingColumns=True)
    kind = rows.schema["row"].dataType.simpleString()
    out = materialize(together.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        _score(texts, train_tokens, types), f"row {kind}, held boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"))
    discard(sent, words)
    return out.select(
        *(F.col(f"row._{i}").alias(c) for i, c in enumerate(keep)), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / F.lit(float(np.log10(2.0))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
