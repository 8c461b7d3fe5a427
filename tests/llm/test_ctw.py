import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packwright.llm import ctw
from packwright.llm.common import arrow_batches

SCHEMA = "doc_id long, text string, held boolean"


class Tree:
    """Context-tree weighting by recursion over one dictionary of counts; weighted probabilities are worked out anew each time."""

    def __init__(self, texts):
        self.counts = Counter()
        for t in texts:
            self.add(t)

    def decisions(self, text):
        raw = b"\xff" * ctw.DEPTH + text + b"\xff"
        for i in range(ctw.DEPTH, len(raw)):
            for step in range(8):
                yield raw[i - ctw.DEPTH:i], (256 | raw[i]) >> (8 - step), raw[i] >> (7 - step) & 1

    def add(self, text):
        for context, node, bit in self.decisions(text):
            for d in range(ctw.DEPTH + 1):
                self.counts[context[ctw.DEPTH - d:], node, bit] += 1
        self.below = {}
        for context, node, _ in self.counts:
            if context:
                self.below.setdefault((context[1:], node), set()).add(context)

    def kt(self, context, node, extra=None):
        n = [self.counts[context, node, b] + (extra == b) for b in (0, 1)]
        return math.lgamma(n[0] + .5) + math.lgamma(n[1] + .5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def weighted(self, context, node, path=None, extra=None):
        """Log-probability of what was seen below a context; with one decision more after ``path``, where that is below it."""
        on = path is not None and path[ctw.DEPTH - len(context):] == context
        own = self.kt(context, node, extra if on else None)
        if len(context) == ctw.DEPTH:
            return own
        children = set(self.below.get((context, node), ()))
        if on:
            children.add(path[ctw.DEPTH - len(context) - 1:])
        below = sum(self.weighted(c, node, path, extra) for c in children)
        high = max(own, below)
        return high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)

    def log10(self, text):
        return sum(self.weighted(b"", node, context, bit) - self.weighted(b"", node)
                   for context, node, bit in self.decisions(text)) / math.log(10)


def base(rows):
    low = [(k, (t or "").encode().lower(), h) for k, t, h in rows]
    c = Counter()
    for _, t, h in low:
        if not h:
            c.update(t.split() + [None])
    n, v = sum(c.values()), len(c)
    out = []
    for k, t, h in low:
        tokens = t.split() + [None]
        out.append((str(k), bool(h), len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def same(df, rows, trees=True):
    got = ctw.score(df, F.col("held"), "doc_id")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    tree = Tree([(t or "").encode().lower() for _, t, h in rows if not h])
    texts = {}
    want = []
    for (_, t, _), line in zip(rows, base(rows)):
        raw = (t or "").encode().lower()
        texts[raw] = texts[raw] if raw in texts else tree.log10(raw)
        want.append((*line, texts[raw], -texts[raw] / math.log10(2) / (len(raw) + 1)))
    got = sorted(map(tuple, got.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))).collect()))
    want.sort()
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([sorted(g[5:]) for g in got], [sorted(w[5:]) for w in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    words = ["the", "and", "Tion", "ÄŸ", "a", "ing.", "x\ty"]
    out = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 9))), i % 5 == 2) for i in range(40)]
    out += [(100, None, False), (101, None, True), (102, "", False), (103, "\n \t", True), (104, "new words 🙂", True), (None, "the end", False),
            (None, "the end", None), (5, "the end", False), (5, "the end", False)] + [(7, "copy of a copy", False)] * 20
    return out


@pytest.mark.parametrize("window,held,block,chunk", [(ctw.WINDOW, ctw.HELD, ctw.BLOCK_BYTES, ctw.CHUNK), (64, 100, 200, 16), (7, 5, 1, 1)])
def test_trees_and_words(spark, monkeypatch, rows, window, held, block, chunk):
    for name, value in {"WINDOW": window, "HELD": held, "BLOCK_BYTES": block, "CHUNK": chunk}.items():
        monkeypatch.setattr(ctw, name, value)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("x") for c in ("gram", "word", "block", "kind", "row", "n", "value")})
    from packwright.llm.common import materialize
    same(materialize(df), rows)


def test_little(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert ctw.score(df.limit(0), F.col("held"), "doc_id").count() == 0
    none = [(1, "ab", True), (2, None, True)]
    got = {r.doc_id: r for r in ctw.score(spark.createDataFrame(none, SCHEMA), F.col("held"), "doc_id").collect()}
    assert got[1].base_score == got[2].base_score == 0 and got[1].train_tokens == got[1].n_known == 0
    assert abs(got[1].bits_per_byte - 8) < 1e-9 and abs(got[2].score + 8 * math.log10(2)) < 1e-9


def test_rows_dealt_otherwise_raise(spark):
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 40, 100))
    assert (ctw.look_up(keys, keys / 2, keys[::-1].copy()) == keys[::-1] / 2).all()
    with pytest.raises(ValueError, match="partitions"):
        ctw.look_up(keys, keys / 2, keys + 1)


def test_documents(spark):
    """All words of the small table against plain counts, and what was held out in far fewer bits than its bytes alone take."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in df.collect()]
    got = {r.doc_id: r for r in ctw.score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, "doc_id").collect()}
    for k, held, *counts, score in base(rows):
        r = got[int(k)]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == [held, *counts] and abs(r.base_score - score) < 1e-6 * abs(score)
        assert r.score < 0 and 0 < r.bits_per_byte < 9
    out = [(got[k].score, (t or "").encode().lower()) for k, t, held in rows if held]
    alone = Counter(b for _, t in out for b in t)
    entropy = -sum(n * math.log10(n / sum(alone.values())) for n in alone.values())
    assert sum(s for s, _ in out) > -0.6 * entropy


def test_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100, 1e6 + .5, 1e12])
    assert np.allclose(ctw._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-12)


def test_each_distinct_gram_is_searched_once(monkeypatch):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 1000))
    grams = rng.choice(keys[::2], 1 << 18)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **more: searched.append(np.size(v)) or search(a, v, *rest, **more))
    assert (ctw.look_up(keys, keys / 2, grams) == grams / 2).all() and sum(searched) == len(np.unique(grams))
    assert not len(ctw.look_up(keys, keys / 2, grams[:0]))


def test_words_of_held_out_texts_count_nothing():
    listing = ctw._Listing()
    for texts, trained in (([b"a b", b"c"], False), ([b"b c b", b""], True), ([b"b d"], False)):
        listing.add(texts, trained)
    assert listing.words == {b"a": 0, b"b": 2, b"c": 1, b"d": 0} and listing.texts == 2


def listed(batches, size):
    """Rows of a listing of one-row batches, by kind."""
    table = pa.table({"block": pa.array([3] * len(batches), pa.int32()), "held": [False] * len(batches), "text": batches})
    return Counter(k for b in ctw._list(iter(table.to_batches(max_chunksize=size))) for k in b.column("kind").to_pylist())


def test_what_repeats_is_handed_on_once(monkeypatch):
    """Grams are merged before they count as many, and many words do not hand on the grams."""
    monkeypatch.setattr(ctw, "HELD", 100)
    text = "".join(chr(97 + i % 26) for i in range(150))
    grams = 0
    for own in ctw.gram_runs([text.encode()]):
        grams += len(np.unique(own[0]))
    assert listed([text] * 50, 1) == {ctw._GRAM: grams, ctw._WORD: 1, ctw._TEXTS: 1}
    assert listed([text, " ".join(map(str, range(120))), text], 1)[ctw._WORD] == 121 + 1


def test_batches_and_packed_rows_stay_small(spark):
    n = 10 * ctw.PACKED + 1
    key, numbers = np.arange(n) << 30, np.arange(n) / 3
    blocks = np.repeat([4, 9], [ctw.PACKED + 1, n - ctw.PACKED - 1]).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(key), pa.array(numbers)], ["block", "gram", "value"])
    sent = pa.Table.from_batches(list(ctw._pack(ctw._GRAM, "gram", ctw._grams_joined, np.float64)(iter([batch])))).to_pylist()
    assert max(len(r["keys"]) for r in sent) == 8 * ctw.PACKED and [r["block"] for r in sent] == [4] * 2 + [9] * 9 + [9] * (len(sent) - 11)
    assert b"".join(r["keys"] for r in sent) == key.tobytes() and b"".join(r["values"] for r in sent) == numbers.tobytes()
    words = pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([b"w%d" % i for i in range(n)]), pa.array(np.arange(n) % 2), pa.array(np.arange(n) % 3 == 0)],
                                       ["block", "word", "n", "first"])
    sent = pa.Table.from_batches(list(ctw._pack(ctw._WORD, "word", ctw._words_joined, np.int64)(iter([words])))).to_pylist()
    assert b" ".join(r["keys"] for r in sent).split() == [b"w%d" % i for i in range(n)] and sum(r["types"] for r in sent) == sum(i % 6 == 3 for i in range(n))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(0, 400, 1, 1).selectExpr("repeat('abcdefgh', 8192) AS t").mapInArrow(sizes, "n long")
    with arrow_batches(spark, 1 << 20):
        assert max(r.n for r in wide.collect()) < 1.2 * (1 << 20)
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "2m")
    try:
        with arrow_batches(spark, 1 << 20):
            assert spark.conf.get(key) == "2m"
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.unset(key)
