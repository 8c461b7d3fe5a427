import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from packwright.llm import repeats
from packwright.llm.repeats import COVER, PERIOD, STEP, remove_repeats

SF = "/root/testdata/sf0.001"


def plain(rows):
    """{row number: spans} by a table of all strings, rows in order of key."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = {}, {}
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 99):
            s = raw[a:a + 100]
            if seen.setdefault(s, (i, a)) != (i, a):
                gone[a:a + 100] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[i] = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out


def check(df, rows):
    want = plain(rows)
    got = {(r.doc_id, r.text): r for r in remove_repeats(df, "doc_id", "text").collect()}
    assert len(got) == len({(k, t) for k, t in rows})
    for i, (k, t) in enumerate(rows):
        r, raw = got[k, t], (t or "").encode()
        assert [(s.begin, s.end) for s in r.spans] == want[i], (k, (t or "")[:50])
        assert r.n_bytes == len(raw)
        assert bytes(r.kept) == b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in want[i])], [*(b for b, _ in want[i]), len(raw)]))
    return want


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert all(any((s + d) % PERIOD in COVER for d in range(STEP + 1)) for s in range(PERIOD))


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = check(df, [(r.doc_id, r.text) for r in df.collect()])
    assert sum(map(bool, want.values())) > 5


@pytest.mark.parametrize("block", [1 << 16, 12])
def test_planted(spark, monkeypatch, block):
    """Copies, near copies, shared passages and periodic texts; a small block sends buckets out as strings."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choices("abcdé fgh", k=n))
    passage, edge = say(400), say(101)
    texts = [say(rnd.randint(0, 900)) for _ in range(20)]
    texts += [texts[3], texts[5][:40] + "X" + texts[5][41:], say(99) + passage[:99], "", "z"]
    texts += [say(50) + passage + say(rnd.randint(0, 150)) for _ in range(30)]
    texts += [edge, "q" + edge, edge[:100] + "q", edge[1:], edge * 3, say(70) + edge[5:95] + say(70)]
    texts += ["a" * 99, "a" * 100, "a" * 101, "a" * 700, "ab" * 300, "abc" * 50 + say(30), "é" * 200]
    rnd.shuffle(texts)
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS tag", "3 AS found")
    check(df.repartition(5), rows)


def test_sift_in_small_batches(monkeypatch):
    """One frequent gram over many batches gives what one batch gives, but for anchors that need no look."""
    monkeypatch.setattr(repeats, "BLOCK", 3)
    rnd = random.Random(2)
    rows = sorted((g, rnd.randrange(4), rnd.randrange(50), rnd.randrange(9)) for g in (1, 5, 5, 5, 5, 8, 9) for _ in range(40 if g == 5 else 2))

    def run(size):
        out = set()
        cut = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:a + size]], pa.int64()) for i in range(4)]
                                          + [pa.nulls(len(rows[a:a + size]), pa.int32())], schema=repeats._SEEN)
               for a in range(0, len(rows), size)]
        for b in repeats._sift(iter(cut)):
            out |= {tuple(r.values()) for r in b.to_pylist()}
        return out

    monkeypatch.setattr(repeats, "BLOCK", 1000)
    want = run(1000)
    monkeypatch.setattr(repeats, "BLOCK", 3)
    for size in (7, 13, 50):
        got = run(size)
        assert {r for r in got if r[0] != 1} == {r for r in want if r[0] != 1} and {r for r in want if r[0] == 1} <= got


def test_odd_rows(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = [(None, t), (1, None), (2, ""), (3, t[:150]), (3, t[:150]), (4, t[100:] * 2), (5, "w " * 150000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), [*rows[:4], *rows[5:]])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0


def test_query(spark):
    from packwright.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    got = {r.doc_id: r for r in QUERIES["op8_repeats"](spark, SF).collect()}
    for i, (k, t) in enumerate(rows):
        raw, spans = t.encode(), want[i]
        left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(b for b, _ in spans), len(raw)]))
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), len(raw) - len(left), len(spans))
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()
