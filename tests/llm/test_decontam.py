import random
import re

import pytest

from packwright.llm import decontam
from packwright.llm.decontam import align, drop_leaked, index_items, leaks, normalise, search

SF = "/root/testdata/sf0.001"


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def distance(item, text):
    """Least edits of item anywhere in text, and the first end with them."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min((e, j) for j, e in enumerate(row))


def test_normalise():
    texts = ["", "  A-b  c3!", "...", "É\n\nx ", "word", "_a_"]
    codes, starts, _ = normalise(texts)
    got = ["".join(map(chr, codes[a:b])) for a, b in zip(starts, starts[1:])]
    assert got == ["", "a b c3", "", "é x", "word", "a"]


def test_align():
    rnd = random.Random(2)
    for _ in range(60):
        item = "".join(rnd.choices("ab", k=rnd.randint(1, 9)))
        text = "".join(rnd.choices("ab", k=rnd.randint(1, 14)))
        want = distance(item, text)
        got = align(normalise([item])[0], normalise([text])[0], 3)
        assert got == (want if want[0] <= 3 else None)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[i] = rnd.choice("xyz")
        elif kind == 1:
            s.insert(i, rnd.choice("xyz "))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


@pytest.mark.parametrize("hits", [1 << 20, 50])
def test_no_occurrence_is_missed(monkeypatch, hits):
    """All items against all texts by plain dynamic programming."""
    monkeypatch.setattr(decontam, "HITS", hits)
    rnd = random.Random(hits)
    words = ["the", "ing", "onth", "er", "and", "tion", "re", "ha", "est"]
    say = lambda n: " ".join("".join(rnd.choices(words, k=rnd.randint(1, 3))) for _ in range(n))
    items = [say(rnd.randint(2, 25)) for _ in range(14)] + ["aaaa " * 12, "short"]
    texts = ["", "a" * 300, "aaaa " * 40]
    for i in items:
        for n in (0, 2, 5, 9, 15):
            texts.append(say(rnd.randint(0, 12)) + " " + edited(rnd, i, n).upper() + "... " + say(rnd.randint(0, 12)))
    index = index_items(list(range(len(items))), items)
    got = {(t, index.ids[i]): (e, b, z) for t, i, e, b, z in search(index, texts)}
    want = {}
    for n, code in zip(index.ids, index.codes):
        k = int(index.budgets[index.ids.index(n)])
        item = "".join(map(chr, code))
        for t, text in enumerate(texts):
            e, _ = distance(item, plain(text))
            if plain(text) and e <= k:
                want[t, n] = e
    assert {k: v[0] for k, v in got.items()} == want and len(want) > 30
    for (t, n), (e, begin, end) in got.items():
        assert distance(plain(items[n]), plain(texts[t][begin:end]))[0] == e


def test_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if f" {plain(b.text)} " in f" {plain(d.text)} "}
    got = leaks(docs, bench).collect()
    assert want <= {(r.doc_id, r["item"]) for r in got} and {(r.doc_id, r["item"]) for r in got if r.edits == 0} == want
    bad = {r.doc_id for r in got}
    kept = drop_leaked(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d.doc_id for d in docs.collect() if d.doc_id not in bad)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 30)
    item = "which of the rivers flows into the northern sea"
    rows = [(1, None), (2, ""), (None, f"x {item.upper()}!"), (3, item), (3, item), (4, "z " * 200000 + item), (5, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS item", "'k' AS key", "1 AS row")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "short"), (4, item)], "item_id long, text string")
    got = leaks(docs, bench).collect()
    assert sorted((str(r.doc_id), r["item"], r.edits) for r in got) == sorted(
        (str(d), i, 0) for d in (None, 3, 3, 4) for i in (1, 4))
    assert [r.doc_id for r in drop_leaked(docs, bench).orderBy("doc_id").collect()] == [1, 2, 5]
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert drop_leaked(docs, bench.limit(0)).count() == len(rows)
