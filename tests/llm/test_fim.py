import hashlib
import re

import pytest
from pyspark.sql import functions as F

from packwright.llm import fim

SCHEMA = "doc_id long, text string"


def plain(key, text):
    """One row by regular expressions and slices."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (str(key), n, "plain", None, None, digest(text), digest(text)), text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (str(key), n, form, len(p), len(m), digest(out), digest(text)), out


def same(spark, df, rows):
    got = fim.digests(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [plain(k, t) for k, t in rows]
    assert sorted(map(str, ((str(r[0]), *r[1:]) for r in got.collect()))) == sorted(str(w) for w, _ in want)
    made = fim.transform(df, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.form, r.output) for r in made) == sorted((w[0], w[2], o) for w, o in want)
    assert all(fim.restore(r.output, r.form) == (r.text or "") for r in made)
    return {w[2] for w, _ in want}


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert same(spark, df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]) == {"plain", "psm", "spm"}


@pytest.mark.parametrize("units,window", [(fim.PIECE_UNITS, fim.WINDOW), (3, 5)])
def test_odd_rows(spark, monkeypatch, units, window):
    monkeypatch.setattr(fim, "PIECE_UNITS", units)
    monkeypatch.setattr(fim, "WINDOW", window)
    texts = [None, "", "a", "...", "one two", "x<P>y", "<M>", "Żółć 🙂🙂 naïve", "a\r\nb\t c", "Kelvin K ſ", "long" * 400 + "!", "é" * 50]
    rows = [(i * 17 + j, t) for i, t in enumerate(texts) for j in range(9)] + [(None, "no key here"), (None, "nor here")]
    rows += [(5, "twice, twice")] * 40 + [(5, "another text of this key")] * 3 + [(None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(spark, df.withColumns({c: F.lit("x") for c in ("key", "at", "piece", "times", "form", "_")}), rows)
    assert fim.digests(df.limit(0)).count() == 0 and fim.transform(df.limit(0), "doc_id").count() == 0


def test_long_text_in_pieces():
    text = "word " * 300_000 + "x" * 3_000_000 + " end"
    _, _, n, found = fim.pieces_of(3, text)
    found = list(found)
    assert n == 600_003 and max(len(p) for _, p in found) <= fim.WINDOW
    form = fim.split(3, text)[0]
    assert fim.restore("".join(p for _, p in found), form) == text


def test_one_shuffle(spark):
    plan = fim.digests(spark.createDataFrame([(1, "a b")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
