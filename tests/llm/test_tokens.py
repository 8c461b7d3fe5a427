import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packwright.llm import tokens
from packwright.llm.tokens import EliasFano, TokenFile, WordTokenizer, file_bytes, read, write, write_and_read

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def lib(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], list(range(1000)), [5] * 600 + [2**40], [2**62, 2**63 - 1],
                                    sorted(random.Random(1).choices(range(10**7), k=3000))])
def test_elias_fano(values):
    e = EliasFano.encode(np.array(values, np.int64))
    assert e.all().tolist() == values == [e.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        e.select(len(values))
    if len(values) > 1000:
        bits = 8 * sum(map(len, e.parts()[:2])) / len(values)
        assert bits <= 2 + np.log2(max(1, values[-1] / len(values))) + 1


def test_elias_fano_refuses():
    for bad in ([3, 2], [-1, 4]):
        with pytest.raises(ValueError):
            EliasFano.encode(np.array(bad))


def test_file():
    runs = [[5, 6], [70000], [], [1, 2, 3]]
    keys = [None, -2**63, -5, 2**63 - 1]
    ids = np.array([i for r in runs for i in r], np.uint32)
    got = TokenFile.parse(file_bytes(keys, ids, np.cumsum([len(r) for r in runs])))
    assert got.keys == keys and [got.document(i).tolist() for i in range(4)] == runs
    with pytest.raises(ValueError):
        TokenFile.parse(b"something else")


def test_words_are_the_library():
    own, whole = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    assert own.split and own.fold
    rnd = random.Random(3)
    texts = ["", " ", "\n\n", "it's THE end. Wasn't it?", "a b\tc\rd", "é ́x ﬁ İstanbul ΣΑΣ ß", "<|endoftext|> x<|endoftext|>y",
             "日本語 \U0001f600!!", "12ab 3.14,", "x" * 3000, "...,,, !? ;:", "'s 'll o'clock."]
    for alphabet in ("aeint  .,'\n", "AbC éß  !?", "".join(map(chr, range(1, 500)))):
        texts += ["".join(rnd.choices(alphabet, k=rnd.choice([3, 30, 200]))) for _ in range(150)]
    for _ in range(2):
        flat, starts = own.encode(texts)
        for t, a, b in zip(texts, starts, starts[1:]):
            assert flat[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t[:60])


def test_every_latin_letter_is_the_library():
    own, whole = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    letters = [c for c in map(chr, range(0x100)) if c.isalpha()]
    words = [w for c in letters for w in (c, f"n{c}", f"{c}m", f"N{c}m", f"de{c}{c}x", f"{c}.", f"1{c}", f"É{c}ñ,")]
    assert {"ª", "µm", "nº"} <= set(words)
    flat, starts = own.encode(words)
    for w, a, b in zip(words, starts, starts[1:]):
        assert flat[a:b].tolist() == whole.encode(w, add_special_tokens=False).ids, w
    assert own.fold and all(own._apart(w) is not None for w in ("the", "Été", "straße"))


def same(df, got):
    whole, start, n = Tokenizer.from_file(PATH), 0, 0
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(got.collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    for r, (k, t) in zip(got, rows):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (k, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("size", [1 << 24, 500])
def test_documents(spark, monkeypatch, size):
    monkeypatch.setattr(tokens, "FILE_IDS", size)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    same(df, write_and_read(df, PATH))


def test_odd_rows(spark, tmp_path):
    rows = [(5, None), (None, "null key"), (-3, ""), (7, "same row"), (7, "same row"), (9, "z " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS ids", "3 AS tie")
    same(df, write_and_read(df, PATH))
    assert write_and_read(df.limit(0), PATH).count() == 0
    files = write(df, str(tmp_path), PATH)
    (tmp_path / "part-000000-0000-left-over.ids").write_bytes(b"of a task that was run again")
    same(df, read(files, str(tmp_path)))
