import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from packwright.llm import piece

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rnd = random.Random(4)
    out = ["", " ", "  ", "\n", "▁", "a▁b", "\x00", "<s></s><unk><0x41>", "퟿￿\U0010ffff", " " * 300 + "x" + " " * 33,
           "a" * 5000, "ab" * 3000 + "b" * 777, "=" * 513 + "-" * 100, "the" * 2000, "日本語" * 50 + "\U0001d4b3" * 9]
    alphabets = ["ab ", "aeinorst  \n", "éà ß中\U0001f600x", "=-_*# ", "".join(map(chr, range(1, 700)))]
    for _ in range(400):
        out.append("".join(rnd.choices(rnd.choice(alphabets), k=rnd.choice([1, 5, 40, 400]))))
    for _ in range(200):
        out.append("".join(chr(rnd.choice([rnd.randrange(1, 0xd800), rnd.randrange(0xe000, 0x110000), 32])) for _ in range(20)))
    return out


def test_codec_is_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), piece.PieceCodec(PATH)
    sample = texts()
    for _ in range(2):  # the second time most words are known
        flat, starts = own.encode(sample)
        got = [flat[a:b].tolist() for a, b in zip(starts, starts[1:])]
        for t, ids in zip(sample, got):
            assert ids == lib.encode(t), t[:80]
    assert own.decode(flat, starts) == [lib.decode(ids) for ids in got]


def test_decode_of_any_ids():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), piece.PieceCodec(PATH)
    rnd = random.Random(6)
    rows = [[], [259], [0], [1, 264], [2, 1, 264, 264], [264, 1, 264]]
    rows += [[rnd.choice([rnd.randrange(3, 259), rnd.randrange(259, 32000), 264, 259, 0]) for _ in range(rnd.randint(1, 12))] for _ in range(500)]
    flat = np.array([i for r in rows for i in r], np.int32)
    got = own.decode(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert got == [lib.decode(r) for r in rows]


def test_order_of_merges_counts():
    """Without the check for pairs that come first, equal pairs of a word may not merge at once."""
    own = piece.PieceCodec(PATH)
    flat, _ = own.encode_words(["▁" * 16, "▁" * 17, "▁" * 50])
    assert flat.tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(" " * 15) + \
        sentencepiece.SentencePieceProcessor(model_file=PATH).encode(" " * 16) + \
        sentencepiece.SentencePieceProcessor(model_file=PATH).encode(" " * 49)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = piece.decode(piece.encode(docs, PATH, "doc_id", "text"), PATH, "doc_id", "ids", "text").collect()
    assert len(got) == docs.count()
    for r in got:
        assert list(r.ids) == lib.encode(r.text) and r.decoded == lib.decode(list(r.ids)) == r.text


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "x"), (2, "x"), (3, "y" * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS _0")
    out = piece.encode(df, PATH, "doc_id", "_0")
    got = piece.decode(out, PATH, "doc_id", "_0").collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(k), t or "") for k, t in rows)
    assert piece.decode(piece.encode(df.limit(0), PATH, "doc_id"), PATH, "doc_id").count() == 0
    none = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert piece.decode(none, PATH, "k").collect() == [(1, "")]


def test_query_digests(spark):
    from packwright.llm.queries import QUERIES

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = QUERIES["op2_pieces"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = lib.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
