import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from packwright.llm.shards import assign_shards, jump_hash

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def published(key, shards):
    """The published loop, on unsigned 64-bit numbers."""
    key, at, jump = key & MASK, -1, 0
    while jump < shards:
        at = jump
        key = (key * 2862933555777941757 + 1) & MASK
        jump = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 41):
        for k, r in df.select("k", jump_hash(F.col("k"), n)).collect():
            assert (r["shard"], r["grown"]) == (published(k, n), published(k, n + 1))
    with pytest.raises(ValueError):
        jump_hash(F.col("k"), 0)


def test_documents(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), 40).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        body = docs[r.doc_id]
        key = xxhash.xxh64_intdigest(str(r.doc_id).encode(), 42)
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 16, zlib.crc32(body), "key")
        assert (r.shard, r.grown_shard) == (published(key, 40), published(key, 41))
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark):
    rows = [(None, None, 1)] * 5 + [(7, "", 2), (7, "", 2), (8, "é", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = assign_shards(df, 3, parts=2).collect()
    assert len(out) == 8 and sorted(r["size"] for r in out) == [16] * 7 + [18]
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(df.limit(0), 3).count() == 0
