import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from packwright.llm import simhash
from packwright.llm.components import connected

SF = "/root/testdata/sf0.001"


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_masks_cover_every_triple():
    for masks, bits in ((simhash.MASKS, range(64)), *((m, [i for i in range(64) if not o >> i & 1])
                                                     for o, m in zip(simhash.MASKS[:2], simhash.INNER))):
        for triple in itertools.combinations(bits, 3):
            spot = sum(1 << b for b in triple)
            assert any(not m & spot for m in masks)
    assert all(28 <= m.bit_count() <= 40 for m in simhash.MASKS)


def test_documents(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    prints = [plain_print(t) for _, t in docs]
    want = {d: (f"{p:016x}", docs[c][0]) for (d, _), p, c in zip(docs, prints, plain_components(prints))}
    got = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("bucket", [1 << 14, 4])
def test_links_near_random_centres(spark, monkeypatch, bucket):
    """A small bucket sends nearly all through the second set of masks; the result is the same."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(12):
            prints.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))))
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    labels = {r.id % (1 << 64): r.label for r in connected(simhash.fingerprint_links(df)).collect()}
    want = plain_components(prints)
    for i, j in itertools.combinations(range(len(prints)), 2):
        same = labels.get(prints[i], prints[i]) == labels.get(prints[j], prints[j])
        assert same == (want[i] == want[j])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d"), (5, "A b\tC d"), (5, "A b\tC d"), (6, "x"),
            (7, "é É"), (8, long), (9, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("label", F.lit(0))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    parts = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert parts[1] == parts[2] == parts[3] == ("0" * 16, 1)
    assert parts[None][1] == 5 and parts[5][1] == 5 and parts[8] == parts[9] and parts[8][1] == 8
    assert parts[7][0] == f"{plain_print(rows[7][1]):016x}"
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_bucket_links():
    m = np.array([0, 1, 3, 7, 15, 2**40, 2**40 + 1, 2**62 - 1], np.uint64)
    out = {int(r): sorted(h.tolist()) for r, h in simhash.bucket_links(m, 1)}
    assert out == {0: [1, 3, 7, 15], 2**40: [2**40 + 1]} or out[0] == [1, 3, 7, 15, 2**40, 2**40 + 1]
