"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fifteen bit masks are laid so that two fingerprints that differ in at most three bits agree on
all bits of some mask: bit i carries a non-zero vector of four bits, and mask v holds the bits whose
vector has an odd product with v. Three differing bits put three linear conditions on v, so one of the
fifteen is met by all of them. No pair within the radius is missed, whatever the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from packwright.llm.common import materialize
from packwright.llm.components import connected

RADIUS = 3
SHINGLE_WORDS = 3
HASH_SEED = 42
#: Bits of a fingerprint.
BITS = 64
#: Fingerprints that one bucket may hold; a fuller one is split by a second set of masks over the
#: bits that the first leaves open, after which a bucket has about 14 open bits and so fits by itself.
BUCKET = 1 << 14


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """SimHash of a text's word shingles, as an unsigned number; no words give zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in
                       zip(begins[:n].tolist(), ends[len(found) - n:].tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = np.ascontiguousarray(hashes[at:at + (1 << 15)], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), dtype="int64")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the named bits such that any ``radius`` of them lie outside some mask."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << bit for i, bit in enumerate(bits) if (v & (1 + i % vectors)).bit_count() % 2)
            for v in range(1, vectors + 1)]


MASKS = covering_masks(list(range(BITS)))
#: For each mask, the masks over the bits that it leaves open.
INNER = [covering_masks([i for i in range(BITS) if not m >> i & 1]) for m in MASKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, np.ndarray]]:
    """Components of one bucket as stars: (first member, the others).

    Members already joined are never compared again, so a dense group costs about one pass for each of
    its few hubs, and what comes out is linear in the bucket.
    """
    rest, out = np.unique(members), []
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        front, found = [root], []
        while front and rest.size:
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                hit, rest = rest[near], rest[~near]
                found.append(hit)
                front.extend(hit)
        if found:
            out.append((root, np.concatenate(found)))
    return out


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        starts = lists.offsets.to_numpy()
        starts = starts - starts[0]
        flat = lists.flatten().to_numpy().astype(np.int64).view(np.uint64)
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        x, y = flat[two], flat[two + 1]
        near = np.bitwise_count(x ^ y) <= RADIUS
        left, right = [x[near]], [y[near]]
        for i in np.flatnonzero(sizes > 2):
            for root, hit in bucket_links(flat[starts[i]:starts[i + 1]]):
                left.append(np.full(hit.size, root))
                right.append(hit)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(s).view(np.int64)) for s in (left, right)], ["a", "b"])


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within the radius; ``prints`` has one column fp."""
    tables = F.array(*(F.struct(F.lit(v).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for v, m in enumerate(MASKS)))
    dealt = prints.select("fp", F.explode(tables).alias("t")).select("fp", "t.mask", "t.key")
    sizes = dealt.groupBy("mask", "key").count().where("count > 1")
    shared = dealt.join(sizes, ["mask", "key"])
    usual = (shared.where(F.col("count") <= BUCKET).groupBy("mask", "key")
             .agg(F.collect_list("fp").alias("fps")).select("fps"))
    inner = F.array(*(F.array(*(F.struct(F.lit(w).alias("inner_mask"),
                                         F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("inner_key"))
                                for w, m in enumerate(masks))) for masks in INNER))
    fuller = (shared.where(F.col("count") > BUCKET)
              .select("fp", "mask", "key", F.explode(F.get(inner, F.col("mask"))).alias("t"))
              .groupBy("mask", "key", "t.inner_mask", "t.inner_key").agg(F.collect_list("fp").alias("fps"))
              .where(F.size("fps") > 1).select("fps"))
    return usual.unionByName(fuller).mapInArrow(_link_batches, "a long, b long").distinct()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, fp) of every row, written once as several steps read it."""
    return materialize(df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"),
                                 _fingerprints(F.col(text)).alias("fp")))


def _labels(rows: DataFrame) -> DataFrame:
    """(fp, label) of every distinct fingerprint."""
    prints = rows.select("fp").distinct()
    found = connected(fingerprint_links(prints))
    return prints.join(found.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, fingerprint (16 hex digits), component_id, kept.

    Fingerprints link if at most three bits differ; component_id is the smallest key that links reach,
    the row's own included, and ``kept`` marks the rows that carry it. Texts of fewer than three
    words count as one shingle; null, empty and wordless texts have fingerprint zero and link with each other
    and with fingerprints near zero. Rows with a null key take part, but a key is never null where the
    component has another. Repeated rows are repeated in the result. Very long texts are read whole; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = fingerprints(df, key, text)
    labels = materialize(_labels(rows))
    least = rows.groupBy("fp").agg(F.min("key").alias("least")).join(labels, "fp")
    component = least.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labels.join(component, "label").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest key stays.

    Null keys come last; ties go to one text, and of equal rows one stays. Columns are those of ``df``.
    """
    rows = fingerprints(df, key, text)
    return keep_first(df, rows, _labels(rows), key, text)


def keep_first(df: DataFrame, rows: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """The first row of ``df`` of each label, from the fingerprints (key, text_hash, fp) and their labels (fp, label)."""
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("first")
    per_print = rows.groupBy("fp").agg(first).join(labels, "fp")
    chosen = per_print.groupBy("label").agg(F.min("first").alias("first")).select("first.key", "first.text_hash")
    times = rows.groupBy("key", "text_hash").agg(F.count("*").alias("times"))
    chosen = materialize(chosen.alias("c").join(times.alias("t"), F.col("c.key").eqNullSafe(F.col("t.key"))
                                                & F.col("c.text_hash").eqNullSafe(F.col("t.text_hash")))
                         .select("c.key", "c.text_hash", "times"))
    c = chosen.alias("__chosen")
    inner = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"))
    kept = inner.alias("d").join(c, F.col("d.key").eqNullSafe(F.col("__chosen.key"))
                                 & (F.col("d.text_hash") == F.col("__chosen.text_hash"))
                                 ).select("d.row", "d.key", "d.text_hash", "times")
    once = kept.where("times = 1").select("row.*")
    again = kept.where("times > 1").dropDuplicates(["key", "text_hash"]).select("row.*")
    return once.unionByName(again)
