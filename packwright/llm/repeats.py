"""Removal of repeated byte strings, by sorting suffixes bucket by bucket.

A string of LENGTH bytes that occurs twice is found through its anchor, the gram in it with the smallest hash, which is the same gram at
the same place in both. Only suffixes near anchors that occur twice are sorted. Those around equal anchors form
a bucket; buckets are sorted in blocks of bounded size. Suffixes are compared by their next bytes up to a place in a difference cover,
and long ties are resolved by the ranks of the cover's places, which are taken once per block.

1. Every task picks the anchors of its texts, with a hash of the context that strings through the anchor can reach.
2. Anchors are dealt by gram. Of equal contexts only the first needs a look; all others are covered as a whole. Grams that
   occur once are dropped, which leaves few.
3. The contexts of the anchors that are left are cut from the texts.
4. Buckets are sorted: each string with an earlier equal one covers its bytes.
5. Covered runs are merged within their texts and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.chars import mix, run_hashes
from packwright.llm.common import list_array, materialize, pieces, starts_of

LENGTH = 100
GRAM = 32
#: Grams in a string.
REACH = LENGTH - GRAM + 1
#: A difference cover of the numbers below 13: every difference is one of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes before the next place in the cover at most, and bytes behind it that its rank is about.
STEP = 5
RANKED = LENGTH - STEP
#: Contexts that a block may hold; a larger bucket is split by strings.
BLOCK = 1 << 16
#: Stands for a null key, which comes before all others.
NULL_KEY = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        h, k = data.astype(np.uint64) + np.uint64(1), 1
        while k < GRAM:
            h = h[:-k] * _power(k) + h[k:]
            k *= 2
        return mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks to either side."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:len(values)] = values
    blocks = blocks.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1:width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, gram, context) of the anchors of all strings in texts that lie in ``data`` one after the other."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    grams = _gram_hashes(data)
    # The place breaks ties, the first being the least.
    places = _least((grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), REACH)
    places = (places & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    n = len(data) - LENGTH + 1
    places = np.unique(places[text[:n] == text[LENGTH - 1:LENGTH - 1 + n]])
    own = text[places]
    begin, end = np.maximum(starts[own], places - (REACH - 1)), np.minimum(starts[own + 1], places + LENGTH)
    context = mix(run_hashes(data, begin, end) + (places - begin).astype(np.uint64))
    return own, places - starts[own], grams[places].view(np.int64), context.view(np.int64)


def merge(begins: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each owner's spans: (owner, begin, end)."""
    if not len(begins):
        return owner, begins, ends
    order = np.lexsort((begins, owner))
    owner, begins, ends = owner[order], begins[order], ends[order]
    span = int(ends.max()) + 1
    code = np.unique(owner, return_inverse=True)[1].astype(np.int64) * span
    reach = np.maximum.accumulate(code + ends)
    fresh = np.concatenate([[True], (code + begins)[1:] > reach[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(begins)) - 1
    return owner[first], begins[first], reach[last] - code[last]


def _pack(tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A text's tag and a place in it as one number, in the order of both."""
    return tag.astype(np.int64) << 32 | place


_SEEN = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("end", pa.int32())])
_SEEN_DDL = "gram long, context long, key long, place long, end int"


def _cover_rows(key, tag, begin, end) -> pa.RecordBatch:
    """Covered runs in the schema of anchors, dealt by key."""
    return pa.RecordBatch.from_arrays(
        [pa.array(mix(key.view(np.uint64) + np.uint64(7)).view(np.int64)), pa.nulls(len(key), pa.int64()), pa.array(key),
         pa.array(_pack(tag, begin)), pa.array(end.astype(np.int32))], schema=_SEEN)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, with the first part of step 2 on the texts of a batch: a context goes out once."""
    for batch in batches:
        keys, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tag"))
        sizes = np.zeros(batch.num_rows, np.int64)
        got: list = []
        for at, texts in pieces(batch.column("text").to_pylist()):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            starts = starts_of(np.array([len(r) for r in raw], np.int64))
            sizes[at:at + len(raw)] = np.diff(starts)
            own, *rest = anchors(np.frombuffer(b"".join(raw), np.uint8), starts)
            got.append((own + at, *rest))
        if not got:
            continue
        own, place, gram, context = (np.concatenate(x) for x in zip(*got))
        key, at = keys[own], _pack(tags[own], place)
        order = np.lexsort((at, key, context, gram))
        gram, context, key, at, own, place = (x[order] for x in (gram, context, key, at, own, place))
        same = np.zeros(len(gram), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
        twin = same.copy()  # the same place of a repeated row
        twin[1:] &= (key[1:] == key[:-1]) & (at[1:] == at[:-1])
        first = ~same
        yield pa.RecordBatch.from_arrays([*map(pa.array, (gram[first], context[first], key[first], at[first])),
                                          pa.nulls(int(first.sum()), pa.int32())], schema=_SEEN)
        # A twin of the first is no repeat of it, but one of a later place is.
        lead = np.maximum.accumulate(np.where(first, np.arange(len(gram)), 0))
        covered = same & ~((key == key[lead]) & (at == at[lead])) if len(gram) else same
        doc, place = own[covered], place[covered]
        runs = merge(np.maximum(0, place - (REACH - 1)), np.minimum(sizes[doc], place + LENGTH), doc)
        if len(runs[0]):
            yield _cover_rows(keys[runs[0]], tags[runs[0]], runs[1], runs[2])


_LEFT_DDL = "kind int, gram long, key long, tag int, place int, end int"


def _left_batch(kind, gram, key, at, end) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(gram), pa.array(key), pa.array((at >> 32).astype(np.int32)),
         pa.array((at & 0xFFFFFFFF).astype(np.int32)), pa.array(end.astype(np.int32))],
        ["kind", "gram", "key", "tag", "place", "end"])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 on rows sorted by gram, context, key and place: kind 0, covered runs; kind 1, anchors whose gram has several
    contexts; kind 2, anchors whose context came before. A row is held back until the next is seen, so memory is that of a batch."""
    held = None
    open_gram = None  # a gram too frequent to wait for its end, which counts as one with several contexts
    last = None  # the first place of the last context
    for batch in batches:
        end = batch.column("end")
        cover = pa.compute.is_valid(end).to_numpy(zero_copy_only=False)
        if cover.any():
            rows = batch.filter(pa.array(cover))
            yield _left_batch(0, *(rows.column(c).to_numpy() for c in ("gram", "key", "place")), rows.column("end").to_numpy())
        rows = batch.filter(pa.array(~cover))
        now = [rows.column(c).to_numpy() for c in ("gram", "context", "key", "place")]
        if held is not None:
            now = [np.concatenate([h, x]) for h, x in zip(held, now)]
        if not len(now[0]):
            continue
        gram, context, key, at = now
        # The last gram of the batch waits for more, unless it fills the batch.
        cut = int(np.searchsorted(gram, gram[-1])) if gram[0] != gram[-1] else 0
        whole = gram[0] == gram[-1] and len(gram) >= 2 * BLOCK
        stop = len(gram) if whole else cut
        held = None if whole else [x[stop:].copy() for x in now]
        gram, context, key, at = (x[:stop] for x in now)
        if stop:
            yield from _sifted(gram, context, key, at, gram[0] if whole else open_gram, last)
            if whole:
                first = int(np.flatnonzero(context == context[-1])[0])
                if not (open_gram == gram[0] and last is not None and last[0] == context[-1] and first == 0):
                    last = (context[-1], key[first], at[first], gram[0])
                open_gram = gram[0]
    if held is not None and len(held[0]):
        yield from _sifted(*held, open_gram, last)


def _sifted(gram, context, key, at, open_gram, last) -> Iterator[pa.RecordBatch]:
    n = len(gram)
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new = new_gram.copy()
    new[1:] |= context[1:] != context[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    first_key, first_at = key[lead], at[lead]
    of = np.cumsum(new_gram) - 1
    several = np.bincount(of, new)[of] > 1
    if open_gram is not None and open_gram == gram[0]:
        several[gram == open_gram] = True
        if last is not None and last[3] == gram[0] and last[0] == context[0]:
            same = (lead == 0) & (gram == open_gram)
            first_key = np.where(same, last[1], first_key)
            first_at = np.where(same, last[2], first_at)
            new = new.copy()
            new[0] = False
    pick = new & several
    if pick.any():
        yield _left_batch(1, gram[pick], key[pick], at[pick], np.zeros(int(pick.sum()), np.int32))
    later = ~new & ~((key == first_key) & (at == first_at))
    if later.any():
        yield _left_batch(2, gram[later], key[later], at[later], np.zeros(int(later.sum()), np.int32))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: (gram, key, place, begin, context bytes) of the anchors of each text."""
    for batch in batches:
        keys, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tag"))
        lists, texts = batch.column("found").to_pylist(), batch.column("text").to_pylist()
        out: list = [[], [], [], [], []]
        for key, tag, found, text in zip(keys.tolist(), tags.tolist(), lists, texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for f in found:
                begin = max(0, f["place"] - (REACH - 1))
                for column, x in zip(out, (f["gram"], key, tag << 32 | f["place"], begin, raw[begin:f["place"] + LENGTH])):
                    column.append(x)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())],
            ["gram", "key", "place", "begin", "context"])


def _table(place: np.ndarray, begin: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows in which anchors stand in one column, and the columns where each begins and ends."""
    low = REACH - 1 - ((place & 0xFFFFFFFF) - begin)
    size = np.array([len(c) for c in contexts], np.int64)
    table = np.zeros((len(contexts), REACH - 1 + LENGTH + STEP), np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    row = np.repeat(np.arange(len(contexts)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    table[row, column] = flat
    return table, low, low + size


def block_repeats(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Step 4 on a block of buckets, rows in order of place within each: which strings (by row and column) have an equal one in an earlier row."""
    n, columns = len(table), REACH
    out = np.zeros((n, columns), bool)
    ranks: dict[int, np.ndarray] = {}

    def rank(c: int) -> np.ndarray:
        if c not in ranks:
            view = np.ascontiguousarray(table[:, c:c + RANKED]).view(f"V{RANKED}").ravel()
            ranks.clear()
            ranks[c] = np.unique(view, return_inverse=True)[1].ravel()
        return ranks[c]

    for s in range(columns):
        rows = np.flatnonzero((low <= s) & (high >= s + LENGTH))
        if len(rows) < 2:
            continue
        c = next(x for x in range(s, s + STEP + 1) if x % PERIOD in COVER)
        # The bytes before the ranked ones and those behind them, STEP in all.
        rest = np.zeros(n, np.uint64)
        for x in [*range(s, c), *range(c + RANKED, s + LENGTH)]:
            rest = rest << np.uint64(8) | table[:, x]
        tie = (rank(c).astype(np.uint64) << np.uint64(8 * STEP) | rest)[rows]
        _, first, back = np.unique(tie, return_index=True, return_inverse=True)
        out[rows, s] = first[back] != np.arange(len(rows))
    return out


def _string_hashes(table: np.ndarray, s: int) -> list[np.ndarray]:
    flat = np.ascontiguousarray(table[:, s:s + LENGTH]).astype(np.uint64)
    with np.errstate(over="ignore"):
        return [mix((flat + np.uint64(salt)) @ np.array([pow(base, j, 1 << 64) for j in range(LENGTH)], np.uint64)).view(np.int64)
                for salt, base in ((1, _BASE), (3, 0xC2B2AE3D27D4EB4F))]


_FOUND_DDL = "kind int, key long, tag int, begin int, end int, h0 long, h1 long"


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4 on contexts sorted by gram, key and place: kind 0, covered runs. Buckets too large for a block go out as strings
    (kind 1), told by 128 bits of hash, for Spark to group."""
    def found(kind, key, tag, begin, end, h0, h1):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(tag.astype(np.int32)),
             pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), h0, h1],
            ["kind", "key", "tag", "begin", "end", "h0", "h1"])

    def strings(part):
        _, key, place, begin, contexts = part
        for a in range(0, len(key), max(1, BLOCK // 16)):
            some = slice(a, a + max(1, BLOCK // 16))
            table, low, high = _table(place[some], begin[some], contexts[some])
            for s in range(REACH):
                rows = np.flatnonzero((low <= s) & (high >= s + LENGTH))
                if rows.size:
                    h0, h1 = _string_hashes(table[rows], s)
                    start = (begin[some] + s - low)[rows]
                    yield found(1, key[some][rows], place[some][rows] >> 32, start, start + LENGTH, pa.array(h0), pa.array(h1))

    def block(part):
        _, key, place, begin, contexts = part
        table, low, high = _table(place, begin, contexts)
        rows, s = np.nonzero(block_repeats(table, low, high))
        start = begin[rows] + s - low[rows]
        own, b, e = merge(start, start + LENGTH, rows)
        if len(own):
            none = pa.nulls(len(own), pa.int64())
            yield found(0, key[own], place[own] >> 32, b, e, none, none)

    held, full = None, None
    for batch in batches:
        now = [*(batch.column(c).to_numpy() for c in ("gram", "key", "place", "begin")), batch.column("context").to_pylist()]
        if held is not None:
            now = [np.concatenate([h, x]) if isinstance(x, np.ndarray) else h + x for h, x in zip(held, now)]
        held = None
        gram = now[0]
        if not len(gram):
            continue
        if full is not None:  # the rest of a bucket that goes out as strings
            cut = int(np.searchsorted(gram, full, side="right"))
            yield from strings([x[:cut] for x in now])
            if cut == len(gram):
                continue
            now, full = [x[cut:] for x in now], None
            gram = now[0]
        cut = int(np.searchsorted(gram, gram[-1]))
        if len(gram) - cut > BLOCK:
            full = gram[-1]
            yield from strings([x[cut:] for x in now])
        elif cut == 0:
            held = now
            continue
        else:
            held = [x[cut:] for x in now]
        yield from _blocks([x[:cut] for x in now], strings, block)
    if held is not None:
        yield from _blocks(held, strings, block)


def _blocks(part, strings, block) -> Iterator[pa.RecordBatch]:
    """Whole buckets, as many as a block holds at a time."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], part[0][1:] != part[0][:-1]])), len(part[0])) if len(part[0]) else np.zeros(1, np.int64)
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + BLOCK, side="right")) - 1)
        own = [x[edges[a]:edges[b]] for x in part]
        yield from strings(own) if edges[b] - edges[a] > BLOCK else block(own)
        a = b


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5."""
    for batch in batches:
        names = [c for c in batch.schema.names if c.startswith("_")]
        kept, spans, sizes = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            begin, end = (np.array([f[c] for f in found or ()], np.int64) for c in ("place", "end"))
            _, begin, end = merge(begin, np.minimum(end, len(raw)), np.zeros(len(begin), np.int64))
            edges = [0, *(x for pair in zip(begin.tolist(), end.tolist()) for x in pair), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append(list(zip(begin.tolist(), end.tolist())))
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
             pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans],
                      pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
            [*names, "n_bytes", "kept", "spans"])


def remove_repeats(df: DataFrame, *keep: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with n_bytes, kept (binary) and spans (array of begin, end).

    Every byte is cut that lies in a string of 100 bytes which also starts earlier: in a row with a smaller key, or earlier in the
    same text, overlaps included. Strings are judged on the input, whatever else is cut, and none crosses texts. ``kept`` are
    the bytes left, which may end within a character; spans are the maximal runs cut. A null or empty text has no bytes, one under
    100 bytes keeps all. Null keys come first; rows with equal keys are in the order of a hash of their texts; repeated rows count as
    one document, so none of them is cut for the other's sake. Very long texts are read whole; an empty table gives no rows.
    """
    tag = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    own: Column = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))
    texts = df.select(own.alias("key"), tag.alias("tag"), F.col(text).alias("text"))
    seen = texts.mapInArrow(_pick, _SEEN_DDL)
    left = materialize(seen.repartition("gram").sortWithinPartitions("gram", "context", "key", "place").mapInArrow(_sift, _LEFT_DDL))
    wanted = left.where("kind = 1").groupBy("key", "tag").agg(F.collect_list(F.struct("gram", "place")).alias("found"))
    cut = texts.join(wanted.hint("merge"), ["key", "tag"]).mapInArrow(_cut, "gram long, key long, place long, begin int, context binary").distinct()
    found = materialize(cut.repartition("gram").sortWithinPartitions("gram", "key", "place").mapInArrow(_sort_blocks, _FOUND_DDL))
    strings = found.where("kind = 1")
    start = F.struct("key", "tag", "begin")
    earliest = strings.groupBy("h0", "h1").agg(F.min(start).alias("earliest"))
    many = strings.join(earliest, ["h0", "h1"]).where(start != F.col("earliest")).select("key", "tag", "begin", "end")
    around = left.where("kind = 2").select("key", "tag", F.greatest(F.col("place") - (REACH - 1), F.lit(0)).alias("begin"),
                                           (F.col("place") + LENGTH).alias("end"))
    spans = (left.where("kind = 0").select("key", "tag", F.col("place").alias("begin"), "end")
             .unionByName(around).unionByName(found.where("kind = 0").select("key", "tag", "begin", "end")).unionByName(many))
    per_text = spans.groupBy("key", "tag").agg(F.collect_list(F.struct(F.col("begin").alias("place"), "end")).alias("found"))
    rows = df.select(own.alias("key"), tag.alias("tag"), F.col(text).alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name.startswith("_"))
    return rows.join(per_text.hint("merge"), ["key", "tag"], "left").mapInArrow(
        _remove, kinds + "n_bytes long, kept binary, spans array<struct<begin:long,end:long>>").select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "kept", "spans")
