"""Fill-in-middle: a text's middle is moved to its end, between marks, so that a model learns to fill gaps.

Texts are cut into pieces of some units each, keyed by document and place in the output. One shuffle deals them by document,
a sort within the partitions puts them in the output's order, and digests take them as they come; a second sort,
without a shuffle, puts what the output holds back into the order of the text. No task holds more of a text than a piece
after the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import starts_of, take_runs

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Units of one piece, and characters looked at at a time. A word longer than that is cut between pieces.
PIECE_UNITS = 1 << 15
WINDOW = 1 << 20
#: Of each form, the marks and parts in order; parts are prefix 0, middle 1, suffix 2.
_ORDER = {PLAIN: (), PSM: (PREFIX, 0, SUFFIX, 2, MIDDLE, 1), SPM: (SUFFIX, 2, PREFIX, 0, MIDDLE, 1)}
_PART_OF = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_KEY = ["key", "text_hash"]
_SORTED = _KEY + ["at"]


def unit_starts(text: str) -> np.ndarray:
    """Places where the text's units begin: runs of A-Z and a-z, and every other character."""
    found, before = [], False
    for at in range(0, len(text), WINDOW):
        codes = np.frombuffer(text[at:at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = codes | 32
        letter = (folded >= 97) & (folded <= 122) & (codes < 128)
        inner = letter & np.concatenate([[before], letter[:-1]])
        found.append(np.flatnonzero(~inner) + at)
        before = bool(letter[-1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _hashes(key: int | None) -> list[int]:
    digits = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[i:i + 8], 16) for i in range(0, 32, 8)]


def split(key: int | None, text: str) -> tuple[str, list[tuple[int, int]], np.ndarray]:
    """The form, where prefix, middle and suffix begin and end, and where units begin."""
    begins = unit_starts(text)
    n = len(begins)
    h1, h2, h3, h4 = _hashes(key)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    ends = np.append(begins, len(text))
    a, b = int(ends[low]), int(ends[high])
    plain = not text or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    form = PLAIN if plain else SPM if h4 % 100 < SPM_BELOW else PSM
    return form, [(0, a), (a, b), (b, len(text))], begins


def _cuts(begins: np.ndarray, begin: int, end: int) -> list[int]:
    """Places where the pieces of a part begin, and its end."""
    own = begins[np.searchsorted(begins, begin):np.searchsorted(begins, end)][::PIECE_UNITS].tolist()
    out = [begin]
    for place in (own[1:] if own and own[0] == begin else own) + [end]:
        while place - out[-1] > WINDOW:  # a very long unit
            out.append(out[-1] + WINDOW)
        if place > out[-1]:
            out.append(place)
    return out


def pieces_of(key: int | None, text: str) -> tuple[str, list[tuple[int, int]], int, Iterator[tuple[bool, str]]]:
    """Form, parts, number of units, and the output in pieces, each with whether it is a mark."""
    form, parts, begins = split(key, text)

    def run() -> Iterator[tuple[bool, str]]:
        for step in _ORDER[form] or ((0, len(text)),):
            if isinstance(step, str):
                yield True, step
                continue
            begin, end = step if isinstance(step, tuple) else parts[step]
            cuts = _cuts(begins, begin, end)
            for a, b in zip(cuts, cuts[1:]):
                yield False, text[a:b]

    return form, parts, len(begins), run()


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A head, at place -1, and the pieces of every text; equal rows of a batch are one, counted in the head."""
    schema = pa.schema([("key", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()), ("mark", pa.bool_()), ("piece", pa.string()),
                        ("times", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix", pa.int64()), ("middle", pa.int64())])
    for batch in batches:
        seen: dict[tuple, int] = {}
        keys, hashes = batch.column("key").to_pylist(), batch.column("text_hash").to_pylist()
        firsts = []
        for i, own in enumerate(zip(keys, hashes)):
            if own not in seen:
                firsts.append(i)
            seen[own] = seen.get(own, 0) + 1
        rows, size = [], 0
        for i in firsts:
            key, text_hash = keys[i], hashes[i]
            form, parts, n, found = pieces_of(key, batch.column("text")[i].as_py() or "")
            counts = [None, None] if form == PLAIN else [b - a for a, b in parts[:2]]
            rows.append((key, text_hash, -1, False, None, seen[key, text_hash], n, form, *counts))
            for at, (mark, piece) in enumerate(found):
                rows.append((key, text_hash, at, mark, piece, None, None, None, None, None))
                size += len(piece)
                if size >= WINDOW:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PIECES = ("key long, text_hash long, at long, mark boolean, piece string, times long, n long, form string, "
           "prefix long, middle long")


def output_pieces(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Heads and pieces of every text in the order of its output, within partitions that hold texts whole.

    Rows of equal key and text share their pieces, which come as often as batches hold such rows; ``times`` of the heads adds up to the
    number of rows.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
                     F.col(text).alias("text"))
    return rows.mapInArrow(_emit, _PIECES).repartition(*_KEY).sortWithinPartitions(*_SORTED)


def _heads_and_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the output as it streams by; hand on its pieces with their place in the text, and a head with the digest.

    Which part a piece belongs to is told by the mark before it, as a reader of the output would; pieces of a plain output are its
    text. Places grow by part first, then by place in the output.
    """
    own = before = digest = None
    head: list = []
    part = 0
    schema = pa.schema([("key", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()), ("piece", pa.string()), ("times", pa.int64()),
                        ("n", pa.int64()), ("form", pa.string()), ("prefix", pa.int64()), ("middle", pa.int64()), ("output_sha256", pa.string())])

    def closed() -> list[tuple]:
        return [] if own is None else [(*own, -1, None, *head, digest.hexdigest())]

    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("key", "text_hash", "at", "mark", "times", "n", "form", "prefix", "middle")]
        for i, (key, text_hash, at, mark, times, *counts) in enumerate(zip(*columns)):
            if (key, text_hash) != own:
                rows += closed()
                own, before, digest, head, part = (key, text_hash), None, hashlib.sha256(), [0, *counts], 0
            if at < 0:
                head[0] += times
            elif at != before:  # the same piece of another batch's equal row adds nothing
                before = at
                piece = batch.column("piece")[i].as_py()
                digest.update(piece.encode("utf-8", "surrogatepass"))
                if mark:
                    part = _PART_OF[piece]
                else:
                    rows.append((key, text_hash, (part << 48) + at, piece, *[None] * 6))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    rows = closed()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PLACED = ("key long, text_hash long, at long, piece string, times long, n long, form string, prefix long, middle long, "
           "output_sha256 string")


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every row of the table, with the digest of its text put together again."""
    head = digest = None
    schema = pa.schema([("key", pa.int64()), ("times", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("key", "at", "times", "n", "form", "prefix", "middle", "output_sha256")]
        for i, (key, at, *counts) in enumerate(zip(*columns)):
            if at < 0:
                if head is not None:
                    rows.append((*head, digest.hexdigest()))
                head, digest = (key, *counts), hashlib.sha256()
            else:
                digest.update(batch.column("piece")[i].as_py().encode("utf-8", "surrogatepass"))
        if rows:
            yield batch_of(rows)
    if head is not None:
        yield batch_of([(*head, digest.hexdigest())])


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    A null text counts as empty, and an empty text has the form plain. A null key is hashed as no digits. Rows of equal key and text are
    put together once and repeated in the result; those of a batch are one before the shuffle. Rows that share only their key are kept apart
    by a hash of the text. Pieces hold ``PIECE_UNITS`` units or ``WINDOW`` characters, so a very long text is streamed; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    placed = output_pieces(df, key, text).mapInArrow(_heads_and_digests, _PLACED).sortWithinPartitions(*_SORTED)
    out = placed.mapInArrow(_restored, "key long, times long, n long, form string, prefix_chars long, middle_chars long, "
                                       "output_sha256 string, restored_sha256 string")
    # Repeats are dealt out a thousand at a time, so that no list grows with a group.
    thousands = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 1000)))
    out = out.withColumn("block", thousands)
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col("times") - F.col("block") * 1000))))
    return out.select(F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def transform(df: DataFrame, *keep: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with ``form`` and ``output``, the text in fill-in-middle form; no shuffle.

    Rows are treated as in ``digests``; repeated rows are repeated.
    """
    chosen = df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema if f.name not in ("__key", "__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("__key", "__text")]
            for i in range(batch.num_rows):
                form, _, _, found = pieces_of(batch.column("__key")[i].as_py(), batch.column("__text")[i].as_py() or "")
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in names), pa.array([form]), pa.array(["".join(p for _, p in found)])],
                    [*names, "form", "output"])

    return chosen.mapInArrow(run, kinds + "form string, output string").select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "form", "output")


def restore(output: str, form: str) -> str:
    """The text of an output."""
    if form == PLAIN:
        return output
    parts: dict[int, str] = {}
    marks = [s for s in _ORDER[form] if isinstance(s, str)]
    for mark, after in zip(marks, [*marks[1:], None]):
        begin = output.index(mark) + len(mark)
        parts[_PART_OF[mark]] = output[begin:output.index(after) if after else len(output)]
    return parts[0] + parts[1] + parts[2]
