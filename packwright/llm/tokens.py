"""Token ids in binary files with Elias-Fano encoded document boundaries.

A file is a header, the ids of its documents one after the other, and two non-decreasing sequences in Elias-Fano form: where
documents end, and the documents' keys. Each number keeps its low bits as they are; the high bits become a bit
vector with one set bit for each number, so a sequence takes about 2 + log2(last / count) bits a number, and a sampled select finds
any number in it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packwright.llm.common import PIECE_CHARS, materialize, pieces, starts_of, take_runs, worker_cache
from packwright.session import shared_dir

MAGIC = b"TOKIDS01"
END_ID = 1
#: Every so many set bits the select structure notes a place.
SELECT_STEP = 256
#: A file is closed when it holds so many ids.
FILE_IDS = 1 << 24
#: Words whose ids a worker keeps for later texts; others are encoded again.
KEPT_WORDS = 300_000


@dataclass
class EliasFano:
    """A non-decreasing sequence of numbers from 0 to 2**63 - 1."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("the numbers must not be negative or decrease")
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        low = values & ((1 << bits) - 1)
        packed = np.packbits(((low[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> bits) + np.arange(n)
        high = np.zeros((int(places[-1]) + 1 if n else 0) + 7 >> 3, np.uint8)
        np.bitwise_or.at(high, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
        return cls(n, bits, packed, high, places[::SELECT_STEP].astype(np.uint32))

    def select(self, i: int) -> int:
        """The number at ``i``: the i-th set bit from the nearest sample on, and the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SELECT_STEP])
        left = i % SELECT_STEP
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        if not self.low_bits:
            return 0
        raw = int.from_bytes(self.low[at >> 3:(at + self.low_bits + 7) >> 3].tobytes(), "little")
        return raw >> (at & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """All numbers."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((places - np.arange(self.n)) << self.low_bits) | low

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]


def file_bytes(keys: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A file of documents in the order of their keys, null keys first; ``ends`` are the ends of their runs of ids."""
    nulls = sum(k is None for k in keys)
    known = np.array([k for k in keys if k is not None], np.int64)
    wide = bool(ids.size) and int(ids.max()) > 0xFFFF
    # Keys are split at zero, as distances of longs may not fit a long.
    below = int(np.searchsorted(known, 0))
    base = int(known[below]) if below < len(known) else 0
    lists = [EliasFano.encode(ends), EliasFano.encode((-1 - known[:below])[::-1]), EliasFano.encode(known[below:] - base)]
    body = [ids.astype("<u4" if wide else "<u2").tobytes()]
    for e in lists:
        body += e.parts()
    head = json.dumps({"ids": int(ids.size), "width": 4 if wide else 2, "nulls": nulls, "base": base,
                       "lists": [[e.n, e.low_bits, len(e.low), len(e.high), len(e.samples)] for e in lists]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *body])


@dataclass
class TokenFile:
    """A file read back."""

    ids: np.ndarray
    ends: EliasFano
    keys: list[int | None]

    @classmethod
    def parse(cls, raw: bytes) -> TokenFile:
        if raw[:8] != MAGIC:
            raise ValueError("this is no file of token ids")
        size = int.from_bytes(raw[8:12], "little")
        head = json.loads(raw[12:12 + size])
        at = 12 + size
        ids = np.frombuffer(raw, f"<u{head['width']}", head["ids"], at)
        at += head["ids"] * head["width"]
        lists = []
        for n, bits, low, high, samples in head["lists"]:
            parts = []
            for kind, count, width in (("u1", low, 1), ("u1", high, 1), ("<u4", samples, 4)):
                parts.append(np.frombuffer(raw, kind, count, at))
                at += count * width
            lists.append(EliasFano(n, bits, *parts))
        keys = [None] * head["nulls"] + (-1 - lists[1].all()[::-1]).tolist() + (lists[2].all() + head["base"]).tolist()
        return cls(ids, lists[0], keys)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document."""
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]


def _raw(ids: list[int]) -> bytes:
    """Ids as they are kept: a fraction of the memory of a list."""
    return array("I", ids).tobytes()


class _Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class WordTokenizer:
    """The tokenizers library over whole texts, one call for each distinct word.

    Where a tokenizer treats what is between blanks apart, a text's ids are those of its words one after the
    other; whether it does is tried out on a few texts, and others are encoded whole.
    """

    PROBES = ("Ab cd, ef's", "x  y", "é É ß", "don't 12 a1b2", "e ́z", "(a) b-c ... d", "日本 語")

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        one = lambda t: self.whole.encode(t, add_special_tokens=False).ids
        self.split = all(one(p) == [i for w in p.split(" ") for i in one(w)] and one(p.replace(" ", "\n")) == one(p)
                         for p in self.PROBES)
        # Words of common Latin letters need no normalising beyond lower case, so the model can be asked
        # at once, if that gives what the tokenizer gives; letters are written as the model knows them.
        latin = [c for c in map(chr, range(0x80, 0x100)) if c.isalpha()]
        self.letters = str.maketrans({c: "".join(t for t, _ in self.whole.pre_tokenizer.pre_tokenize_str(c)) for c in latin})
        self.model = self.whole.model
        self.words: dict[str, bytes] = {}
        self.fold = False
        self.odd: set[str] = set()
        probes = [w + s for w in ("Ab", "the", "WORDS", "xyzzyq", "Été", "ñandú", "Straße", "ÄÖÜ") for s in ("", ".", ",", "!!", "?;")]
        self.fold = self.split and all(self._apart(w) == _raw(one(w)) for w in probes)
        # Letters that the tokenizer normalises in some other way, alone or within words, are left to it.
        self.odd = {c for c in latin if self.fold and any(self._apart(w) != _raw(one(w)) for w in (c, f"n{c}", f"{c}m", f"n{c}m", f"a{c}{c}."))}
        self.words.clear()

    def _apart(self, word: str) -> bytes | None:
        """Ids of a word of common Latin letters with the marks behind it, None for any other."""
        core = word.rstrip(".,!?;:")
        if not core.isalpha() or not (core.isascii() or max(core) <= "ÿ" and self.odd.isdisjoint(core)):
            return None
        low = core.lower()
        ids = self.words.get(low)
        if ids is None:
            ids = self._keep(low, _raw([t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))]))
        if len(core) == len(word):
            return ids
        tail = word[len(core):]
        marks = self.words.get(tail)
        if marks is None:
            marks = self._keep(tail, _raw(self.whole.encode(tail, add_special_tokens=False).ids))
        return ids + marks

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self.words) < KEPT_WORDS:
            self.words[word] = ids
        return ids

    def _ids(self, words: list[str]) -> list[bytes]:
        out = list(map(self.words.get, words))
        rest = []
        for n in [n for n, ids in enumerate(out) if ids is None]:
            ids = self._apart(words[n]) if self.fold else None
            if ids is None:
                rest.append(n)
            else:
                out[n] = self._keep(words[n], ids)
        if rest:
            for n, e in zip(rest, self.whole.encode_batch_fast([words[n] for n in rest], add_special_tokens=False)):
                out[n] = self._keep(words[n], _raw(e.ids))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, flat, and where each text's begin (with the end)."""
        place = _Places()
        word, counts = [], []
        for t in texts:
            found = t.replace("\n", " ").split(" ") if self.split else [t]
            counts.append(len(found))
            word += map(place.__getitem__, found)
        ids = self._ids(list(place))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        store = np.frombuffer(b"".join(ids), np.uint32)
        word = np.array(word, np.int64)
        lengths = size[word]
        flat = store[take_runs((np.cumsum(size) - size)[word], lengths)]
        return flat, starts_of(lengths)[starts_of(np.array(counts, np.int64))]


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, made once per worker."""
    kept = worker_cache("word_tokenizers", dict)
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write(df: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, in the order of ``key`` into files in ``folder``; the list of files
    (part, number, file, docs, ids), in whose order of part and number the keys ascend.

    Texts are dealt by ranges of the key, so tasks write their files side by side; rows with equal keys are in the order of a hash
    of the text. A file is written under a name of its own and counts only if the list names it, so a task that is run
    again does no harm. A null text counts as an empty one and has the end id alone; null keys come first. Very long texts are
    read whole; an empty table gives no files. Other columns are ignored, whatever their names. ``folder`` must be one that
    driver and executors share, ``path`` a tokenizer file there on every executor.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    fs, target = _filesystem(folder)
    fs.create_dir(target, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = tokenizer(path), TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            ids, lengths = (np.concatenate([h[j] for h in held]) for j in (1, 2))
            keys = [k for h in held for k in h[0]]
            name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.ids"
            files, where = _filesystem(folder)
            with files.open_output_stream(posixpath.join(where, name)) as out:
                out.write(file_bytes(keys, ids, np.cumsum(lengths)))
            row = [part, number, name, len(keys), len(ids)]
            number, size = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("part", "number", "file", "docs", "ids"), row))], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for at, texts in pieces(batch.column("text").to_pylist(), 4 * PIECE_CHARS):
                flat, starts = own.encode(texts)
                ends = starts[1:]
                held.append((keys[at:at + len(texts)], np.insert(flat, ends, end_id), np.diff(starts) + 1))
                size += len(flat) + len(texts)
                if size >= FILE_IDS:
                    yield close()
        if held:
            yield close()

    return materialize(rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text").mapInArrow(
        run, "part int, number int, file string, docs long, ids long"))


def read(files: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the listed files, read from them; start counts the ids of all documents before it.

    Each file is read by one task.
    """
    before = F.coalesce(F.sum("ids").over(
        Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("file", before.alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _filesystem(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with fs.open_input_stream(posixpath.join(where, name)) as f:
                    file = TokenFile.parse(f.read())
                ends = file.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                wide = np.ascontiguousarray(file.ids, "<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.keys, pa.int64()), pa.array(starts + before), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["key", "start", "n_tokens", "ids_crc32"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(n, "file").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long").withColumnsRenamed({"key": key})


def write_and_read(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``df`` to files in the shared folder and read them back."""
    folder = shared_dir(df.sparkSession)
    return read(write(df, folder, path, key, text), folder, key)
