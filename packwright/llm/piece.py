"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

All distinct words of a run of texts lie in one flat array of symbols. In every round each word's best pair is found by a segmented
minimum of pair ranks, all words merge theirs at once, leftmost first, and the array is compacted; words without a pair
left drop out. A word takes as many rounds as merges build on each other, whatever the number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import list_array, pieces, starts_of, take_runs, worker_cache

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
#: Words whose ids a worker keeps for later texts; others are encoded again.
KEPT_WORDS = 200_000
_NONE = np.int32(1 << 30)
_PROBES = ["", " ", "  a b   c", "Hello, wörld!\n\n\tx", "日本 \U0001d4b3", "aaaaaaaaaaaaaaaa" * 3, " " * 40 + "z", "<s> <0x41> ▁"]


class PieceCodec:
    """A BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int32)
        self.text = [p.replace(SPACE, " ") for p in self.names]
        self.high_byte = {}
        normal = {}
        for i, p in enumerate(self.names):
            if model.is_byte(i):
                b = int(p[3:-1], 16)
                self.bytes[b] = i
                self.text[i] = chr(b) if b < 128 else "\0"
                if b >= 128:
                    self.high_byte[i] = b
            elif model.is_control(i):
                self.text[i] = ""
            elif model.is_unknown(i):
                self.text[i] = UNKNOWN_TEXT
            else:
                normal[p] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte fallback")
        self.control = {i for i in range(n) if model.is_control(i)}
        # Characters that occur in pieces only take part in merges, too, under ids beyond the model's.
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        size = max([n, *(i + 1 for i in symbols.values())])
        self.real = n
        scores = np.array([model.get_score(i) for i in range(n)])
        order = np.unique(-scores, return_inverse=True)[1]
        self.rank = np.full(size + 1, _NONE, np.int32)
        for i in normal.values():
            self.rank[i] = order[i]
        keys, merged = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        self._build(np.array(keys, np.int64), np.array(merged, np.int32))
        self.first = np.full(1 << 16, -1, np.int32)
        self.astral = {}
        for c, i in symbols.items():
            if len(c) == 1 and ord(c) < 1 << 16:
                self.first[ord(c)] = i
            elif len(c) == 1:
                self.astral[ord(c)] = i
        # Where no piece goes on with a space after something else, words are encoded on their own.
        self.split = not any(SPACE in p.lstrip(SPACE) for p in normal)
        self.words: dict[str, bytes] = {}
        flat, starts = self.encode(_PROBES)
        for i, probe in enumerate(_PROBES):
            if flat[starts[i]:starts[i + 1]].tolist() != model.encode(probe):
                raise ValueError("the model is of another kind: plain BPE without normalisation is supported")

    def _build(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """A hash table from pairs to what they merge into; cells hold chains in order of collision."""
        bits = max(10, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shift = np.uint64(64 - bits)
        cell = self._cell(keys)
        self.tables = []
        left = np.arange(len(keys))
        while left.size:
            _, pick = np.unique(cell[left], return_index=True)
            at = left[pick]
            key, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            key[cell[at]], value[cell[at]] = keys[at], merged[at]
            self.tables.append((key, value))
            left = np.delete(left, pick)

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of symbols merge into, -1 for nothing."""
        keys = left.astype(np.int64) << 32 | right
        cell = self._cell(keys)
        key, value = self.tables[0]
        out = np.where(key[cell] == keys, value[cell], np.int32(-1))
        open_ = np.flatnonzero((out < 0) & (key[cell] >= 0))
        for key, value in self.tables[1:]:
            hit = key[cell[open_]] == keys[open_]
            out[open_[hit]] = value[cell[open_[hit]]]
            open_ = open_[~hit & (key[cell[open_]] >= 0)]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and where each word's begin."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        high = codes >= 1 << 16
        sym = self.first[np.where(high, 0, codes)]
        if high.any():
            sym[high] = [self.astral.get(c, -1) for c in codes[high].tolist()]
        # A symbol without a piece is told by its place, for its bytes are written in the end.
        place = np.arange(len(sym))
        done_sym, done_word, done_place = [], [], []
        while sym.size:
            ok = (word[:-1] == word[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0)
            into = np.full(sym.size, -1, np.int32)
            at = np.flatnonzero(ok)
            into[at] = self._merge(sym[at], sym[at + 1])
            rank = np.where(into >= 0, self.rank[into], _NONE)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(begins, sym.size))
            least = np.repeat(np.minimum.reduceat(rank, begins), sizes)
            over = least == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                done_place.append(place[over])
                live = ~over
                sym, word, place, into, rank, least = (x[live] for x in (sym, word, place, into, rank, least))
                if not sym.size:
                    break
            hit = np.flatnonzero(rank == least)
            # In a run of overlapping hits every other one merges, from the left.
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run = hit[fresh][np.cumsum(fresh) - 1]
            chosen = hit[(hit - run) % 2 == 0]
            chosen = self._safe(chosen, sym, word, into, rank)
            sym = sym.copy()
            sym[chosen] = into[chosen]
            keep = np.ones(sym.size, bool)
            keep[chosen + 1] = False
            sym, word, place = sym[keep], word[keep], place[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, word, place = (np.concatenate(x) for x in (done_sym, done_word, done_place))
        order = np.argsort(place, kind="stable")
        sym, word, place = sym[order], word[order], place[order]
        odd = np.flatnonzero((sym < 0) | (sym >= self.real))
        if odd.size:
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[place[odd]].tolist()]
            sizes = np.ones(sym.size, np.int64)
            sizes[odd] = [len(r) for r in raw]
            fill = np.repeat(np.isin(np.arange(sym.size), odd), sizes)
            sym, word = np.repeat(sym, sizes), np.repeat(word, sizes)
            sym[fill] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return sym.astype(np.int32), np.searchsorted(word, np.arange(len(words) + 1))

    def _safe(self, chosen: np.ndarray, sym: np.ndarray, word: np.ndarray, into: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The merges that can be made at once: all of a word's, unless one of them makes a pair that comes no later than
        the others, for then the order counts and only the first is made."""
        own = word[chosen]
        many = np.zeros(chosen.size, bool)
        many[1:] = own[1:] == own[:-1]
        many[:-1] |= own[1:] == own[:-1]
        if not many.any():
            return chosen
        pick = chosen[many]
        new = into[pick]
        size = sym.size
        after = np.minimum(pick + 2, size - 1)
        ok = (pick + 2 < size) & (word[after] == word[pick]) & (sym[after] >= 0)
        right = np.where(ok, self.rank[self._merge(new, np.where(ok, sym[after], 0))], _NONE)
        before = np.maximum(pick - 1, 0)
        merged_before = np.zeros(size, bool)
        merged_before[chosen + 1] = True
        joined = (pick > 0) & merged_before[before]
        left_sym = np.where(joined, into[np.maximum(pick - 2, 0)], sym[before])
        ok = (pick > 0) & (word[before] == word[pick]) & (left_sym >= 0)
        left = np.where(ok, self.rank[self._merge(np.where(ok, left_sym, 0), new)], _NONE)
        bad = np.unique(word[pick[(right <= rank[pick]) | (left <= rank[pick])]])
        if not bad.size:
            return chosen
        first = np.concatenate([[True], own[1:] != own[:-1]])
        return chosen[first | ~np.isin(own, bad)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, flat, and where each text's begin (with the end)."""
        place: dict[str, int] = {}
        word, counts = [], []
        for t in texts:
            found = self._words(t)
            counts.append(len(found))
            word += [place.setdefault(w, len(place)) for w in found]
        known = [self.words.get(w) for w in place]
        new = [w for w, ids in zip(place, known) if ids is None]
        flat, starts = self.encode_words(new)
        if len(self.words) + len(new) <= KEPT_WORDS:
            raw, edges = flat.tobytes(), (4 * starts).tolist()
            self.words.update((w, raw[a:b]) for w, a, b in zip(new, edges, edges[1:]))
        # Ids of the known words, then those of the new ones.
        had = [ids for ids in known if ids is not None]
        sizes = np.fromiter(map(len, had), np.int64, len(had)) // 4
        store = np.concatenate([np.frombuffer(b"".join(had), np.int32), flat])
        begin, size = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        old = np.array([ids is not None for ids in known], bool)
        begin[old], size[old] = np.cumsum(sizes) - sizes, sizes
        begin[~old], size[~old] = starts[:-1] + sizes.sum(), np.diff(starts)
        word = np.array(word, np.int64)
        lengths = size[word]
        ends = starts_of(lengths)
        return store[take_runs(begin[word], lengths)], ends[starts_of(np.array(counts, np.int64))]

    def _words(self, text: str) -> list[str]:
        """Runs of spaces, each with what follows up to the next space."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return _WORD.findall(text) if self.split else [text]

    def decode(self, flat: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        out = []
        table, high = self.text, self.high_byte
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            ids = flat[a:b].tolist()
            lead = next((i for i in ids if i not in self.control), None)
            if high and not high.keys().isdisjoint(ids):
                text = "".join(self._runs(ids))
            else:
                text = "".join(map(table.__getitem__, ids))
            out.append(text[1:] if lead is not None and self.names[lead].startswith(SPACE) else text)
        return out

    def _runs(self, ids: list[int]) -> Iterator[str]:
        run = bytearray()
        for i in ids:
            if i in self.high_byte:
                run.append(self.high_byte[i])
                continue
            if run:
                yield _valid(bytes(run))
                run.clear()
            yield self.text[i]
        if run:
            yield _valid(bytes(run))


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _valid(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[:e.start].decode() + "�" + _valid(raw[e.start + 1:])


def codec(path: str) -> PieceCodec:
    """The codec of a model file, made once per worker."""
    kept = worker_cache("piece_codecs", dict)
    if path not in kept:
        kept[path] = PieceCodec(path)
    return kept[path]


def encode(df: DataFrame, path: str, *keep: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with ``ids`` (array of int), as the sentencepiece library encodes the whole
    text with the BPE model in ``path``, without begin and end.

    A null text counts as an empty one and has no ids. Repeated rows get equal ids; very long texts and words are read whole; an
    empty table gives no rows. ``path`` must be there on every executor. With ``decoded`` the ids are decoded
    in the same pass, into a column of that name, which spares a second set of Python workers.
    """
    chosen = df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text).alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            names = [c for c in batch.schema.names if c != "__text"]
            for at, texts in pieces(batch.column("__text").to_pylist()):
                flat, starts = own.encode(texts)
                back = [pa.array(own.decode(flat, starts), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, len(texts)) for c in names), list_array(pa.array(flat, pa.int32()), starts), *back],
                    [*names, "ids", *["decoded"] * decoded])

    return chosen.mapInArrow(run, kinds + "ids array<int>" + ", decoded string" * decoded).select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "ids", *["decoded"] * decoded)


def decode(df: DataFrame, path: str, *keep: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with the text of its ids, as the sentencepiece library decodes them.

    Null ids count as none and give an empty text.
    """
    chosen = df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)),
                       F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema if f.name != "__ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            names = [c for c in batch.schema.names if c != "__ids"]
            lists = batch.column("__ids")
            starts = lists.offsets.to_numpy().astype(np.int64)
            texts = own.decode(lists.flatten().to_numpy(), starts - starts[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return chosen.mapInArrow(run, kinds + "decoded string").select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), F.col("decoded").alias(text))
