"""Byte-pair encoding of whole texts with numpy.

A batch of texts is one array of code points. Where pre-tokens begin and end follows from the classes of
neighbouring code points, so they are found without a loop over texts. Pre-tokens are told apart by two 64-bit
hashes; only those not met before are encoded. These are put into padded matrices by length, one row for each, and
in every round each row merges its leftmost pair of least rank; pairs are looked up in a hash table. The columns
after the pair move up. Rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Code points handled at once; bounds the memory of a worker, whatever the texts.
CHUNK = 1 << 20
#: Pre-tokens of more bytes than this are merged with a heap: a matrix row costs the square of its length.
LONG_TOKEN = 1024
#: Encoded pre-tokens that a worker remembers.
CACHE = 1 << 20
_INF = np.int32(2**31 - 1)
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def tokenizer_path(name: str = DEFAULT_RANKS) -> str:
    """Where a file of the public tokenizers is; the folder is found at run time and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for low, high in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[low : high + 1] = _SPACE
    return out


class PairTable:
    """(left id, right id) -> rank of the merged token, as open addressing in two numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, _INF, np.int32)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[todo[won]], values[todo[won]]
            keep = np.ones(len(todo), bool)
            keep[won] = False
            todo, slot = todo[keep], (slot[keep] + np.uint64(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = ((left.astype(np.int64).ravel() << 32) | right.astype(np.int64).ravel()).view(np.uint64)
        slot = self._home(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], _INF)
        todo = np.flatnonzero((there != keys) & (there != np.uint64(2**64 - 1)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + np.uint64(1)) & self.mask
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there != np.uint64(2**64 - 1))
            todo, slot = todo[more], slot[more]
        return out.reshape(shape)


class BytePairEncoder:
    """Encodes batches of texts by the ranks in a file of lines `base64 rank`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.table = PairTable(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        rng = np.random.default_rng(20_240_229)
        self.salts = [int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, 4)]
        self._powers: list[np.ndarray] = []
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.second = np.zeros(1024, np.uint64)
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    # Pre-tokens

    @staticmethod
    def bounds(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of the texts that begin at `text_starts` in `points`."""
        n = len(points)
        kind = _classes()[points]
        first = np.zeros(n + 1, bool)
        first[text_starts] = True
        first[n] = True
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # A run of white space gives its last character away if a word follows: a blank goes to the word, any other stands alone.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        start |= last
        blank = np.zeros(n, bool)
        blank[1:] = last[:-1] & (points[:-1] == 32)
        start &= ~blank
        # 's 't 'm 'd 're 've 'll are split off where the apostrophe begins a pre-token.
        at = np.flatnonzero((points == 39) & start)
        at = at[at + 1 < n]
        at = at[~first[at + 1]]
        if len(at):
            one = points[at + 1]
            two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
            two = np.where(first[np.minimum(at + 2, n)], 0, two)
            short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            start[at[short | long] + 1] = False
            for where, k in ((at[short], 2), (at[long & ~short], 3)):
                stop = where + k
                stop = stop[stop < n]
                # What follows is a new pre-token, unless it is the blank of one that has begun already.
                start[stop] = True
        return np.flatnonzero(start)

    def _hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(points)
        if not self._powers or len(self._powers[0]) < n + 1:
            self._powers = []
            for base in self.salts[:2]:
                for b in (base, pow(base, -1, 1 << 64)):
                    p = np.full(max(n, CHUNK) + 1, np.uint64(b))
                    p[0] = 1
                    self._powers.append(np.multiply.accumulate(p))
        out = []
        for i, salt in enumerate(self.salts[2:]):
            mixed = points.astype(np.uint64) + np.uint64(1 + i)
            mixed *= np.uint64(salt)
            mixed ^= mixed >> np.uint64(29)
            mixed *= self._powers[2 * i][:n]
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed, out=sums[1:])
            out.append((sums[ends] - sums[starts]) * self._powers[2 * i + 1][starts])
        return out[0], out[1]

    # Merging

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONG_TOKEN:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            for low in range(0, len(rows), max(1, (1 << 20) // width)):
                some = rows[low : low + max(1, (1 << 20) // width)]
                for i, ids in zip(some, self._merge_matrix([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = self.of_byte[joined]
        ranks = self._ranks(ids)
        out: list[np.ndarray | None] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _INF)
            done = best == _INF
            for k in np.flatnonzero(done):
                row = ids[k]
                out[rows[k]] = row[row >= 0].copy()
            go = ~done
            rows, ids, at, best, ranks = rows[go], ids[go], at[go], best[go], ranks[go]
            if not len(rows):
                break
            line = np.arange(len(rows))
            ids[line, at] = best
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = keep[:, 1:]
            ranks = ranks[keep].reshape(len(rows), -1)
            if ranks.shape[1]:
                # Only the pairs to the left and right of the new token have changed.
                for off in (-1, 0):
                    j = at + off
                    ok = (j >= 0) & (j < ranks.shape[1])
                    l, r = ids[line[ok], j[ok]], ids[line[ok], j[ok] + 1]
                    ranks[line[ok], j[ok]] = np.where(r < 0, _INF, self.table.look_up(l, r))
        return out

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        left, right = ids[:, :-1], ids[:, 1:]
        return np.where(right < 0, _INF, self.table.look_up(left, right)).astype(np.int32)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap over a linked list."""
        ids = [int(x) for x in self.of_byte[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(rank << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if (p := before[i]) >= 0 and (r := get(ids[p] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, p, ids[p], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    # Batches

    def _slots(self, text: str, first: np.ndarray, second: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot in the memory of each pre-token; new ones are encoded."""
        codes, uniques = pd.factorize(first)
        where = np.zeros(len(uniques), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if (second != second[where][codes]).any():  # two pre-tokens share their first hash: told apart by their text
            codes, texts = pd.factorize(np.array([text[s:e] for s, e in zip(starts, ends, strict=True)], object))
            found = self.merge_many([t.encode() for t in texts])
            return self._store([None] * len(texts), np.zeros(len(texts), np.uint64), found)[codes]
        keys = uniques.tolist()
        slots = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        old = slots >= 0
        if (self.second[slots[old]] != second[where[old]]).any():
            self._forget()
            slots[:] = -1
        new = np.flatnonzero(slots < 0)
        if len(new):
            at = where[new]
            found = self.merge_many([text[s:e].encode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slots[new] = self._store([keys[i] for i in new], second[at], found)
        return slots[codes]

    def _store(self, keys: list[int | None], second: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        slots = np.arange(self.used, self.used + len(found))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        end = int(self.starts[self.used - 1] + self.lengths[self.used - 1]) if self.used else 0
        need, cells = self.used + len(found), end + int(lengths.sum())
        if need > len(self.starts):
            self.second, self.lengths, self.starts = (np.concatenate([x, np.zeros(2 * need - len(x), x.dtype)]) for x in (self.second, self.lengths, self.starts))
        if cells > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(2 * cells - len(self.flat), np.int32)])
        self.second[slots], self.lengths[slots] = second, lengths
        self.starts[slots] = end + np.cumsum(lengths) - lengths
        if len(found):
            self.flat[end:cells] = np.concatenate(found)
        self.used = need
        self.known.update((k, s) for k, s in zip(keys, slots.tolist(), strict=True) if k is not None)
        return slots

    def encode_text(self, text: str, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that `text` holds one after the other, and the number of ids of each."""
        n = len(text)
        count = np.zeros(len(text_starts), np.int64)
        if not n:
            return np.zeros(0, np.int32), count
        if self.used > CACHE:
            self._forget()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = self.bounds(points, text_starts[text_starts < n])
        ends = np.append(starts[1:], n)
        slots = self._slots(text, *self._hashes(points, starts, ends), starts, ends)
        lengths = self.lengths[slots]
        total = int(lengths.sum())
        offset = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(self.starts[slots] - offset, lengths) + np.arange(total)]
        owner = np.searchsorted(text_starts, starts, "right") - 1
        np.add.at(count, owner, lengths)
        return ids, count

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; an empty array for an empty text and for null."""
        flat, counts = self.encode_column(pa.array(texts, pa.string()))
        return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and the number of ids of each."""
        parts, counts = [], np.zeros(len(column), np.int64)
        rows: list[int] = []
        size, some = 0, []

        def flush() -> None:
            nonlocal size, some, rows
            if rows:
                lengths = np.fromiter(map(len, some), np.int64, len(some))
                ids, number = self.encode_text("".join(some), np.cumsum(lengths) - lengths)
                parts.append(ids)
                np.add.at(counts, rows, number)
            size, some, rows = 0, [], []

        for row, text in enumerate(column.to_pylist()):
            for piece in _pieces(text):
                some.append(piece)
                rows.append(row)
                size += len(piece)
                if size >= CHUNK:
                    flush()
        flush()
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts


def _pieces(text: str | None) -> Iterator[str]:
    """A text whole, or a very long one in pieces: cut before white space that follows a word, where a pre-token always ends."""
    if not text:
        return
    low = 0
    while len(text) - low > 2 * CHUNK:
        cut = low + CHUNK
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace() and not "\x1c" <= text[cut - 1] <= "\x1f"):
            cut += 1
        yield text[low:cut]
        low = cut
    if low < len(text):
        yield text[low:]


_ENCODERS: dict[str, BytePairEncoder] = {}


def encode_corpus(df: DataFrame, key: str, text: str, ranks: str = DEFAULT_RANKS, path: str | None = None, out: str = "ids") -> DataFrame:
    """`key` and the ids of `text` for every row. No special tokens; an empty list for an empty and for a null text.

    One pass over the rows where they lie: no shuffle. `ranks` names a file of the public tokenizers, `path` any
    other file of ranks that all executors can read. Repeated rows stay repeated. Other columns are dropped.
    """
    schema = T.StructType([df.schema[key], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path or tokenizer_path(ranks)
        if at not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[at] = BytePairEncoder(at)
        for whole in batches:
            for low in range(0, whole.num_rows, 2_000):
                batch = whole.slice(low, 2_000)
                column = batch.column(1)
                flat, counts = _ENCODERS[at].encode_column(column)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, out])

    return df.select(key, F.col(text)).mapInArrow(run, schema)
