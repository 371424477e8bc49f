"""Byte-level BPE: vectorised pre-tokenising, cached pair merging, decoding by offsets.

Code points are mapped to symbols (class and what follows), and an automaton of eight states says
before which of them a piece starts. Its transition functions compose associatively: every block of
a text is folded into one function from entry state to exit state, all blocks at once, the block
functions are scanned by doubling, and a second pass over the blocks yields the state before every
code point. No regular expression runs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import held, map_batches, text_chunks

# Symbols of the automaton.
LETTER, DIGIT, OTHER, QUOTE1, QUOTE2, BLANK, JOIN, CUT, RESET = range(9)
# Its states: nothing open, in letters, digits, others, blanks, after a joining space, one or two letters of a contraction to come.
FRESH, IN_LETTER, IN_DIGIT, IN_OTHER, IN_BLANK, JOINED, LAST1, LAST2 = range(8)

_BLOCK = 128
_FAR = np.int64(1 << 60)
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, by code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, 2, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind in "LN":
                table[cp] = kind == "N"
        spaces = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[spaces] = 3
        _classes = table
    return _classes


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, for symbol * 8 + state."""
    go, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, inside in ((LETTER, IN_LETTER), (DIGIT, IN_DIGIT), (OTHER, IN_OTHER)):
        go[symbol] = inside
        starts[symbol, [inside, JOINED]] = False
    go[LETTER, LAST2], go[LETTER, LAST1] = LAST1, FRESH
    starts[LETTER, [LAST1, LAST2]] = False
    for symbol, then in ((QUOTE1, LAST1), (QUOTE2, LAST2)):
        go[symbol] = then
        go[symbol, [IN_OTHER, JOINED]] = IN_OTHER
        starts[symbol, [IN_OTHER, JOINED]] = False
    go[BLANK] = IN_BLANK
    starts[BLANK, IN_BLANK] = False
    go[JOIN], go[CUT], go[RESET] = JOINED, FRESH, FRESH
    starts[RESET] = False
    return go.ravel(), starts.ravel()


_GO, _STARTS = _automaton()


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; ends: the place of the RESET that follows each text."""
    kind = np.full(len(points) + 2, 4, np.uint8)
    safe = points.copy()
    safe[ends] = 32
    kind[: len(points)] = _class_table()[safe]
    kind[ends] = 4
    char = np.zeros(len(points) + 2, np.uint32)
    char[: len(points)] = points
    char[ends] = 0
    now, after = kind[:-2], kind[1:-1]
    out = now.copy()
    blank = now == 3
    follows = blank & (after < 3)
    out[blank] = BLANK
    out[follows] = np.where(points[follows] == 32, JOIN, CUT)
    quotes = np.flatnonzero(points == 39)
    one, two = char[quotes + 1], char[quotes + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    out[quotes[single]] = QUOTE1
    out[quotes[double]] = QUOTE2
    out[ends] = RESET
    return out


def piece_starts(signs: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each symbol, from the state FRESH."""
    n = len(signs)
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, RESET, np.uint8)
    grid[:n] = signs
    rows = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T.astype(np.intp) * 8)
    fold = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in rows:  # one function a block
        fold = _GO[row[:, None] + fold]
    step = 1
    while step < blocks:  # fold[i] becomes the composition of blocks 0..i
        fold[step:] = np.take_along_axis(fold[step:], fold[:-step].copy(), axis=1)
        step *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = fold[:-1, FRESH]
    out = np.empty((_BLOCK, blocks), bool)
    for i, row in enumerate(rows):
        at = row + state
        out[i] = _STARTS[at]
        state = _GO[at]
    return out.T.ravel()[:n]


def pieces(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where pieces start, in UTF-8 texts back to back, and the first piece of each text (n + 1 values)."""
    n = len(offs) - 1
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.searchsorted(lead, offs)
    ends = first[1:] + np.arange(n)  # a RESET after each text
    spread = np.zeros(len(points) + n, np.uint32)
    real = np.ones(len(spread), bool)
    real[ends] = False
    spread[real] = points
    starts = lead[piece_starts(symbols(spread, ends))[real]]
    return starts, np.searchsorted(starts, offs)


class Merger:
    """Merges the pairs of a piece by rank; results are kept up to a number of pieces."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 600_000) -> None:
        self.ranks, self.keep = ranks, keep
        self.known: dict[bytes, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)))[:-1] if size else np.zeros(0, np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [b"%d" % i for i in range(size)]
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.pair_keys: np.ndarray | None = None
        self.pair_ranks = np.zeros(0, np.int64)

    def ids(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self._long(piece)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the pairs of tokens that make a token, and its rank."""
        if self.pair_keys is None:
            found = {}
            for token, rank in self.ranks.items():
                for i in range(1, len(token)):
                    a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                    if a is not None and b is not None:
                        found[a << 32 | b] = rank
            keys = np.array(sorted(found), np.int64)
            self.pair_keys, self.pair_ranks = keys, np.array([found[k] for k in keys.tolist()], np.int64)
        return self.pair_keys, self.pair_ranks

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self._pairs()
        want = left << 32 | right
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        if not len(keys):
            return np.full(len(want), _FAR)
        return np.where((keys[at] == want) & (left >= 0) & (right >= 0), ranks[at], _FAR)

    def _merge_many(self, found: list[bytes]) -> list[list[int]]:
        """Merge all these short pieces together, one merge a piece in every round; ties go to the left."""
        n, width = len(found), max(map(len, found))
        size = np.fromiter(map(len, found), np.int64, n)
        flat = self.single[np.frombuffer(b"".join(found), np.uint8)]
        inside = np.arange(width) < size[:, None]
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][inside] = flat
        after = np.minimum(np.arange(1, width + 2), width)[None].repeat(n, 0)
        before = np.arange(-1, width)[None].repeat(n, 0)
        rank = np.full((n, width + 1), _FAR)
        rank[:, : width - 1] = self._rank(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            go = best < _FAR
            live, at, best = live[go], at[go], best[go]
            gone = after[live, at]
            right = after[live, gone]
            ids[live, at], ids[live, gone] = best, -2
            rank[live, gone] = _FAR
            after[live, at], before[live, right] = right, at
            rank[live, at] = self._rank(best, ids[live, right])
            left = before[live, at]
            has = left >= 0
            rank[live[has], left[has]] = self._rank(ids[live[has], left[has]], best[has])
        kept = ids[:, :width] >= 0
        values, ends = ids[:, :width][kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _long(self, piece: bytes) -> list[int]:
        get, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle <= i or middle >= n or end[middle] != stop or middle == stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def fill(self, found: list[bytes]) -> None:
        """Have the decimal ids of all these pieces at hand."""
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        new, short = set(found).difference(known), []
        for piece in new:
            rank = self.ranks.get(piece)
            if rank is not None:
                known[piece] = self.decimal[rank]
            elif len(piece) <= 32:
                short.append(piece)
            else:
                known[piece] = b",".join([b"%d" % i for i in self._long(piece)])
        short.sort(key=len)
        for lo in range(0, len(short), 8192):
            part = short[lo : lo + 8192]
            for piece, ids in zip(part, self._merge_many(part), strict=True):
                known[piece] = b",".join([self.decimal[i] for i in ids])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens, gathered by offset and length."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends + size, size)].tobytes()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _merger(key: str, data: bytes) -> Merger:
    return held(key, lambda: Merger(parse_ranks(data)))


def encode_batch(texts: pa.Array, merger: Merger) -> Iterator[bytes]:
    """Decimal ids joined by commas, a text at a time."""
    for lo, hi, buf, offs in text_chunks(texts):
        if not len(buf):
            yield from (b"" for _ in range(lo, hi))
            continue
        starts, first = pieces(buf, offs)
        data, at = buf.tobytes(), starts.tolist()
        found = [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]
        merger.fill(found)
        ids = list(map(merger.known.__getitem__, found))
        for i in range(hi - lo):
            yield b",".join(ids[first[i] : first[i + 1]])


def to_ids(joined: bytes) -> np.ndarray:
    return np.fromstring(joined.decode(), np.int32, sep=",") if joined else np.zeros(0, np.int32)


def encode(docs: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_tokens and ids (array<int>); null texts count as empty and have no ids."""
    data = open(ranks_path, "rb").read()
    key = hashlib.sha256(data).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary file, not data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(key, shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [to_ids(x) for x in encode_batch(part.column(len(keep)), merger)]
                sizes = np.array([0, *(len(x) for x in ids)]).cumsum()
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                values = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(sizes), pa.int64()), values], [*keep, "n_tokens", "ids"])

    source = docs.select(*keep, "text")
    kinds = ", ".join(f"`{name}` {source.schema[name].dataType.simpleString()}" for name in keep)
    return map_batches(source, run, f"{kinds}, n_tokens long, ids array<int>", key)


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them. One row a row; null texts are empty."""
    data = open(ranks_path, "rb").read()
    key = hashlib.sha256(data).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(key, shared.value)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for joined in encode_batch(batch.column(1), merger):
                ids = to_ids(joined)
                counts.append(len(ids))
                coded.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(merger.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", F.col("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", key)
