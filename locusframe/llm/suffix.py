"""Removal of repeated byte strings with hash-compared suffix sorting.

A string of `size` bytes that occurs twice has the same least k-gram hash in both places, so its two
copies hang on equal anchors. Every text is cut into extents: the strings that share one anchor,
back to back. Equal extents (equal 128-bit prefix hashes) are one extent with a count, so the sort
sees every different one once. Extents whose anchor occurs with other extents too are cut into pieces
of few offsets from the anchor; pieces that share the bytes common to all their strings meet, and the
suffixes of such pieces are sorted: prefix hashes and binary search give common extensions, so a
comparison takes logarithmic time, in a mergesort that runs over all groups at once. Equal neighbours
are then compared byte by byte. A group of too many different pieces for one task is cut into pieces of
half as many offsets, which share more bytes, and so on; at one offset all pieces of a group are equal.

Texts are known by a 128-bit hash; copies of a text are one text with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import LOWER, SPACE, Bloom, PrefixHash, map_batches, materialise, mix64, scratch, text_chunks, word_spans

SIZE = 400
BLOCK = 32
#: Different pieces that one sort holds at most (some 2 MB of bytes); larger groups are cut before they are sorted.
GROUP = 4096
#: Bytes as they are compared when letter case and the kind of white space do not count; lengths stay.
FOLD = np.where(SPACE, 32, LOWER).astype(np.uint8)
_C = np.uint64(0x9E3779B97F4A7C15)


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, from running minima inside blocks."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(buf: np.ndarray, offs: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """Text index, anchor hash, two extent hashes, anchor, first and last start of its strings, for texts back to back."""
    return _anchors_of(PrefixHash(buf), PrefixHash(buf, 1), offs, size)


def _anchors_of(hashes: PrefixHash, second: PrefixHash, offs: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    gram = max(1, size * 8 // 25)  # shorter ones give fewer anchors, longer ones rarer anchors
    none, n = (np.zeros(0, np.int64),) * 7, len(hashes.sums) - 1
    if n < size:
        return none
    at = np.arange(n - gram + 1)
    h = mix64(hashes.of(at, at + gram))
    low = _sliding_least((h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), size - gram + 1)
    least = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the leftmost place of the least hash
    text = np.repeat(np.arange(len(offs) - 1), np.maximum(np.diff(offs), 0))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + size <= offs[1:][text])
    if not len(start):
        return none
    least, text = least[start], text[start]
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    lo, hi, anchor, text = start[new], start[np.append(new[1:], len(start)) - 1], least[new], text[new]
    shape = (hi - lo).astype(np.uint64) * _C + (anchor - lo).astype(np.uint64)
    extents = [mix64(mix64(x.of(lo, hi + size)) + shape).view(np.int64) for x in (hashes, second)]
    base = offs[text]
    return text, h[anchor].view(np.int64), *extents, anchor - base, lo - base, hi - base


def _before(hashes: PrefixHash, buf: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Whether string x sorts before string y; the common extension is found by binary search on prefix hashes."""
    common = extension(hashes, x, y, size)
    short = common < size
    i = np.minimum(common, size - 1)
    return np.where(short, buf[x + i] < buf[y + i], False)


def extension(hashes: PrefixHash, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Common bytes, at most size, of the strings at x and y."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), size, np.int64)
    for _ in range(int(size).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = hashes.of(x, x + mid) == hashes.of(y, y + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        hi = np.maximum(hi, lo)
    return lo


def sort_suffixes(buf: np.ndarray, hashes: PrefixHash, starts: np.ndarray, segment: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Order of starts (given by ascending segment) that sorts the strings of every segment.

    Bottom-up mergesort: in each round all pairs of neighbouring runs merge at once, each string
    finding by binary search how many strings of the other run come before it."""
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order
    first = np.searchsorted(segment, segment)  # start of the segment of each place
    stop = np.searchsorted(segment, segment, "right")
    width = 1
    while width < int((stop - first).max()):
        place = np.arange(n)
        run = (place - first) // width
        other = first + np.where(run % 2 == 0, run + 1, run - 1) * width
        lo = np.minimum(other, stop)
        base, hi = lo.copy(), np.minimum(other + width, stop)
        active = np.flatnonzero(lo < hi)
        right = run % 2 == 1
        mine = starts[order]
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            x, y = mine[active], mine[mid]
            # a string of the left run goes before its equals on the right
            ahead = np.where(right[active], ~_before(hashes, buf, x, y, size), _before(hashes, buf, y, x, size))
            lo[active] = np.where(ahead, mid + 1, lo[active])
            hi[active] = np.where(ahead, hi[active], mid)
            active = active[lo[active] < hi[active]]
        target = first + (run // 2) * 2 * width + (place - first) % width + (lo - base)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order = merged
        width *= 2
    return order


def _equal_bytes(buf: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    out = np.ones(len(x), bool)
    step = np.arange(size)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (buf[x[i : i + 4096, None] + step] == buf[y[i : i + 4096, None] + step]).all(1)
    return out


def repeated(buf: np.ndarray, starts: np.ndarray, segment: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Which strings of size bytes occur twice or more in their segment (segments ascending)."""
    hashes, flags = PrefixHash(buf), np.zeros(len(starts), bool)
    order = sort_suffixes(buf, hashes, starts, segment, size)
    a, b = order[:-1], order[1:]
    near = segment[a] == segment[b]
    near[near] = extension(hashes, starts[a[near]], starts[b[near]], size) >= size
    a, b = a[near], b[near]
    good = _equal_bytes(buf, starts[a], starts[b], size)
    flags[a[good]] = flags[b[good]] = True
    for s in np.unique(segment[a[~good]]):  # hashes met without equal bytes: settle the segment by its bytes
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(segment == s):
            j = seen.setdefault(buf[starts[i] : starts[i] + size].tobytes(), i)
            if j != i:
                flags[[i, j]] = True
    return flags


def keyed(docs: DataFrame) -> DataFrame:
    """docs inside row, the text as bytes, and its two hashes t1 and t2."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), data.alias("data"), F.xxhash64(data).alias("t1"), F.xxhash64(F.lit(1), data).alias("t2"))


def _find_anchors(texts: DataFrame, size: int, fold: bool) -> DataFrame:
    names = ["t1", "t2", "akey", "ext", "ext2", "a", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = np.array(batch.column(1)), np.array(batch.column(2))
            for low, _, buf, offs in text_chunks(batch.column(0)):
                text, *rest = anchors(FOLD[buf] if fold else buf, offs, size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[text + low], t2[text + low], *rest)], names)

    return map_batches(texts.where(F.length("data") >= size).select("data", "t1", "t2"), run, ", ".join(f"{n} long" for n in names))


_PIECES = ["t1", "t2", "akey", "block", "core", "n", "lo", "hi", "base", "piece", "bytes"]
_PIECES_SCHEMA = ", ".join(f"{n} long" for n in _PIECES[:-2]) + ", piece binary, bytes binary"


def _blocks_of(data: bytes, at: int, anchor: int, lo: int, hi: int, block: int, size: int) -> Iterator[tuple]:
    """Pieces (block number, core, first and last start, mark, bytes) of the strings lo to hi; data begins at place `at` of its text.

    A piece has the strings whose offset from the anchor lies in one run of `block` offsets. Its core is
    the hash of the bytes that all strings of the run have in common, its mark that of the piece itself."""
    for k in range((anchor - hi) // block, (anchor - lo) // block + 1):
        first, last = max(lo, anchor - k * block - block + 1), min(hi, anchor - k * block)
        core = hashlib.blake2b(data[anchor - k * block - at : anchor - k * block - block + 1 + size - at], digest_size=8).digest()
        piece = data[first - at : last + size - at]
        mark = hashlib.blake2b(piece + bytes([(anchor - last) % block, last - first]), digest_size=16).digest()
        yield k, int.from_bytes(core, "little", signed=True), first, last, mark, piece


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-2]), *(pa.array(c, pa.binary()) for c in columns[-2:])], _PIECES)


def _cut_pieces(texts: DataFrame, places: DataFrame, bloom: Bloom, size: int, fold: bool) -> DataFrame:
    """Pieces of the contested extents."""
    lists = places.groupBy("t1", "t2", "rep").agg(F.collect_list(F.struct("akey", "n", "a", "lo", "hi")).alias("places"))
    source = texts.where(bloom.may_have("t1")).select("t1", "t2", F.col("row.doc_id").alias("doc_id"), "data")
    joined = source.join(lists.withColumnsRenamed({"t1": "u1", "t2": "u2"}), (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    table = FOLD.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t1, t2, data = (batch.column(k)[i].as_py() for k in range(3))
                data = data.translate(table) if fold else data
                rows = [
                    (t1, t2, p["akey"], k, core, p["n"], lo, hi, p["a"], mark, piece)
                    for p in batch.column(3)[i].as_py()
                    for k, core, lo, hi, mark, piece in _blocks_of(data, 0, p["a"], p["lo"], p["hi"], BLOCK, size)
                ]
                if rows:
                    yield _piece_batch(rows)

    return map_batches(joined.select("t1", "t2", "data", "places"), run, _PIECES_SCHEMA)


def _halve(pieces: DataFrame, block: int, size: int) -> DataFrame:
    """The same strings in pieces of at most `block` offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (t1, t2, akey, k, core, n, first, last, base, mark, piece)
                for t1, t2, akey, n, lo, hi, base, data in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for k, core, first, last, mark, piece in _blocks_of(data, lo, base, lo, hi, block, size)
            ]
            if rows:
                yield _piece_batch(rows)

    return map_batches(pieces.select("t1", "t2", "akey", "n", "lo", "hi", "base", "bytes"), run, _PIECES_SCHEMA)


def _sorted_spans(pieces: DataFrame, size: int) -> DataFrame:
    """Spans (t1, t2, start, end) of repeated strings among the pieces of one anchor, block and core."""
    key = ["akey", "block", "core"]
    flow = pieces.repartition(*key).sortWithinPartitions(*key).select(*key, "t1", "t2", "n", "lo", "hi", "base", "bytes")
    names = ["t1", "t2", "start", "end"]

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        group, last = np.zeros(len(rows), np.int64), None
        for i, r in enumerate(rows):
            group[i] = group[i - 1] + (r[:3] != last) if i else 0
            last = r[:3]
        lo, hi, base = (np.array([r[k] for r in rows]) for k in (6, 7, 8))
        buf = np.frombuffer(b"".join(r[9] for r in rows), np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(r[9]) for r in rows])))[:-1]
        count = hi - lo + 1
        owner = np.repeat(np.arange(len(rows)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts, place = begin[owner] + step, lo[owner] + step
        segment = group[owner] * BLOCK + (base[owner] - place) % BLOCK
        order = np.argsort(segment, kind="stable")
        flags = np.zeros(len(starts), bool)
        flags[order] = repeated(buf, starts[order], segment[order], size)
        flags &= np.array([r[5] for r in rows])[owner] < 2  # those that occur twice as they stand are known
        hit = np.flatnonzero(flags)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)))) if len(hit) else hit
        first, final = hit[new], hit[np.append(new[1:], len(hit)) - 1] if len(hit) else hit
        t1, t2 = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[owner[first]], t2[owner[first]], place[first], place[final] + size)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= 4000 and held[-1][:3] != row[:3]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    return map_batches(flow, run, ", ".join(f"{n} long" for n in names))


def _settled(pieces: DataFrame, block: int, size: int) -> DataFrame:
    """Spans of all repeated strings of the pieces.

    Equal pieces are repeats as they stand; a group with different pieces, one of them alone, is sorted
    if GROUP of them are enough, else its pieces are halved and settled again."""
    ends = [F.col("lo").alias("start"), (F.col("hi") + size).alias("end")]
    key, spans = ["akey", "block", "core"], []
    while True:
        kinds = materialise(pieces.groupBy(*key, "piece").agg(F.sum("n").alias("total")), "kinds")
        spans.append(pieces.where("n < 2").join(kinds.where("total > 1"), [*key, "piece"]).select("t1", "t2", *ends))
        groups = kinds.groupBy(*key).agg(F.count("*").alias("m"), F.min("total").alias("fewest")).where("m > 1 AND fewest = 1").select(*key, "m")
        mixed = materialise(pieces.drop("n").join(groups, key).join(kinds, [*key, "piece"]).withColumnRenamed("total", "n").dropDuplicates([*key, "piece"]), "mixed")
        spans.append(_sorted_spans(mixed.where(F.col("m") <= GROUP), size))
        hot = mixed.where(F.col("m") > GROUP)
        if block == 1 or hot.isEmpty():
            break
        block //= 2
        pieces = materialise(_halve(hot, block, size), "pieces")
    return reduce(DataFrame.union, spans)


def repeated_spans(texts: DataFrame, size: int = SIZE, fold: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spans (t1, t2, start, end) of repeated bytes, not yet merged; and the different texts with rep and copies.

    A text of size bytes or more that occurs in copies is repeated as a whole and needs no spans."""
    classes = materialise(texts.groupBy("t1", "t2").agg(F.min("row.doc_id").alias("rep"), F.count("*").alias("copies")), "texts")
    with scratch(texts.sparkSession) as block:
        found = materialise(_find_anchors(texts, size, fold), "anchors")
        same = ["akey", "ext", "ext2"]
        extents = materialise(found.groupBy(*same).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("t1", "t2", "a", "lo", "hi")]), "extents")
        whole = found.select(*same, "t1", "t2", "lo", "hi").join(extents.where("n > 1").select(*same), same).select("t1", "t2", F.col("lo").alias("start"), (F.col("hi") + size).alias("end")).distinct()
        contested = extents.groupBy("akey").agg(F.count("*").alias("m"), F.min("n").alias("fewest")).where("m > 1 AND fewest = 1").select("akey")
        places = materialise(extents.join(contested, "akey").join(classes.select("t1", "t2", "rep"), ["t1", "t2"]), "places")
        bloom = Bloom(places.select("t1").distinct(), "t1")
        pieces = materialise(_cut_pieces(texts, places, bloom, size, fold), "pieces")
        spans = block.keep(whole.union(_settled(pieces, BLOCK, size)), "spans")
        bloom.drop()
    return spans, classes


def _word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[PrefixHash, PrefixHash, np.ndarray]:
    """The two prefix hashes over the words of texts back to back, A-Z as a-z, and the first word of each text."""
    starts, ends, first = word_spans(buf, offs)
    low = LOWER[buf]
    return *(PrefixHash(mix64(PrefixHash(low, k).of(starts, ends)), k) for k in (0, 1)), first


def _find_word_anchors(texts: DataFrame, words: int) -> DataFrame:
    """Anchors as those of bytes, over words; places count words."""
    names = ["t1", "t2", "akey", "ext", "ext2", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = np.array(batch.column(1)), np.array(batch.column(2))
            for low, _, buf, offs in text_chunks(batch.column(0)):
                text, akey, ext, ext2, _, lo, hi = _anchors_of(*_word_hashes(buf, offs), words)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[text + low], t2[text + low], akey, ext, ext2, lo, hi)], names)

    return map_batches(texts.where(F.length("data") >= 2 * words - 1).select("data", "t1", "t2"), run, ", ".join(f"{n} long" for n in names))


def _hash_windows(texts: DataFrame, places: DataFrame, bloom: Bloom, words: int) -> DataFrame:
    """Two hashes of every run of `words` words at the given places, with the text, the first word and the place's `cross`."""
    lists = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi", "cross")).alias("places"))
    source = texts.where(bloom.may_have("t1")).select("t1", "t2", F.col("row.doc_id").alias("doc_id"), "data")
    joined = source.join(lists.join(places.select("t1", "t2", "rep").distinct(), ["t1", "t2"]).withColumnsRenamed({"t1": "u1", "t2": "u2"}), (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    names = ["w1", "w2", "t1", "t2", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, lists = np.array(batch.column(1)), np.array(batch.column(2)), batch.column(3)
            bound, flat = np.array(lists.offsets), lists.values
            lo, hi = (np.array(flat.field(k)) for k in (0, 1))
            cross = flat.field(2).to_numpy(zero_copy_only=False)
            for low, high, buf, offs in text_chunks(batch.column(0)):
                one, two, first = _word_hashes(buf, offs)
                mine = np.arange(bound[low], bound[high])
                text = np.repeat(np.arange(high - low), np.diff(bound[low : high + 1]))
                count = hi[mine] - lo[mine] + 1
                owner = np.repeat(np.arange(len(mine)), count)
                start = lo[mine][owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = first[text[owner]] + start
                columns = [mix64(x.of(at, at + words)).view(np.int64) for x in (one, two)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, t1[low + text[owner]], t2[low + text[owner]], start, cross[mine][owner])], [*names, "cross"])

    return map_batches(joined.select("data", "t1", "t2", "places"), run, ", ".join(f"{n} long" for n in names) + ", cross boolean")


def shared_passages(texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """t1, t2, n_passages, passage_words: the runs of words that other, different texts have as well.

    A run is made of strings of `words` words (A-Z as a-z, white space apart) that also stand in a text
    of other bytes; texts without one have no row. Strings meet by their anchors as those of bytes do:
    extents of two texts are shared as a whole, others under one anchor string by string (128-bit hashes)."""
    with scratch(texts.sparkSession) as block:
        found = materialise(_find_word_anchors(texts, words), "word_anchors")
        several = F.min("t1") != F.max("t1")
        keys = found.groupBy("akey").agg(several.alias("met")).where("met").select("akey")
        met = materialise(found.join(keys, "akey").distinct(), "met")
        same, place = ["akey", "ext", "ext2"], ["t1", "t2", "lo", "hi"]
        extents = materialise(met.groupBy(*same).agg(several.alias("cross"), *[F.first(c).alias(c) for c in place]), "word_extents")
        ends = [F.col("lo").alias("start"), (F.col("hi") + words).alias("end")]
        whole = met.join(extents.where("cross").select(*same), same).select("t1", "t2", *ends)
        contested = extents.groupBy("akey").agg(F.count("*").alias("m"), F.bool_and("cross").alias("done")).where("m > 1 AND NOT done").select("akey")
        known = extents.where("cross").join(contested, "akey").select(*place, "cross")
        rest = met.join(extents.where("NOT cross").select(*same, "cross"), same).join(contested, "akey").select(*place, "cross")
        places = materialise(known.union(rest).join(classes.select("t1", "t2", "rep"), ["t1", "t2"]), "word_places")
        bloom = Bloom(places.select("t1").distinct(), "t1")
        windows = materialise(_hash_windows(texts, places, bloom, words), "windows")
        again = windows.groupBy("w1", "w2").agg((F.bool_or("cross") | several).alias("met")).where("met").select("w1", "w2")
        strings = windows.where("NOT cross").join(again, ["w1", "w2"]).select("t1", "t2", "start", (F.col("start") + words).alias("end"))
        before = Window.partitionBy("t1", "t2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        runs = whole.union(strings).withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(-1)))
        covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))
        out = block.keep(runs.groupBy("t1", "t2").agg(F.count_if(F.col("start") > F.col("seen")).alias("n_passages"), F.sum(covered).alias("passage_words")), "passages")
        bloom.drop()
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _drawn_in(data: bytes, spans: list[tuple[int, int]], inside: Callable[[int], bool]) -> list[tuple[int, int]]:
    """Spans drawn in until neither end lies inside a unit; inside(i): whether bytes i - 1 and i belong together."""
    out = []
    for a, b in spans:
        while a < b and inside(a):
            a += 1
        while a < b and inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the borders of UTF-8 characters."""
    return _drawn_in(data, spans, lambda i: i < len(data) and data[i] & 0xC0 == 0x80)


_BLANK = b" \t\n\x0b\x0c\r"


def _whole_words(data: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Spans from the start of their first whole word to the end of their last, those with at least `words` of them."""
    cut = _drawn_in(data, spans, lambda i: 0 < i < len(data) and data[i - 1] not in _BLANK and data[i] not in _BLANK)
    cut = [(b - len(data[a:b].lstrip(_BLANK)), a + len(data[a:b].rstrip(_BLANK))) for a, b in cut]
    return [(a, b) for a, b in cut if len(data[a:b].split()) >= words]


def strip_repeats(docs: DataFrame, size: int = SIZE, characters: bool = False, fold: bool = False, words: int = 0, passages: int = 0) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept (bytes): what is left of each text without its repeated strings.

    A byte goes if a string of size bytes that covers it also starts anywhere else, in the same text
    or another; strings are judged on the input. Null texts are empty; repeated rows are copies of
    each other, so from size bytes on nothing of them is left. With characters, spans stop at whole
    UTF-8 characters, so that what is left can be text again. With fold, A-Z equal a-z and all white
    space is alike. With words, spans stop at whole words and those of fewer than `words` stay.
    """
    with scratch(docs.sparkSession) as block:
        texts = keyed(docs)
        spans, classes = repeated_spans(texts, size, fold)
        copies = classes.where("copies > 1")
        lists = (
            spans.union(copies.select("t1", "t2", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")))
            .distinct()
            .groupBy(F.col("t1").alias("u1"), F.col("t2").alias("u2"))
            .agg(F.when(F.min("start") < 0, F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")))).otherwise(F.collect_list(F.struct("start", "end"))).alias("spans"))
        )
        if passages:
            shared = shared_passages(texts, classes, passages).withColumnsRenamed({"t1": "u1", "t2": "u2"})
            lists = lists.join(shared, ["u1", "u2"], "full")
        lists = block.keep(lists, "lists")
    extra = ["n_passages", "passage_words"] if passages else []
    bloom = Bloom(lists.select("u1"), "u1")
    marked = texts.withColumn("hit", bloom.may_have("t1"))
    touched = marked.where("hit").join(lists, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left").select("row", "data", "spans", *extra)
    row = texts.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, count, kept = [], [], [], []
            shared = [[v or 0 for v in batch.column(k).to_pylist()] for k in range(3, 3 + len(extra))]
            for i, (value, found) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                data, found = value.as_py(), found.as_py() or []
                merged = merge_spans([(s["start"], s["end"]) for s in found])
                if merged and merged[0][0] < 0:  # a text in copies
                    merged = [(0, len(data))] if len(data) >= size else []
                    if passages and (n := len(data.split())) >= passages:
                        shared[0][i], shared[1][i] = 1, n
                if words:
                    merged = _whole_words(data, merged, words)
                if characters:
                    merged = _whole_characters(data, merged)
                at, parts = 0, []
                for a, b in merged:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in merged))
                count.append(len(merged))
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in shared)], ["row", "n_bytes", "n_removed", "n_spans", "kept", *extra])

    cut = map_batches(touched, run, ", ".join([f"row {row}, n_bytes long, n_removed long, n_spans long, kept binary", *(f"{c} long" for c in extra)]))
    zero = F.lit(0).cast("long")
    rest = marked.where("NOT hit").select("row", F.length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("data").alias("kept"), *(zero.alias(c) for c in extra))
    return cut.unionByName(rest)
