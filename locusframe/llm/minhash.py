"""MinHash near-duplicates with sequential Bayesian verification.

Documents with one and the same shingle set form a class. Signatures of classes are banded; in every
bucket all members are first paired with one hub. A pair's signatures are compared in batches, and it
is dropped as soon as the posterior probability that its similarity reaches the threshold falls below
the chosen miss probability. Survivors are verified on their full shingle sets. Then members of a
bucket that are still in different components are compared with each other in the same way, in blocks
of bounded size that return only the links which join components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import LOWER, Bloom, PrefixHash, map_batches, materialise, mix64, scratch, text_chunks, word_spans
from locusframe.llm.graph import components
from locusframe.shipping import ship

WORDS = 5
BANDS, ROWS = 32, 4
BATCH = 16
_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; A-Z count as lower case.

    A text with fewer words has its whole sequence as its one shingle, one without words none."""
    for lo, hi, raw, offs in text_chunks(texts):
        buf = LOWER[raw]
        starts, ends, first = word_spans(buf, offs)
        word = mix64(PrefixHash(buf).of(starts, ends) + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
        n = max(0, len(word) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(words):
            rolled = rolled * _M + word[j : j + n]
        rolled = mix64(rolled)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield np.frombuffer(hashlib.blake2b(word[a:b].tobytes(), digest_size=8).digest(), np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1 << 62, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


_A, _B = _permutations(BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[i : i + 1024, None] * _A + _B).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, miss: float, count: int = BANDS * ROWS, batch: int = BATCH) -> dict[int, int]:
    """For every number of compared hashes the fewest matches that keep a pair.

    With a uniform prior the posterior of the similarity after m of n matches is Beta(m+1, n-m+1); a pair
    stays while its mass at or above the threshold is at least miss."""
    out = {}
    for n in range(batch, count + 1, batch):
        above = 0.0  # P(Bin(n + 1, threshold) <= m) is the mass above the threshold
        for m in range(n + 1):
            above += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if above >= miss:
                out[n] = m
                break
    return out


def matches(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Matching hashes of aligned signatures, -1 for pairs dropped on the way."""
    found, live = np.full(len(left), -1), np.arange(len(left))
    same = np.zeros(len(left), np.int64)
    for n, fewest in least.items():
        same = same + (left[live, n - BATCH : n] == right[live, n - BATCH : n]).sum(1)
        stay = same >= fewest
        live, same = live[stay], same[stay]
    found[live] = same
    return found


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set; null for an empty one) and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, marks = [], [], []
            for found in shingle_sets(batch.column(1)):
                sizes.append(len(found))
                keys.append(set_key(found) if len(found) else None)
                marks.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "key", "marks"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, key binary, marks binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def buckets(classes: DataFrame) -> DataFrame:
    """bucket, band, node: BANDS rows for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = _signatures(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), marks.shape[:2])
            for r in range(ROWS):
                key = mix64(key * _M + marks[:, :, r])
            node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), node], ["bucket", "band", "node"])

    return map_batches(classes.select("node", "marks"), run, "bucket long, band int, node binary")


def surviving(pairs: DataFrame, classes: DataFrame, least: dict[int, int], threshold: float) -> DataFrame:
    """The pairs (a, b) that the sequential comparison of signatures does not drop."""
    side = classes.select("node", "n_shingles", "marks")
    both = (
        pairs.join(side.toDF("a", "na", "ma"), "a")
        .join(side.toDF("b", "nb", "mb"), "b")
        .where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
        .select("a", "b", "ma", "mb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = matches(_signatures(batch.column(2)), _signatures(batch.column(3)), least) >= 0
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return map_batches(both, run, "a binary, b binary")


def full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node and its shingles, made again from the whole text of one document of each class."""
    wanted = nodes.join(classes.select("node", "rep"), "node")
    bloom = Bloom(wanted.select(F.xxhash64("rep").alias("h")), "h")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1)))
            good = [set_key(s) == node for s, node in zip(found, batch.column(0).to_pylist(), strict=True)]  # another text may have the same id
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"]).filter(pa.array(good, pa.bool_()))

    near = docs.select(F.col("doc_id").alias("rep"), "text").withColumn("h", F.xxhash64("rep")).where(bloom.may_have("h"))
    texts = near.join(wanted, "rep").select("node", "text")
    return map_batches(texts, full, "node binary, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return map_batches(both, run, "a binary, b binary")


def bridging_links(size: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], label: np.ndarray, minor: np.ndarray, main: bytes, node: np.ndarray, band: np.ndarray, least: dict[int, int], percent: int) -> list[tuple[int, int]]:
    """Links (row, row) that join different labels of one bucket, each verified on full sets.

    Rows with minor meet the others; a pair counts in the first band it shares only, and pairs whose
    labels a link has joined by then are left out. Sets are numbered first, so that the intersections of one row with
    many are look-ups in one array."""
    everything = np.concatenate(sets)
    _, ids = np.unique(everything, return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    begins = ends - size
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    out = []
    right = np.flatnonzero(~minor)
    bands = marks.reshape(len(marks), BANDS, ROWS)
    for i in np.flatnonzero(minor):
        mine = find(label[i])
        ok = (np.minimum(size[right], size[i]) * 100 >= percent * np.maximum(size[right], size[i])) & (label[right] != label[i])
        ok &= (label[right] == main) | (node[right] > node[i])  # two minor rows meet once
        other = right[ok]
        if root:
            other = other[np.array([find(x) != mine for x in label[other]], bool)] if len(other) else other
        if not len(other):
            continue
        other = other[matches(np.broadcast_to(marks[i], (len(other), marks.shape[1])), marks[other], least) >= 0]
        if band[i]:
            other = other[~(bands[other, : band[i]] == bands[i, : band[i]]).all(2).any(1)]
        if not len(other):
            continue
        seen[ids[begins[i] : ends[i]]] = True
        sizes = size[other]
        stop = np.cumsum(sizes)
        flat = ids[np.arange(stop[-1]) + np.repeat(begins[other] - stop + sizes, sizes)]
        common = np.add.reduceat(seen[flat].astype(np.int64), stop - sizes)
        seen[ids[begins[i] : ends[i]]] = False
        for j in other[100 * common >= percent * (size[i] + sizes - common)]:
            a, b = find(label[i]), find(label[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def cross_links(members: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame, least: dict[int, int], percent: int, block: int = 2048) -> DataFrame:
    """Links (a, b) between components that meet in a bucket.

    In each bucket the members outside its largest component meet all members, in blocks of about
    `block` by `block`, and only links that join components come out; hubs have been compared already."""
    rest = members.where("node != hub").join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    by_label = rest.groupBy("bucket", "label").count()
    mixed = (
        by_label.groupBy("bucket")
        .agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("size"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("bucket", F.col("top.label").alias("main"), F.ceil((F.col("size") - F.col("top.count")) / block).cast("int").alias("minors"), F.ceil(F.col("size") / block).cast("int").alias("alls"))
    )
    rows = rest.join(mixed, "bucket").join(classes.select("node", "n_shingles", "marks"), "node").join(sets, "node")
    place = F.xxhash64("node")
    columns = ["bucket", "i", "j", "minor", "band", "node", "label", "n_shingles", "marks", "shingles", "main"]
    minor = rows.where("label != main").withColumn("i", F.pmod(place, F.col("minors")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("alls") - 1))).withColumn("minor", F.lit(True))
    every = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minors") - 1))).withColumn("j", F.pmod(place, F.col("alls")).cast("int")).withColumn("minor", F.lit(False))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, label = np.array(group["node"].to_pylist(), object), np.array(group["label"].to_pylist(), object)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        found = bridging_links(np.array(group["n_shingles"]), _signatures(group["marks"]), sets, label, np.array(group["minor"]), group["main"][0].as_py(), node, np.array(group["band"]), least, percent)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.binary()), "b": pa.array([node[j] for _, j in found], pa.binary())})

    ship(members.sparkSession)
    return minor.select(*columns).unionByName(every.select(*columns)).groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs.

    Null texts are empty; empty texts link with nothing and are kept. Repeated rows are copies of one
    document: same component, same decision. Rows with a null doc_id link nothing and are kept, with a
    null component. Of texts that differ under one id each is a text of its own. The result is a table
    in the shared folder; all other tables written on the way are deleted.
    """
    threshold = percent / 100
    least = least_matches(threshold, miss)
    with scratch(docs.sparkSession) as block:
        sketches = materialise(sketch(docs), "sketches")
        classes = materialise(
            sketches.where("key IS NOT NULL AND doc_id IS NOT NULL")
            .groupBy(F.col("key").alias("node"))
            .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("marks").alias("marks")),
            "classes",
        )
        hubs = buckets(classes).groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
        members = materialise(buckets(classes).join(hubs, "bucket"), "members")
        pairs = members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        sets = materialise(full_sets(members.select("node").distinct(), docs, classes), "sets")
        links = materialise(verified(surviving(pairs, classes, least, threshold), sets, percent), "links")
        labels = components(links)
        bridges = materialise(cross_links(members, classes, sets, labels, least, percent), "bridges")
        if not bridges.isEmpty():
            labels = components(links.unionByName(bridges))
        joined = labels.join(classes.select("node", "rep"), "node")
        lowest = joined.groupBy("label").agg(F.min("rep").alias("low"))
        grouped = classes.where("copies > 1").select("node", "rep").union(joined.select("node", "rep")).distinct()
        final = grouped.join(joined.join(lowest, "label").select("node", "low"), "node", "left").select(F.col("node").alias("key"), F.coalesce("low", "rep").alias("low"))
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
        out = sketches.select("doc_id", "n_shingles", "key").join(final, "key", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
        return block.keep(out, "near-duplicates")
