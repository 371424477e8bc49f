"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A token's vector is the sum of the embeddings of its word and of its first bytes, by hash. Filters of
several widths slide over a whole text, each keeps its maximum, and a logistic layer reads the maxima.
Thresholds for decisions are calibrated by language; scores never see language, source, id or label.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import LOWER, PrefixHash, held, map_batches, mix64, text_chunks, word_spans

SIZE = 1 << 16
WIDTHS = (1, 2, 3)
PREFIXES = (4, 7)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, 1 + prefixes) embedding rows of texts back to back, and each text's first token (n + 1 values)."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offs)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), first
    letter = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    last = np.maximum.accumulate(np.where(letter, np.arange(1, len(low) + 1), 0))  # punctuation at a word's end goes
    trimmed = last[ends - 1]
    ends = np.where(trimmed > starts, trimmed, ends)
    hashes = PrefixHash(low)
    columns = [hashes.of(starts, ends)]
    columns += [hashes.of(starts, np.minimum(ends, starts + n)) + np.uint64(n) for n in PREFIXES]
    return np.stack([(mix64(c) & np.uint64(SIZE - 1)).astype(np.int32) for c in columns], 1), first


@dataclass
class Network:
    dim: int = 12
    filters: int = 24
    seed: int = 7
    table: np.ndarray = field(default=None)  # type: ignore[assignment]
    kernels: list[np.ndarray] = field(default=None)  # type: ignore[assignment]
    shift: np.ndarray = field(default=None)  # type: ignore[assignment]
    out: np.ndarray = field(default=None)  # type: ignore[assignment]
    bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.table is None:
            rng = np.random.default_rng(self.seed)
            self.table = rng.normal(0, 0.02, (SIZE, self.dim)).astype(np.float32)
            self.kernels = [rng.normal(0, (2 / (w * self.dim)) ** 0.5, (w, self.dim, self.filters)).astype(np.float32) for w in WIDTHS]
            self.shift = np.zeros(len(WIDTHS) * self.filters, np.float32)
            self.out = rng.normal(0, 0.1, len(WIDTHS) * self.filters).astype(np.float32)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.table[ids[:, k]]
        return x

    def maps(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs before pooling, for one text padded with zero vectors at its end."""
        n, flat = len(x), []
        for w, kernel in zip(WIDTHS, self.kernels, strict=True):
            y = x @ kernel[0]
            for j in range(1, w):
                y[: max(n - j, 0)] += x[j:] @ kernel[j]
            flat.append(y)
        return np.concatenate(flat, 1)

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities for many texts at once, 0 for a text without words; between texts stand zero vectors, so no window sees two."""
        n, gap = len(first) - 1, max(WIDTHS) - 1
        size = np.diff(first)
        pooled = np.zeros((n, len(self.out)), np.float32)
        if len(ids):
            x = np.zeros((len(ids) + gap * n, self.dim), np.float32)
            x[np.arange(len(ids)) + gap * np.repeat(np.arange(n), size)] = self.vectors(ids)
            full = np.flatnonzero(size)
            begin = (first[:-1] + gap * np.arange(n))[full]
            cuts = np.stack([begin, begin + size[full]], 1).ravel()
            tail = cuts[-1] == len(x)
            tops = np.maximum.reduceat(self.maps(x), cuts[:-1] if tail else cuts, axis=0)[::2]
            pooled[full] = np.maximum(tops + self.shift, 0)
        found = 1 / (1 + np.exp(-(pooled @ self.out.astype(np.float64) + self.bias)))
        return np.where(size > 0, found, 0.0)

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 10, rate: float = 0.15, min_texts: int = 3, damping: float = 0.1, dropout: float = 0.6) -> None:
        """AdaGrad on the log loss in mini-batches of 16 texts; gradients flow through the pooled maxima only.

        Embedding rows that occur in fewer than min_texts of the texts are zero and stay so, as do those
        that never occur: one or two texts say nothing about a word. damping keeps the first steps of a
        row in proportion to its gradient, so that a word counts by the texts it occurs in; dropout hides a share of the
        tokens in every round, so that no text is explained by one word alone."""
        rng, gap = np.random.default_rng(self.seed + 1), max(WIDTHS) - 1
        seen_in = np.zeros(SIZE, np.int64)
        for ids in texts:
            seen_in[np.unique(ids)] += 1
        known = seen_in >= min_texts
        self.table[~known] = 0
        sums = [np.full_like(k, 1e-6) for k in (*self.kernels, self.shift, self.out)]
        rows, bias_sum = np.full((SIZE, 1), damping, np.float32), 1e-6
        order_of = np.flatnonzero([len(t) > 0 for t in texts])
        for _ in range(epochs):
            order = rng.permutation(order_of)
            for lo in range(0, len(order), 16):
                mine = order[lo : lo + 16]
                size = np.array([len(texts[i]) for i in mine])
                begin = np.cumsum(size + gap) - size - gap
                place = np.arange(size.sum()) + gap * np.repeat(np.arange(len(mine)), size)
                total = int(size.sum() + gap * len(mine))
                ids, real = np.zeros((total, 1 + len(PREFIXES)), np.int32), np.zeros(total, bool)
                ids[place], real[place] = np.concatenate([texts[i] for i in mine]), True
                real &= rng.random(total) >= dropout
                x = self.vectors(ids) * real[:, None]
                y = self.maps(x)
                at = np.stack([y[b : b + n].argmax(0) + b for b, n in zip(begin, size, strict=True)])
                top = y[at, np.arange(y.shape[1])] + self.shift
                seen = np.maximum(top, 0)
                error = 1 / (1 + np.exp(-(seen @ self.out) - self.bias)) - labels[mine]
                back = np.where(top > 0, error[:, None] * self.out, 0).astype(np.float32)
                grads = [np.zeros_like(s) for s in sums]
                grads[-1], grads[-2] = (error @ seen).astype(np.float32), back.sum(0)
                touched, moves = [], []
                for k, (w, kernel) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
                    part = slice(k * self.filters, (k + 1) * self.filters)
                    for j in range(w):
                        p, b = at[:, part] + j, back[:, part]
                        grads[k][j] = np.einsum("tfd,tf->df", x[p], b)
                        ok = real[p] & (b != 0)
                        touched.append(ids[p[ok]])
                        moves.append((kernel[j].T[None] * b[:, :, None])[ok])
                for value, g, s in zip((*self.kernels, self.shift, self.out), grads, sums, strict=True):
                    s += g * g
                    value -= (rate * g / np.sqrt(s)).astype(np.float32)
                bias_grad = float(error.sum())
                bias_sum += bias_grad**2
                self.bias -= rate * bias_grad / bias_sum**0.5
                where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                if len(where):
                    move, g = np.concatenate(moves), np.zeros((len(where), self.dim), np.float32)
                    for c in range(1 + len(PREFIXES)):
                        np.add.at(g, inverse.reshape(-1, 1 + len(PREFIXES))[:, c], move)
                    g[~known[where]] = 0
                    rows[where] += (g * g).mean(1, keepdims=True)
                    self.table[where] -= rate * g / np.sqrt(rows[where])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, table=self.table, shift=self.shift, out=self.out, bias=self.bias, langs=np.array([*self.thresholds], np.str_), limits=np.array([*self.thresholds.values()], np.float64), **{f"k{i}": k for i, k in enumerate(self.kernels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        z = np.load(io.BytesIO(data))
        kernels = [z[f"k{i}"] for i in range(len(WIDTHS))]
        return cls(dim=z["table"].shape[1], filters=kernels[0].shape[2], table=z["table"], kernels=kernels, shift=z["shift"], out=z["out"], bias=float(z["bias"]), thresholds=dict(zip(z["langs"].tolist(), z["limits"].tolist(), strict=True)))


def _best_threshold(scores: np.ndarray, labels: np.ndarray, clean_weight: float = 4.0) -> float:
    """Where the shares of caught label 1 and, with more weight, of passed label 0 are best; in the middle of the widest such gap."""
    order = np.argsort(scores)
    s, y = scores[order], labels[order]
    edges = np.concatenate(([0.0], (s[1:] + s[:-1]) / 2, [1.0]))
    caught = 1 - np.concatenate(([0], np.cumsum(y))) / max(1, y.sum())
    passed = np.concatenate(([0], np.cumsum(1 - y))) / max(1, (1 - y).sum())
    value = np.round(caught + clean_weight * passed, 9)
    best = np.flatnonzero(value == value.max())
    width = np.concatenate(([s[0]], np.diff(s), [1 - s[-1]]))[best]
    return float(np.clip(edges[best[width.argmax()]], 0.02, 0.98))


def _fit_sample(texts: list[np.ndarray], y: np.ndarray, langs: np.ndarray, prior: float, holdout: float, epochs: int, seed: int) -> Network:
    """Fit on the sample less every 1/holdout-th text, then set thresholds by language on those."""
    net = Network(seed=seed)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.bias = float(np.log(prior / (1 - prior)))
        return net
    held = np.arange(len(y)) % max(2, round(1 / holdout)) == 0
    kept = np.flatnonzero(~held)
    net.fit([texts[i] for i in kept], y[kept], epochs=max(epochs, min(60, 24_000 // len(kept))))
    odds = y[kept].mean()
    if 0 < odds < 1:
        net.bias += float(np.log(prior / (1 - prior)) - np.log(odds / (1 - odds)))
    tested = np.flatnonzero(held)
    scores = np.array([net.scores(texts[i], np.array([0, len(texts[i])]))[0] for i in tested])
    for lang in ["", *sorted(set(langs[tested].tolist()) - {""})]:
        mine = np.ones(len(tested), bool) if lang == "" else langs[tested] == lang
        if (n := y[tested][mine].sum()) >= 5 and mine.sum() - n >= 5:
            net.thresholds[lang] = _best_threshold(scores[mine], y[tested][mine])
    return net


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_per_class: int = 3000, max_tokens: int = 4_000_000, holdout: float = 0.2, epochs: int = 10, seed: int = 7) -> Network:
    """Fit on at most max_per_class labelled rows of each class and max_tokens tokens, those with the smallest id hashes.

    The sample is what bounds the fit: executors hash its texts, one task reads the token numbers (12
    bytes each, whole texts, taken in order of id hash while they fit in max_tokens) and only the
    weights reach the driver. labels: doc_id, toxic. usable: which labels may be used. Rows with a
    null label or id are left out, of several labels of one id the largest counts, of several texts
    the one with the smallest hash; with no usable rows of both classes the network stays as it was
    drawn and scores everything by the share of label 1. A fifth of the sample is kept from training;
    on it a threshold is set for each language ("" for all languages together, and for docs without
    a column lang) with at least 5 rows of both classes.
    """
    picked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        picked = picked.where(usable)
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [picked.where(F.col("toxic") == k).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_per_class) for k in (0, 1)]
    share = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    prior = (share.get(1, 0) + 1) / (share.get(0, 0) + share.get(1, 0) + 2)
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * max_per_class rows of three numbers
    rows = docs.select("doc_id", "text", lang.alias("lang")).join(sample, "doc_id").select("h", "doc_id", F.col("toxic").cast("int").alias("toxic"), "lang", F.xxhash64("text").alias("mark"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[bytes] = []
            for lo, hi, buf, offs in text_chunks(batch.column(5)):
                found, first = features(buf, offs)
                ids += [found[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids, pa.binary())], ["h", "doc_id", "toxic", "lang", "mark", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = map_batches(rows, hashed, f"h long, doc_id {kind}, toxic int, lang string, mark long, ids binary")
    single = coded.groupBy("h", "doc_id", "toxic").agg(F.min(F.struct("mark", "lang", "ids")).alias("one")).select("h", "doc_id", "toxic", "one.lang", "one.ids")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, langs, left = [], [], [], max_tokens
        for batch in batches:
            for toxic, code, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = np.frombuffer(ids.as_py(), np.int32).reshape(-1, 1 + len(PREFIXES))
                if len(found) <= left:
                    left -= len(found)
                    texts.append(found)
                    y.append(float(toxic))
                    langs.append(code)
        net = _fit_sample(texts, np.array(y), np.array(langs, object), prior, holdout, epochs, seed)
        yield pa.RecordBatch.from_arrays([pa.array([net.dump()], pa.binary())], ["weights"])

    # the sample is bounded, so one task may read all of it
    ordered = single.repartition(1).sortWithinPartitions("h", "doc_id").select("toxic", "lang", "ids")
    found = map_batches(ordered, fit, "weights binary").first()
    return Network.load(bytes(found["weights"])) if found else _fit_sample([], np.zeros(0), np.zeros(0, object), prior, holdout, epochs, seed)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of docs inside row, and score; null and empty texts, and those without words, score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(net.dump())  # a few MB whatever the input
    key = uuid.uuid4().hex
    source = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held(key, lambda: Network.load(shared.value))
        for batch in batches:
            found = [mine.scores(*features(buf, offs)) for _, _, buf, offs in text_chunks(batch.column(1), 1 << 18)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], ["row", "score"])

    row = source.schema["row"].dataType.simpleString()
    return map_batches(source, run, f"row {row}, score double", key)


def rejected(lang: Column, value: Column, net: Network, default: float = 0.3) -> Column:
    """Whether the score reaches the threshold of its language; the one for all languages where it has none."""
    limit = F.lit(net.thresholds.get("", default))
    for name, threshold in net.thresholds.items():
        if name:
            limit = F.when(lang == name, F.lit(threshold)).otherwise(limit)
    return value >= limit
