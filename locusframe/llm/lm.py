"""Language-model scoring with a class-factored log-bilinear model trained by noise-contrastive estimation.

Token counts over the whole training part give the unigram base. The most frequent tokens, some
OWN * sqrt(distinct tokens) of them, have vectors of their own: the first are classes by themselves,
the others share classes by frequency. All further tokens fall in classes by their last bytes. The
model predicts the class of the next token from the vectors of the tokens before it, then the token
within its class; a token without a vector has its smoothed count share there. Energies are bilinear
in the predicted vector and a target vector. Training documents are dealt by hash to shards of some
SHARD_TOKENS tokens; every shard trains on all its tokens, with noise classes shared by a mini-batch and noise
words drawn from the class of each token, and the shards' weights are averaged by tokens. Neither
shards nor their order depend on how the table is partitioned. Scoring normalises exactly: matrix
products give the energies of all classes, and of all words of a class, for a block of tokens.
"""

from __future__ import annotations

import io
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import LOWER, PrefixHash, map_batches, materialise, mix64, scratch, text_chunks, word_spans
from locusframe.shipping import ship

END = b"\n"  # no word can hold it
#: Tokens with vectors of their own, for each root of the distinct tokens.
OWN = 6
SINGLE = 64
GROUPS = 64
DIM = 16
CONTEXT = 2
HEAD = 1 << 18
SHARD_TOKENS = 2_000_000
MAX_SHARDS = 4096
_LN10 = math.log(10)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def slices(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """The text in slices of some `limit` bytes that end between words."""
    at = 0
    while len(text) - at > limit and (blank := _BLANK.search(text, at + limit)):
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:]


def group_of(token: bytes) -> int:
    """Group of a token without a vector of its own: by its last two bytes and whether it is long."""
    return (token[-1] * 31 + (token[-2] if len(token) > 1 else 0) * 7 + (len(token) > 6)) % GROUPS


def _group(token: Column) -> Column:
    """group_of in SQL."""
    byte = lambda at: F.coalesce(F.conv(F.hex(F.substring(token, at, 1)), 16, 10).cast("int"), F.lit(0))
    size = F.length(token)
    before = F.when(size > 1, byte(size - 1)).otherwise(0)
    return F.pmod(byte(size) * 31 + before * 7 + F.when(size > 6, 1).otherwise(0), F.lit(GROUPS)).cast("int")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices, never 0."""
    return mix64(PrefixHash(buf).of(starts, ends) + (ends - starts).astype(np.uint64)) | np.uint64(1)


@dataclass
class Vocabulary:
    """The head of the counts (a bounded number of tokens, most frequent first) and what the groups hold in all.

    The first `own` head tokens have vectors. Classes: SINGLE tokens alone, then bins of `width` tokens, then the groups."""

    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    own: int
    group_mass: np.ndarray
    class_share: np.ndarray

    @property
    def width(self) -> int:
        return max(1, math.ceil(math.sqrt(max(0, self.own - SINGLE))))

    @property
    def bins(self) -> int:
        return -(-max(0, self.own - SINGLE) // self.width)

    @property
    def classes(self) -> int:
        return SINGLE + self.bins + GROUPS

    def dump(self) -> bytes:
        out = io.BytesIO()
        data = b"".join(self.words)
        np.savez(
            out, total=self.total, distinct=self.distinct, data=np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), lengths=np.array([len(w) for w in self.words], np.int64),
            counts=self.counts, own=self.own, mass=self.group_mass, share=self.class_share,
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Vocabulary:
        z = np.load(io.BytesIO(data))
        ends = np.cumsum(z["lengths"]).tolist()
        raw = z["data"].tobytes()
        words = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        return cls(int(z["total"]), int(z["distinct"]), words, z["counts"], int(z["own"]), z["mass"], z["share"])


class Lookup:
    """Open addressing from word hashes to places in the head; all words of a block are looked up at once."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        sizes = np.array([len(w) for w in vocab.words], np.int64)
        ends = np.cumsum(sizes)
        hashes = word_hashes(np.frombuffer(b"".join(vocab.words), np.uint8), ends - sizes, ends) if len(sizes) else np.zeros(0, np.uint64)
        self.end = int(np.flatnonzero(sizes == 1)[[w == END for w in vocab.words if len(w) == 1]][0]) if END in vocab.words else -1
        self.mask = (1 << max(4, (4 * len(hashes)).bit_length())) - 1
        self.keys, self.place = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        left, step = np.arange(len(hashes)), 0
        while len(left):
            slot = ((hashes[left] >> np.uint64(20)).astype(np.int64) + step) & self.mask
            free = self.keys[slot] == 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot[free], return_index=True)[1]] = True
            put = np.flatnonzero(free)[first[: free.sum()]]
            self.keys[slot[put]], self.place[slot[put]] = hashes[left[put]], left[put]
            done = np.zeros(len(left), bool)
            done[put] = True
            left, step = left[~done], step + 1
        self.reach = step

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the head of each word, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for step in range(self.reach):
            slot = ((hashes[open_] >> np.uint64(20)).astype(np.int64) + step) & self.mask
            key = self.keys[slot]
            hit = key == hashes[open_]
            out[open_[hit]] = self.place[slot[hit]]
            open_ = open_[~hit & (key != 0)]
            if not len(open_):
                break
        return out


@dataclass
class Tokens:
    """Tokens of texts back to back: places in the head, groups, and where their bytes stand (an end token has none)."""

    place: np.ndarray
    group: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first token of each text, n + 1 values


def read_tokens(buf: np.ndarray, offs: np.ndarray, look: Lookup) -> Tokens:
    """Words of lower-cased texts, each text followed by the end token."""
    starts, ends, first = word_spans(buf, offs)
    n, texts = len(starts), len(offs) - 1
    first = first + np.arange(texts + 1)
    at = np.arange(n) + np.repeat(np.arange(texts), np.diff(first) - 1)
    size = ends - starts
    last = buf[ends - 1].astype(np.int64) if n else size
    before = np.where(size > 1, buf[np.maximum(ends - 2, 0)].astype(np.int64), 0) if n else size
    found = {"place": look.places(word_hashes(buf, starts, ends)) if n else size, "group": (last * 31 + before * 7 + (size > 6)) % GROUPS, "starts": starts, "ends": ends}
    rest = {"place": look.end, "group": group_of(END), "starts": 0, "ends": 0}
    out = {k: np.full(n + texts, rest[k], np.int64) for k in found}
    for k, v in found.items():
        out[k][at] = v
    return Tokens(**out, first=first)


def count_tokens(docs: DataFrame, keep: int = 200_000) -> DataFrame:
    """token, group, n over all documents; null texts have the end token only.

    A partition hands on its counts whenever it holds `keep` different tokens; sums are made by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                for piece in slices(text.as_py() or b""):
                    seen.update(piece.lower().split())
                    if len(seen) >= keep:
                        yield out()
                seen[END] += 1
        if seen:
            yield out()

    counts = map_batches(docs.select(F.col("text").cast("binary").alias("text")), run, "token binary, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n")).select("token", _group(F.col("token")).alias("group"), "n")


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary and the least count of its head: the smallest for which at most `head` tokens qualify."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    steps = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect()  # at most some hundreds
    floor, taken = (1 << 62), 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        taken += r["m"]
        if taken > head:
            break
        floor = r["least"]
    rows = counts.where(F.col("n") >= floor).select("token", "n").toArrow()
    table = sorted(zip(rows.column("token").to_pylist(), rows.column("n").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    own = min(len(table), max(2 * SINGLE, OWN * math.ceil(math.sqrt(sums["distinct"]))))
    vocab = Vocabulary(int(sums["total"]), int(sums["distinct"]), [t for t, _ in table], np.array([n for _, n in table], np.int64), own, np.ones(GROUPS), np.zeros(0))
    first = vocab.classes - GROUPS
    share = np.zeros(vocab.classes)
    for r in counts.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():
        vocab.group_mass[r["group"]] += r["n"] + r["m"]
        share[first + r["group"]] += r["n"]
    classes = class_of(vocab, np.arange(own), np.zeros(own, np.int64))
    for i, (t, n) in enumerate(table[:own]):
        g = group_of(t)
        vocab.group_mass[g] -= n + 1
        share[first + g] -= n
        share[classes[i]] += n
    vocab.class_share = (share + 1) / (share + 1).sum()
    return vocab, floor


def class_of(vocab: Vocabulary, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class of each token by its place in the head, or by its group where it has no vector."""
    binned = SINGLE + (place - SINGLE) // vocab.width
    own = np.where(place < SINGLE, place, binned)
    return np.where((place >= 0) & (place < vocab.own), own, SINGLE + vocab.bins + group)


def unit_of(vocab: Vocabulary, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Row of the context vectors: a token's own or that of its group."""
    return np.where((place >= 0) & (place < vocab.own), place, vocab.own + group)


@dataclass
class Model:
    context: np.ndarray  # vectors of own tokens, of groups, and of the start
    mixers: np.ndarray  # CONTEXT matrices
    target: np.ndarray  # class vectors
    bias: np.ndarray
    word: np.ndarray  # vectors of own tokens within their class
    word_bias: np.ndarray

    @classmethod
    def fresh(cls, vocab: Vocabulary, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        mixers = np.stack([np.eye(DIM) * 0.5 for _ in range(CONTEXT)])
        share = np.log(vocab.counts[: vocab.own] + 1.0)
        parts = (rng.normal(0, 0.1, (vocab.own + GROUPS + 1, DIM)), mixers, rng.normal(0, 0.1, (vocab.classes, DIM)), np.log(vocab.class_share), rng.normal(0, 0.1, (vocab.own, DIM)), share - share.max() if len(share) else share)
        return cls(*(p.astype(np.float32) for p in parts))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.mixers, self.target, self.bias, self.word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def unflat(self, values: np.ndarray) -> Model:
        """A model of the same shape with these weights."""
        out, at = [], 0
        for p in self.parts():
            out.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*out)

    def predict(self, before: np.ndarray) -> np.ndarray:
        r = self.context[before[:, 0]] @ self.mixers[0]
        for i in range(1, CONTEXT):
            r += self.context[before[:, i]] @ self.mixers[i]
        return r

    def log_probs(self, vocab: Vocabulary, before: np.ndarray, classes: np.ndarray, place: np.ndarray, block: int = 2048) -> np.ndarray:
        """Normalised natural log-probabilities: of the class that follows, and of an own token within it."""
        out, seen = np.empty(len(classes)), self.predict(before)
        turned = np.ascontiguousarray(self.target.T)

        def picked(energy: np.ndarray, mine: np.ndarray) -> np.ndarray:
            if energy.max() > 80 or energy.min() < -80:  # beyond what float32 can add up
                energy -= energy.max(1, keepdims=True)
            value = energy[np.arange(len(energy)), mine].astype(np.float64)
            np.exp(energy, out=energy)
            return value - np.log((energy @ np.ones(energy.shape[1], np.float32)).astype(np.float64))

        for lo in range(0, len(classes), block):
            energy = seen[lo : lo + block] @ turned
            energy += self.bias
            out[lo : lo + block] = picked(energy, classes[lo : lo + block])
        binned = np.flatnonzero((classes >= SINGLE) & (classes < SINGLE + vocab.bins))
        binned = binned[np.argsort(classes[binned], kind="stable")]
        cuts = np.flatnonzero(np.diff(classes[binned])) + 1 if len(binned) else []
        for some in np.split(binned, cuts):
            if len(some):
                low = SINGLE + (int(classes[some[0]]) - SINGLE) * vocab.width
                high = min(low + vocab.width, vocab.own)
                for at in range(0, len(some), block):
                    mine = some[at : at + block]
                    out[mine] += picked(seen[mine] @ self.word[low:high].T + self.word_bias[low:high], place[mine] - low)
        return out


def contexts(units: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """(tokens, CONTEXT) units before each token, nearest first; the start before a text begins."""
    n = len(units)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = np.full((n, CONTEXT), start, np.int64)
    for i in range(CONTEXT):
        ok = np.flatnonzero(place > i)
        out[ok, i] = units[ok - i - 1]
    return out


class Trainer:
    """AdaGrad on the noise-contrastive loss; one set of noise classes serves a mini-batch, noise words are drawn by token."""

    def __init__(self, model: Model, vocab: Vocabulary, noise: int = 48, word_noise: int = 3, rate: float = 0.07, seed: int = 3) -> None:
        self.model, self.vocab, self.rate, self.noise, self.word_noise = model, vocab, np.float32(rate), noise, word_noise
        self.rng = np.random.default_rng(seed)
        self.share = vocab.class_share / vocab.class_share.sum()
        self.log_noise = np.log(noise * self.share).astype(np.float32)
        smooth = vocab.counts[: vocab.own] + 1.0
        self.sums = np.concatenate(([0.0], np.cumsum(smooth)))
        low = SINGLE + (np.arange(vocab.own) - SINGLE) // vocab.width * vocab.width
        self.low, self.high = np.clip(low, 0, vocab.own), np.clip(low + vocab.width, 0, vocab.own)
        self.log_word = np.log(word_noise * smooth / np.maximum(self.sums[self.high] - self.sums[self.low], 1e-9)).astype(np.float32)
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in model.parts()]
        self.number = np.zeros(max(map(len, model.parts())), np.int64)

    def _move(self, part: int, g: np.ndarray, rows: np.ndarray | slice, n: int) -> None:
        g = np.asarray(g, np.float32) * np.float32(32 / n)
        self.squares[part][rows] += g * g
        self.model.parts()[part][rows] += self.rate * g / np.sqrt(self.squares[part][rows])

    def _sum(self, rows: np.ndarray, values: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """Different rows and the sums of their values, and of more values of one number each."""
        place = np.arange(len(rows))
        self.number[rows] = place  # the last of equal rows stays and stands for all
        different = rows[self.number[rows] == place]
        self.number[different] = place[: len(different)]
        at = self.number[rows]
        order = np.argsort(at.astype(np.uint16) if len(different) < 1 << 16 else at, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(different)))[:-1]))
        return different, np.add.reduceat(values[order], cuts, axis=0), *(np.add.reduceat(m[order], cuts) for m in more)

    def step(self, before: np.ndarray, classes: np.ndarray, place: np.ndarray) -> None:
        m, n = self.model, len(classes)
        picks = self.rng.choice(len(self.share), self.noise, p=self.share)
        r = m.predict(before)
        up, down = self._errors(np.einsum("ij,ij->i", r, m.target[classes]) + m.bias[classes] - self.log_noise[classes], r @ m.target[picks].T + (m.bias[picks] - self.log_noise[picks]))
        grad_r = up[:, None] * m.target[classes] + down @ m.target[picks]
        rows, g, b = self._sum(np.concatenate([classes, picks]), np.concatenate([up[:, None] * r, down.T @ r]), np.concatenate([up, down.sum(0)]))
        moves = [(2, g, rows), (3, b, rows)]
        binned = np.flatnonzero((classes >= SINGLE) & (classes < SINGLE + self.vocab.bins))
        if len(binned):
            mine, seen = place[binned], r[binned]
            low, high = self.sums[self.low[mine]], self.sums[self.high[mine]]
            drawn = np.searchsorted(self.sums, low[:, None] + self.rng.random((len(mine), self.word_noise)) * (high - low)[:, None], "right") - 1
            drawn = np.clip(drawn, self.low[mine][:, None], self.high[mine][:, None] - 1)
            vectors = m.word[drawn]
            up, down = self._errors(np.einsum("ij,ij->i", seen, m.word[mine]) + m.word_bias[mine] - self.log_word[mine], np.einsum("ij,ikj->ik", seen, vectors) + m.word_bias[drawn] - self.log_word[drawn])
            grad_r[binned] += up[:, None] * m.word[mine] + np.einsum("ik,ikj->ij", down, vectors)
            values = np.concatenate([up[:, None] * seen, (down[:, :, None] * seen[:, None]).reshape(-1, DIM)])
            rows, g, b = self._sum(np.concatenate([mine, drawn.ravel()]), values, np.concatenate([up, down.ravel()]))
            moves += [(4, g, rows), (5, b, rows)]
        mixers = np.stack([m.context[before[:, i]].T @ grad_r for i in range(CONTEXT)])
        rows, g = self._sum(before.T.ravel(), np.concatenate([grad_r @ m.mixers[i].T for i in range(CONTEXT)]))
        for part, g_, at in [*moves, (0, g, rows), (1, mixers, slice(None))]:
            self._move(part, g_, at, n)

    @staticmethod
    def _errors(true: np.ndarray, false: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of the loss for data and for noise."""
        return (1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32), (-1 / (1 + np.exp(-np.clip(false, -30, 30)))).astype(np.float32)


def train(docs: DataFrame, vocab: Vocabulary, batch_tokens: int = 4096, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Average, by tokens, of the weights every shard reaches on all its documents.

    A document's shard and its place there follow from the hash of its text and other columns; there
    are total / shard_tokens shards, at most MAX_SHARDS, and beyond that shards grow."""
    start = Model.fresh(vocab)
    if not vocab.total:
        return start
    shards = min(MAX_SHARDS, math.ceil(vocab.total / shard_tokens))
    light = Vocabulary(vocab.total, vocab.distinct, vocab.words[: vocab.own], vocab.counts[: vocab.own], vocab.own, vocab.group_mass, vocab.class_share)
    shared = docs.sparkSession.sparkContext.broadcast(light.dump())
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    flow = docs.select(F.pmod(mark, F.lit(shards)).cast("int").alias("shard"), mark.alias("mark"), F.col("text").cast("binary").alias("text"))
    flow = flow.repartition(shards, "shard").sortWithinPartitions("shard", "mark")
    chunk = 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Vocabulary.load(shared.value)
        look = Lookup(mine)
        fresh = Model.fresh(mine)
        model, trainer, seen, shard = fresh, Trainer(fresh, mine), 0, -1

        def out() -> pa.RecordBatch:
            values = model.flat() * seen
            cut = [values[lo : lo + chunk].tobytes() for lo in range(0, len(values), chunk)]
            columns = [pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), shard, np.int32)), pa.array(cut, pa.binary()), pa.array(np.full(len(cut), seen, np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "shard", "weights", "seen"])

        for batch in batches:
            numbers = np.array(batch.column(0))
            for lo, hi in zip(*(lambda c: (np.concatenate(([0], c)), np.concatenate((c, [len(numbers)]))))(np.flatnonzero(np.diff(numbers)) + 1), strict=True):
                if hi > lo and numbers[lo] != shard:
                    if seen:
                        yield out()
                    model = Model.fresh(mine)
                    trainer, seen, shard = Trainer(model, mine), 0, int(numbers[lo])
                for _, _, raw, offs in text_chunks(batch.column(2).slice(lo, hi - lo)):
                    t = read_tokens(LOWER[raw], offs, look)
                    classes, units = class_of(mine, t.place, t.group), unit_of(mine, t.place, t.group)
                    before = contexts(units, t.first, mine.own + GROUPS)
                    order = trainer.rng.permutation(len(classes))
                    for at in range(0, len(order), batch_tokens):
                        some = order[at : at + batch_tokens]
                        trainer.step(before[some], classes[some], t.place[some])
                    seen += len(classes)
        if seen:
            yield out()

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        total = np.sum([np.frombuffer(w, np.float64) for w in group["weights"].to_pylist()], 0)
        return pa.table({"chunk": group["chunk"].slice(0, 1), "weights": pa.array([(total / sum(group["seen"].to_pylist())).tobytes()], pa.binary())})

    ship(docs.sparkSession)
    rows = map_batches(flow, run, "chunk int, shard int, weights binary, seen long").groupBy("chunk").applyInArrow(mean, "chunk int, weights binary").toArrow().sort_by("chunk")
    shared.destroy()
    return start.unflat(np.frombuffer(b"".join(rows.column("weights").to_pylist()), np.float64))


_loaded: dict[str, tuple[Vocabulary, Model, Lookup]] = {}  # of a worker, which serves many tasks


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, least: int, model: Model, carried: dict[str, str]) -> DataFrame:
    """carried, n_tokens, n_known, base_score, score: one row a row of docs.

    Counts of head tokens are at hand in the workers; each other token of a text is looked up by a
    join with the counts, and its logarithms are summed by text."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab.dump(), model.flat()))  # HEAD tokens at most
    names, key = [f"c{i}" for i in range(len(carried))], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            data, weights = shared.value
            mine = Vocabulary.load(data)
            _loaded.clear()
            _loaded[key] = mine, Model.fresh(mine).unflat(weights), Lookup(mine)
        mine, net, look = _loaded[key]
        group_log, head_log = np.log10(mine.group_mass), np.append(np.log10(mine.counts + 1.0), 0)  # the last for places of -1
        for batch in batches:
            for low, high, raw, offs in text_chunks(batch.column(len(names))):
                buf = LOWER[raw]
                t = read_tokens(buf, offs, look)
                classes, units = class_of(mine, t.place, t.group), unit_of(mine, t.place, t.group)
                grouped = units >= mine.own
                logs = head_log[t.place]
                value = net.log_probs(mine, contexts(units, t.first, mine.own + GROUPS), classes, t.place) / _LN10
                value += np.where(grouped, logs - group_log[t.group], 0)
                sums = [np.add.reduceat(x, t.first[:-1]) for x in (value, logs, (t.place >= 0).astype(np.int64))]
                rare, many = [], []
                unknown = np.flatnonzero(t.place < 0)
                cuts = np.searchsorted(unknown, t.first)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    seen = Counter(buf[t.starts[j] : t.ends[j]].tobytes() or END for j in unknown[a:b])
                    rare.append(list(seen))
                    many.append(list(seen.values()))
                columns = [batch.column(k).slice(low, high - low) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(t.first)), *map(pa.array, sums), pa.array(rare, pa.list_(pa.binary())), pa.array(many, pa.list_(pa.int64()))], [*names, "n_tokens", "part_score", "head_logs", "head_known", "rare", "many"])

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, carried.values(), strict=True)) + ", n_tokens long, part_score double, head_logs double, head_known long, rare array<binary>, many array<long>"
    coded = map_batches(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names, strict=True)], F.col("text").cast("binary").alias("text")), run, schema)
    scored = materialise(coded.withColumn("rid", F.monotonically_increasing_id()), "scored")  # written, so ids do not change
    tail = scored.select("rid", F.explode(F.arrays_zip("rare", "many")).alias("x")).select("rid", F.col("x.rare").alias("token"), F.col("x.many").alias("m"))
    looked = tail.join(counts.where(F.col("n") < least).select("token", "n"), "token")
    by_text = looked.groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("tail_logs"), F.sum("m").alias("tail_known"))
    zero = F.lit(0.0)
    return scored.join(by_text, "rid", "left").select(
        *[F.col(n).alias(c) for c, n in zip(carried, names, strict=True)],
        F.col("n_tokens"),
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("head_logs") + F.coalesce("tail_logs", zero) - F.col("n_tokens") * math.log10(vocab.total + vocab.distinct + 1)).alias("base_score"),
        (F.col("part_score") + F.coalesce("tail_logs", zero)).alias("score"),
    )


def learn_and_score(docs: DataFrame, held: str, carried: dict[str, str]) -> DataFrame:
    """Learn from the rows where the boolean column `held` is false, score all rows; adds train_tokens.

    Null and empty texts are the end token alone. Repeated rows are learnt and scored as often as they
    occur. With nothing to learn from, every token is unknown and scores 1 / 1 in the base. Ties in the
    order of the vocabulary go by the token's bytes. The result is a table in the shared folder."""
    with scratch(docs.sparkSession) as block:
        learnt = docs.where(~F.col(held))
        counts = materialise(count_tokens(learnt), "counts")
        vocab, least = vocabulary(counts)
        model = train(learnt, vocab)
        return block.keep(score(docs, counts, vocab, least, model, carried).withColumn("train_tokens", F.lit(vocab.total).cast("long")), "scores")
