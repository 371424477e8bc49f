"""Training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import ann, bpe, chat, graph, lm, media, minhash, mixing, suffix, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, kept string"
random.seed(11)
WORDS = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 7))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, k, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(k):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    base, passage = prose(150, 1), prose(120, 2)
    texts = [None, "", " \t\n", "one two", "One  two", "a", base, base, edited(base, 2, 3), edited(base, 3, 4), edited(base, 9, 5), prose(80, 6) + " " + passage, passage + "\n" + prose(70, 7), passage, "aaaa " * 400, "é" * 900, prose(30, 8) + "é" * 500]
    texts += [prose(40, 20 + i) for i in range(6)] + [edited(passage, i % 7, 50 + i) for i in range(14)] + [prose(4000, 99)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), 0.5, "r", "k") for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, base, None, "s1", None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).cache()


def words(text):
    return (text or "").encode().lower().split()


# ---------------------------------------------------------------- language model


def test_lm_counts_and_base(spark, docs):
    held = docs.select("doc_id", "text", (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == 2).alias("h"))
    out = lm.learn_and_score(held, "h", {"doc_id": "long", "h": "boolean"}).collect()
    data = [(r[0], words(r[1]) + [b"\n"], (r[0] or 0) % 5 == 2) for r in corpus()]
    counts = Counter(w for _, t, h in data if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d is not None, d or 0), len(t), sum(w in counts for w in t), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t, _ in data)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def small_vocabulary(n=200, own=150, seed=0):
    rng = np.random.default_rng(seed)
    tokens = [f"w{i}".encode() for i in range(n - 1)] + [lm.END]
    counts = np.sort(rng.integers(1, 500, n))[::-1].astype(np.int64)
    vocab = lm.Vocabulary(int(counts.sum()), n, tokens, counts, own, np.full(lm.GROUPS, 700.0), np.zeros(0))
    share = rng.random(vocab.classes)
    vocab.class_share = share / share.sum()
    return vocab


def test_lm_tail_join_equals_head(spark, docs):
    rows = docs.select("doc_id", "text")
    counts = lm.count_tokens(rows).persist()
    whole, least = lm.vocabulary(counts)
    small, high = lm.vocabulary(counts, head=70)
    assert len(small.words) <= 70 < len(whole.words) and high > least
    own = min(5, len(small.words))  # the same tokens have vectors in both
    for v in (whole, small):
        v.own, v.group_mass = own, np.full(lm.GROUPS, 900.0)
        v.class_share = np.full(v.classes, 1 / v.classes)
    model = lm.Model.fresh(whole)
    pick = lambda v, k: sorted((round(r["base_score"], 8), r["n_known"], round(r["score"], 6)) for r in lm.score(rows, counts, v, k, model, {"doc_id": "long"}).collect())
    assert pick(whole, least) == pick(small, high)


def test_lm_groups_are_alike_in_sql(spark, docs):
    rows = lm.count_tokens(docs.unionByName(docs.limit(1).withColumn("text", F.lit("ab é 漢字 longer-words x")))).collect()
    assert len(rows) > 50 and all(r["group"] == lm.group_of(bytes(r["token"])) for r in rows)


def test_lm_lookup_finds_all_words():
    vocab = small_vocabulary(3000, 2000)
    data = [" ".join(w.decode() for w in vocab.words[:-1]).encode() + b" nothing w99999", b"", b"w5  w6\tW7"]
    offs = np.cumsum([0, *map(len, data)])
    t = lm.read_tokens(lm.LOWER[np.frombuffer(b"".join(data), np.uint8)], offs, lm.Lookup(vocab))
    assert t.place.tolist() == [*range(2999), -1, -1, 2999, 2999, 5, 6, 7, 2999] and t.first.tolist() == [0, 3002, 3003, 3007]
    assert [int(g) for g in t.group[-4:]] == [lm.group_of(w) for w in (b"w5", b"w6", b"w7", lm.END)]


def test_lm_probabilities_are_normal():
    vocab = small_vocabulary()
    model = lm.Model.fresh(vocab)
    rng = np.random.default_rng(2)
    place = np.concatenate([np.arange(vocab.own), np.full(lm.GROUPS, -1)])
    group = np.concatenate([np.zeros(vocab.own, np.int64), np.arange(lm.GROUPS)])
    classes = lm.class_of(vocab, place, group)
    for row in rng.integers(0, vocab.own + lm.GROUPS + 1, (5, lm.CONTEXT)):
        p = model.log_probs(vocab, np.repeat(row[None], len(place), 0), classes, place, block=37)
        assert np.exp(p).sum() == pytest.approx(1, abs=1e-5)


def test_lm_score_token_by_token(spark, docs, monkeypatch):
    kept, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda d, v: (kept.append((v, train(d, v))), kept[-1][1])[1])
    held = docs.where("doc_id < 20").select("doc_id", "text", (F.col("doc_id") % 5 == 2).alias("h"))
    out = {r["doc_id"]: r["score"] for r in lm.learn_and_score(held, "h", {"doc_id": "long"}).collect()}
    vocab, model = kept[0]
    place = {w: i for i, w in enumerate(vocab.words)}
    context, mixers, target, bias, word, word_bias = (p.astype(np.float64) for p in model.parts())
    for d, text, *_ in corpus():
        if d is None or d >= 20:
            continue
        before, total = [vocab.own + lm.GROUPS] * lm.CONTEXT, 0.0
        for w in [*words(text), lm.END]:
            i = place.get(w, -1)
            mine = 0 <= i < vocab.own
            unit = i if mine else vocab.own + lm.group_of(w)
            first = (i if i < lm.SINGLE else lm.SINGLE + (i - lm.SINGLE) // vocab.width) if mine else lm.SINGLE + vocab.bins + lm.group_of(w)
            r = sum(context[u] @ mixers[k] for k, u in enumerate(before))
            energy = target @ r + bias
            total += energy[first] - np.log(np.exp(energy).sum())
            if mine and i >= lm.SINGLE:
                low = lm.SINGLE + (i - lm.SINGLE) // vocab.width * vocab.width
                inner = word[low : min(low + vocab.width, vocab.own)] @ r + word_bias[low : min(low + vocab.width, vocab.own)]
                total += inner[i - low] - np.log(np.exp(inner).sum())
            if not mine:
                total += math.log(((vocab.counts[i] if i >= 0 else 0) + 1) / vocab.group_mass[lm.group_of(w)])
            before = [unit, *before[:-1]]
        assert out[d] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


def test_lm_weights_do_not_depend_on_partitions(spark, docs):
    rows = docs.select("doc_id", "text")
    vocab, _ = lm.vocabulary(lm.count_tokens(rows))
    a, b = (lm.train(rows.repartition(n), vocab, shard_tokens=1500).flat() for n in (1, 7))
    assert np.array_equal(a, b) and not np.array_equal(a, lm.Model.fresh(vocab).flat())


def test_lm_slices_keep_words():
    text = (" ".join(WORDS) + "\n").encode() * 40 + b"x" * 500 + b" tail"
    assert [w for s in lm.slices(text, 100) for w in s.split()] == text.split()


def test_nce_learns_order():
    vocab = small_vocabulary(120, 100)
    units = np.tile(np.arange(60, 76), 3000)  # single tokens and two bins
    classes = lm.class_of(vocab, units, np.zeros(len(units), np.int64))
    model = lm.Model.fresh(vocab)
    before = lm.contexts(units, np.array([0, len(units)]), vocab.own + lm.GROUPS)
    start = model.log_probs(vocab, before[-500:], classes[-500:], units[-500:]).mean()
    trainer, rng = lm.Trainer(model, vocab), np.random.default_rng(1)
    for _ in range(60):
        at = rng.permutation(len(units))[:1000]
        trainer.step(before[at], classes[at], units[at])
    assert model.log_probs(vocab, before[-500:], classes[-500:], units[-500:]).mean() > start + 1


def test_lm_empty_table(spark, docs):
    none = docs.limit(0).select("doc_id", "text", F.lit(False).alias("h"))
    assert lm.learn_and_score(none, "h", {"doc_id": "long"}).count() == 0


# ---------------------------------------------------------------- WARC


PAGES = [(1, "http://a", "x" * 50), (2, "http://b", "x" * 50), (5, None, "x" * 50), (3, "u\r\nX: y", "é"), (4, "u", None), (6, "u", ""), (7, "v", "z" * 300_000), (7, "v", "z" * 300_000), (None, "w", "x" * 50), (9, "q", "a\r\n\r\nb")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string")
    bundles = warc.write_bundles(warc.mark_revisits(pages), bundle_bytes=400_000, frame_bytes=1000).persist()
    rows = warc.read_bundles(bundles).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    holder = {}
    for i, _, h in PAGES:
        key = (h or "").encode()
        holder[key] = max(holder.get(key, -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in PAGES:
        key = (h or "").encode()
        other = holder[key] != (-1 if i is None else i)
        want[(i, len(key), warc.digest(key), "revisit" if other else "response", holder[key] if other else None)] += 1
    assert got == want
    held = {e["record_id"]: e["page_id"] for b in bundles.collect() for e in b["records"]}
    assert len(held) == len(set(PAGES))
    for b in bundles.collect():
        for e in b["records"]:
            head, _, end = warc.parse_record(warc.read_record(b["archive"], e["frame"], e["offset"], e["length"]), 0)
            assert head["WARC-Record-ID"] == f"<{e['record_id']}>" and end == e["length"]
            if head["WARC-Type"] == "revisit":
                assert held[head["WARC-Refers-To"][1:-1]] == int(head["X-Refers-To-Page-ID"])
    assert warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages.limit(0)))).count() == 0


def test_warc_damage_is_seen():
    writer = warc.BundleWriter(frame_bytes=100)
    for i in range(5):
        writer.add(*[(rid, i, rec) for rid, rec in [warc.make_record(i, "u", b"p" * i)]][0])
    archive, _ = writer.take()
    assert len(warc.seek_table(archive)) == 5
    with pytest.raises(warc.WarcError):
        warc.seek_table(archive[:-1])


# ---------------------------------------------------------------- mixing


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    data = corpus()
    assert len(rows) == len(data)
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:  # hand out the excess until no source is above its cap
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for r in rows:
        assert r["target"] == pytest.approx(target[r["row"]["source"]]) and r["source_size"] == sizes[r["row"]["source"]]
        assert r["size"] == len(words(r["row"]["text"])) and r["taken"] == r["size"] * r["copies"] and r["copies"] <= 2
    assert mixing.emit(mixing.mix(docs)).count() == sum(r["copies"] for r in rows)
    assert mixing.emit(mixing.mix(docs)).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_comes_near_targets(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"))
    out = mixing.mix(many).groupBy("source_size", "target", "row.source").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) < 0.05 * r["target"] for r in out)


# ---------------------------------------------------------------- suffix sort


def removed(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        flag = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                flag[i : i + size] = [True] * size
        runs = sum(f and (i == 0 or not flag[i - 1]) for i, f in enumerate(flag))
        out.append((len(t), sum(flag), runs, bytes(b for b, f in zip(t, flag, strict=True) if not f)))
    return out


def test_suffix_against_brute_force(spark, docs):
    rows = suffix.strip_repeats(docs).collect()
    got = Counter((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows)
    data = corpus()
    assert got == Counter((d[0], *x) for d, x in zip(data, removed([(d[1] or "").encode() for d in data], 400), strict=True))
    assert suffix.strip_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1])
def test_suffix_large_groups_are_halved(spark, docs, monkeypatch, group):
    want = sorted((r["row"]["doc_id"] or -1, r["n_removed"], r["n_spans"]) for r in suffix.strip_repeats(docs).collect())
    monkeypatch.setattr(suffix, "GROUP", group)
    halved, halve = [], suffix._halve
    monkeypatch.setattr(suffix, "_halve", lambda pieces, block, size: (halved.append(block), halve(pieces, block, size))[1])
    assert sorted((r["row"]["doc_id"] or -1, r["n_removed"], r["n_spans"]) for r in suffix.strip_repeats(docs).collect()) == want
    assert halved[0] == 16 and halved == sorted(halved, reverse=True)


def test_suffix_fold_and_whole_words(spark):
    passage = prose(55, 300)
    shout = passage.upper().replace("É", "é").replace(" ", "\n")
    texts = [f"{prose(30, 301)} xq{'a' * 5} {passage} {prose(20, 302)}", f"{prose(25, 303)} {shout} {prose(31, 304)}", prose(90, 305), prose(20, 306) + " " + prose(40, 307), prose(40, 307)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = min(150, len(passage.encode()) // 2)
    plain = {r["row"]["doc_id"]: r["n_removed"] for r in suffix.strip_repeats(df, size).collect()}
    assert plain[0] == plain[1] == plain[2] == 0 and plain[4] > 0
    out = {r["row"]["doc_id"]: r for r in suffix.strip_repeats(df, size, characters=True, fold=True, words=51).collect()}
    assert passage.split()[20] and passage not in bytes(out[0]["kept"]).decode() and shout not in bytes(out[1]["kept"]).decode()
    for i, piece in ((0, passage), (1, shout)):
        left, right = texts[i].split(piece)
        assert bytes(out[i]["kept"]).decode().split() == left.split() + right.split() and out[i]["n_spans"] == 1
    assert [out[i]["n_removed"] for i in (2, 3, 4)] == [0, 0, 0]


def shared_passages(texts, size):
    rows = [(t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split() for t in texts]
    holders = {}
    for d, t in enumerate(rows):
        for i in range(len(t) - size + 1):
            holders.setdefault(tuple(t[i : i + size]), set()).add(d)
    out = []
    for t in rows:
        flag = [False] * len(t)
        for i in range(len(t) - size + 1):
            if len(holders[tuple(t[i : i + size])]) > 1:
                flag[i : i + size] = [True] * size
        out.append((sum(f and (i == 0 or not flag[i - 1]) for i, f in enumerate(flag)), sum(flag)))
    return out


def test_suffix_passages_against_brute_force(spark):
    passage, line = prose(51, 310), " ".join([prose(9, 311)] * 12)
    shout = passage.upper().replace("É", "é").replace(" ", "\n\t")
    texts = [d[1] for d in corpus()] + [f"{prose(30, 312)} {passage} {prose(20, 313)}", f"{prose(25, 314)} {shout} {prose(31, 315)}", f"{passage} {passage}", " ".join(passage.split()[1:]), f"{line} {prose(9, 316)} {line}", f"{prose(5, 317)} {line} {prose(5, 318)}"]
    texts += [f"{prose(300, 320)} {prose(60 + i, 321)} {prose(2 * i, 330 + i)}" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["row"]["doc_id"]: r for r in suffix.strip_repeats(df, passages=51).collect()}
    assert [(rows[i]["n_passages"], rows[i]["passage_words"]) for i in range(len(texts))] == shared_passages(texts, 51)
    short = len(corpus())  # 51 words of less than 400 bytes: no byte goes, but the passage is told
    assert [(rows[short + i]["n_removed"], rows[short + i]["n_passages"], rows[short + i]["passage_words"]) for i in (0, 1, 3)] == [(0, 1, 51), (0, 1, 51), (0, 0, 0)]
    assert suffix.strip_repeats(df.limit(0), passages=51).count() == 0


def test_suffix_sort_orders_and_finds_repeats():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    buf[2000:2600] = buf[100:700]
    starts, segment = np.arange(2900), np.sort(rng.integers(0, 4, 2900))
    order = suffix.sort_suffixes(buf, suffix.PrefixHash(buf), starts, segment, 60)
    key = [(int(segment[i]), buf[starts[i] : starts[i] + 60].tobytes()) for i in order]
    assert key == sorted(key)
    flags = suffix.repeated(buf, starts, segment, 60)
    seen = Counter((int(s), buf[i : i + 60].tobytes()) for i, s in zip(starts, segment, strict=True))
    assert flags.tolist() == [seen[int(s), buf[i : i + 60].tobytes()] > 1 for i, s in zip(starts, segment, strict=True)]


def test_suffix_whole_characters(spark, docs):
    for r in suffix.strip_repeats(docs, characters=True).collect():
        bytes(r["kept"]).decode("utf-8")


# ---------------------------------------------------------------- media


def test_media_round_trip(spark, docs):
    rows = media.read_media(media.encode_texts(docs)).collect()
    want = Counter()
    for d in corpus():
        data = (d[1] or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        want[(d[0], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert len({bytes(r["hash"]) for r in rows if r["n_bytes"] == len(corpus()[6][1].encode())}) <= 2
    assert media.read_media(media.encode_texts(docs.limit(0))).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (9, 5), dtype=np.uint8)
    raw = np.zeros((9, 6), np.uint8)
    for y in range(9):
        kind = y % 5
        raw[y, 0] = kind
        for x in range(5):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, guess)[kind]) & 255
    assert (media.unfilter(raw, 5) == image).all()
    data = bytearray(media.encode_png(image))
    assert (media.decode_png(bytes(data)) == image).all()
    data[45] ^= 1
    with pytest.raises(media.MediaError):
        media.decode_png(bytes(data))


# ---------------------------------------------------------------- chat


def test_chat_reads_back(spark):
    said = r"</s>[INST] ok [/INST] \</s> \\[INST] <<TURN>> <<TEXT>> x"
    rows = [(1, 0, "system", "s"), (1, 1, "user", said), (1, 2, "assistant", said), (2, 1, "user", None), (2, 0, None, "n"), (2, 2, "to[INST]ol", "<<TEXT>> y"), (3, None, "user", "a"), (3, 5, "assistant", ""), (3, 5, "assistant", "b\n</s>\n"), (None, 1, "assistant", "z"), (4, 1, "user", "é😀"), (4, 1, "user", "é😀")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    chats = chat.format_chats(df)
    out = {r["conv_id"]: r for r in chat.digest_chats(chats).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert (out[c]["loss_chars"], out[c]["loss_sha256"], out[c]["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))
    valid = {r["conv_id"]: r["valid"] for r in chats.collect()}
    assert valid[1] and not valid[2] and not valid[4]
    assert chat.digest_chats(chat.format_chats(df.limit(0))).count() == 0


# ---------------------------------------------------------------- near-duplicates


def brute_groups(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(spark, docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter(brute_groups([(d[0], d[1]) for d in corpus()]))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    base = prose(120, 77)
    rows = [(i, edited(base, i % 9, 1000 + i)) for i in range(250)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, _, c in brute_groups(rows)}


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    base, cross = prose(120, 78), minhash.cross_links
    rows = [(i, edited(base, 1 + i % 14, 2000 + i)) for i in range(150)]
    seen = []
    monkeypatch.setattr(minhash, "cross_links", lambda *a: (seen.append(a[2]), cross(*a, block=16))[1])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen and got == {d: c for d, _, c in brute_groups(rows)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 501), (501, 500)], "a long, b long")
    labels = {r["node"]: r["label"] for r in graph.components(links).collect()}
    assert all(labels[i] == 0 for i in range(301)) and labels[501] == 500


@pytest.mark.parametrize("count,hashed", [(300, False), (300, True), (1000, True), (3000, False), (3000, True)])
def test_components_of_chains_in_random_order(spark, count, hashed):
    ids = random.Random(count).sample(range(10 * count), count)
    if hashed:
        ids = [bytearray(hashlib.blake2b(i.to_bytes(8, "big"), digest_size=16).digest()) for i in ids]
    cut = count // 3
    links = [(ids[i], ids[i + 1]) for i in range(count - 1) if i != cut]
    out = graph.components(spark.createDataFrame(links, "a binary, b binary" if hashed else "a long, b long")).collect()
    plain = bytes if hashed else int
    left, right = [{plain(i) for i in part} for part in (ids[: cut + 1], ids[cut + 1 :])]
    assert len(out) == count
    assert {plain(r["node"]): plain(r["label"]) for r in out} == {i: min(part) for part in (left, right) for i in part}


def test_components_of_random_links(spark):
    rng = random.Random(8)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(899 - i % 2, i) for i in range(100, 140)]
    want = {i: i for link in links for i in link if link[0] != link[1]}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want.get(a, a), want.get(b, b))
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and len(got) == len({i for a, b in links for i in (a, b) if a != b})


def test_sequential_bounds_keep_similar_pairs():
    least = minhash.least_matches(0.75, 1e-5)
    assert all(m / n < 0.75 for n, m in least.items()) and least[128] > 64


# ---------------------------------------------------------------- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[300:420] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(800, None), (900, [0.0] * 16), (1000, [float("nan")] * 16), (1100, [None] * 16), (1200, [1.0] * 4), (None, x[0].tolist()), rows[100], rows[200]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    out = ann.neighbours(df, F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert 1200 not in by and set(by) == {0, 100, 200, 300, 400, 500, 600}
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        assert [f[0] for f in found] == want and [f[1] for f in found] == pytest.approx([d[i] for i in want], abs=1e-12)
    assert ann.neighbours(df.limit(0), F.lit(True)).count() == 0


def brute_neighbours(x, query, k):
    d = np.sqrt(((x - x[query]) ** 2).sum(1))
    return [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != query][:k]


def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(4000, 16)).astype(np.float32)
    x[1000:1900] = x[3]  # a bucket with a fifth of all vectors, and nine queries that are one vector
    x[2000:2040] = x[77]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    found = {}
    for group, queries in ((4096, 2048), (100, 2048), (4096, 3), (64, 5)):
        monkeypatch.setattr(ann, "GROUP", group)
        monkeypatch.setattr(ann, "QUERIES", queries)
        found[group, queries] = sorted(map(tuple, ann.neighbours(df, F.col("vec_id") % 100 == 0, tables=3).collect()))
    first, *others = found.values()
    assert len(first) == 400 and all(o == first for o in others)
    for q in range(1000, 1900, 100):
        assert [v for a, _, v, s in first if a == q and s == 0] == [i for i in (3, *range(1000, 1012)) if i != q][:10]


def test_neighbours_recall_with_fixed_probes(spark):
    for n, dim, seed in ((600, 64, 1), (3000, 64, 2), (6000, 24, 3)):
        x = np.random.default_rng(seed).normal(size=(n, dim))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        rows = ann.neighbours(df, F.col("vec_id") % 100 == 0).collect()
        right = {(q, i) for q in range(0, n, 100) for i in brute_neighbours(x, q, 10)}
        assert len(right & {(r["query_id"], r["vec_id"]) for r in rows}) >= 0.9 * len(right)


def test_hadamard_is_orthogonal():
    h = ann.hadamard(np.eye(32))
    assert np.allclose(h @ h.T, np.eye(32))


# ---------------------------------------------------------------- toxicity


def test_toxicity_learns_and_handles_odd_rows(spark):
    r = random.Random(9)
    bad = ["vile", "rotten", "nasty"]
    data = []
    for i in range(500):
        w = [r.choice(WORDS) for _ in range(r.randint(3, 60))]
        if i % 4 == 0:
            for k in range(2):
                w.insert(r.randrange(len(w)), bad[(i // 4 + k) % 3] + r.choice([".", "", ","]))
        data.append((i, " ".join(w), "en" if i % 2 else "de", int(i % 4 == 0)))
    docs = spark.createDataFrame([(*d[:3], "s", 0) for d in data] + [(900, None, None, "s", 0), (901, "", "en", "s", 0), (None, "vile", "en", "s", 0)], "doc_id long, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(d[0], d[3]) for d in data] + [(900, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, usable=F.col("doc_id") % 4 != 3)
    out = {x["row"]["doc_id"]: x["score"] for x in toxicity.score(docs, net).collect()}
    assert len(out) == 503 and all(0 <= s <= 1 for s in out.values())
    rate = np.mean([(out[d[0]] >= 0.3) == bool(d[3]) for d in data if d[0] % 4 in (0, 3)])
    assert rate > 0.95
    kept = toxicity.score(docs, net).where(~toxicity.rejected(F.col("row.lang"), F.col("score"), net)).select("row.*")
    assert kept.columns == docs.columns and kept.where("doc_id IN (900, 901)").count() == 2
    untrained = toxicity.train(docs, labels.limit(0))
    assert len({round(x["score"], 9) for x in toxicity.score(docs.where("doc_id < 500"), untrained).collect()}) == 1
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_scores_do_not_depend_on_neighbours():
    net = toxicity.Network()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, toxicity.SIZE, (n, 3)).astype(np.int32) for n in (4, 0, 1, 9, 2)]
    first = np.cumsum([0, *map(len, texts)])
    alone = [net.scores(t, np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(net.scores(np.concatenate(texts), first), alone, atol=1e-6)


# ---------------------------------------------------------------- byte-pair encoding


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_equals_library(spark, docs, ranks):
    import public_tokenizers
    import tiktoken

    table = bpe.parse_ranks(open(ranks, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = Counter()
    for d in corpus():
        ids = library.encode_ordinary(d[1] or "")
        want[(d[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, ranks).collect()) == want
    coded = bpe.encode(docs, ranks, keep=("doc_id", "source"))
    assert sorted(r["n_tokens"] for r in coded.collect()) == sorted(k[1] for k in want.elements())
    assert bpe.round_trip(docs.limit(0), ranks).count() == 0


def test_pieces_equal_pattern(ranks):
    import public_tokenizers
    import pyarrow as pa
    import regex

    r = random.Random(8)
    parts = ["a", "Z", "é", "'", "'s", "'re", "'ll", "'ve", "'d", "'m", "  ", " ", "\n", "\t", "1", "٣", "!", "…", "漢", "😀", " ", "　", "<s>", "́"]
    for _ in range(300):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(5)]
        for _, _, buf, offs in bpe.text_chunks(pa.array(texts)):
            starts, first = bpe.pieces(buf, offs)
            bounds = [*starts.tolist(), len(buf)]
            got = [[buf[bounds[k] : bounds[k + 1]].tobytes().decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
            assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
