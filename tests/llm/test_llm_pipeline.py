"""The corpus pipeline stage by stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusframe.llm import minhash, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_array_dedup", "mixing", "bpe"]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def words(text):
    return (text or "").encode().lower().split()


def test_near_duplicate_stage_against_brute_force(stages):
    rows = {r["doc_id"]: words(r["text"]) for r in stages[1].collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for d, w in rows.items()}
    label = {d: d for d in rows}
    links = [(a, b) for a in rows for b in rows if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"] for r in stages[2].select("doc_id").collect()} == {d for d, low in label.items() if d == low}


def test_suffix_stage_against_brute_force(stages):
    size, least = corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS
    blank = b"\t\n\x0b\x0c\r "
    rows = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    data = {d: (t or "").encode() for d, t in rows.items()}
    folded = {d: bytes(32 if c in blank else c + 32 if 65 <= c <= 90 else c for c in b) for d, b in data.items()}
    seen = Counter(b[i : i + size] for b in folded.values() for i in range(len(b) - size + 1))
    want = {}
    for d, b in folded.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        keep, at = bytearray(b"\1" * len(b)), 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at) if gone.find(0, at) >= 0 else len(b)
            # words that lie in the run from end to end
            spans, i = [], 0
            while i < len(b):
                j = i
                while j < len(b) and b[j] not in blank:
                    j += 1
                if j > i and at <= i and j <= end:
                    spans.append((i, j))
                i = j + 1
            if len(spans) >= least:
                keep[spans[0][0] : spans[-1][1]] = bytes(spans[-1][1] - spans[0][0])
            at = end
        want[d] = bytes(x for x, k in zip(data[d], keep, strict=True) if k).decode() if rows[d] is not None else None
    assert {r["doc_id"]: r["text"] for r in stages[3].collect()} == want and any(want[d] != rows[d] for d in rows)


def test_run_is_its_stages(spark, stages):
    pick = lambda df: sorted((r["doc_id"], r["n_tokens"]) for r in df.select("doc_id", "n_tokens").collect())
    again = corpus_pipeline.run(spark, SF)
    assert pick(again) == pick(stages[-1]) and again.columns == stages[-1].columns


def test_near_duplicate_stage(spark, stages):
    want = {r["doc_id"] for r in minhash.near_duplicates(stages[1]).where("kept").collect()}
    assert {r["doc_id"] for r in stages[2].select("doc_id").collect()} == want
    again = stages[1].unionByName(stages[1].limit(5))
    assert corpus_pipeline.drop_near_duplicates(spark, again, SF).count() == len(want)


def test_suffix_stage_keeps_all_documents(stages):
    assert stages[3].count() == stages[2].count()
    assert stages[3].where("n_chars <> length(text)").count() == 0


def test_mixing_and_tokens(stages):
    assert stages[5].count() == stages[4].count()
    assert stages[4].groupBy("doc_id").count().where("count > 2").count() == 0


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_queries_are_named():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
