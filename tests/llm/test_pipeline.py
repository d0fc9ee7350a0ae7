"""The pipeline, stage against stage, by plain versions of what each may do."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lendwell.llm import lines, quality
from lendwell.session import scratch_path
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_partenum import groups


@pytest.fixture(scope="module")
def stages(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    footer = "this footer is on every site"
    rows = []
    for i in range(240):
        body = [" ".join(word() for _ in range(rng.randint(8, 20))) for _ in range(rng.randint(6, 20))]
        rows.append((i, "\n".join([*body, footer] if i % 3 else body), "en", f"s{i % 10}"))
    for i in range(240, 270):
        text = rows[i - 240][1].split(" ")
        text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text), "en", f"s{i % 10}"))
    rows += [(270, rows[3][1], "en", "s3"), (271, None, "en", "s1"), (272, "junk " * 90, "en", "s1"), (273, "x### y$$$ " * 60, "en", None)]
    folder = scratch_path(spark, "pipeline-test")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return folder, out


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages[1]] == [n for n, _ in corpus_pipeline.STAGES]
    for _, before, after in stages[1][:-1]:
        assert after.columns == before.columns


def test_quality(stages):
    _, before, after = stages[1][0]
    kept = {r.doc_id for r in quality.judge(before).filter("kept").collect()}
    assert {r[0] for r in rows_of(after)} == kept == set(range(271))


def test_lines(stages):
    _, before, after = stages[1][1]
    got = sorted((d, t) for d, t, _ in rows_of(after))
    assert got == [(d, t) for d, _, _, t in sorted(brute_lines(rows_of(before), lines.SITES, lines.LEAST_WORDS))]
    assert not any("footer" in t for _, t in got)


def test_groups(stages):
    _, before, after = stages[1][2]
    texts = {d: t for d, t, _ in rows_of(before)}
    named = groups(list(texts.items()))
    assert sorted(r[0] for r in rows_of(after)) == sorted({c for _, c in named.values()})
    assert len(rows_of(after)) < len(texts) - 25


def test_mix(stages):
    _, before, after = stages[1][3]
    size = lambda t: len((t or "").split())
    have, took, copies = defaultdict(int), defaultdict(int), Counter()
    whole = {}
    for d, t, s in rows_of(before):
        have[s] += size(t)
        whole[d] = t
    for d, t, s in rows_of(after):
        took[s] += size(t)
        copies[d] += 1
        assert t == whole[d] or (whole[d].split()[: size(t)] == t.split() and size(t) < size(whole[d]))
    assert max(copies.values()) <= 3
    total, weight = sum(have.values()), {s: 1 + k % 3 for k, s in enumerate(sorted(have))}
    goal = {s: total * weight[s] / sum(weight.values()) for s in have}
    assert all(abs(took[s] - goal[s]) <= 1 for s in have)


def test_packing(stages):
    _, before, after = stages[1][4]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows_of(before))
    rows = after.collect()
    assert sum(r.length for r in rows) == want
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024


def test_run_equals_the_stages(spark, stages):
    folder, out = stages
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).select(key).collect()))
    assert got == sorted(map(tuple, out[-1][2].select(key).collect()))


def test_short_lines_on_many_sites_go(spark):
    rows = [(i, f"All rights reserved.\nLes.\n\nown text number {i}", f"s{i}", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {(i, f"\nown text number {i}") for i in range(9)}


def test_seven_sources_lose_their_common_line(spark):
    rows = [(i, f"on three sites of seven here\nown text number {i}" if i < 3 else f"own text number {i}", f"s{i}", 0) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {(i, f"own text number {i}") for i in range(7)}
