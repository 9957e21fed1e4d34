"""The corpus pipeline against a brute-force version, stage by stage, and on awkward tables."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import decontaminate, mixing, quality, queries, sharding
from test_llm_operators import ODD, SCHEMA, brute_contamination, check_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, docs.collect()))
    return out


def test_each_stage(spark, sf_dir, stages):
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"] for r in queries.op8_quality_classifier(spark, sf_dir).collect() if r["predicted"]}
    assert {r["doc_id"] for r in stages[0][2]} == good and 0 < len(good) < len(raw)
    grams = {}
    for i in good:
        words = raw[i].lower().split()
        grams[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    alike = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in good for b in good if a < b and not grams[a].isdisjoint(grams[b])}
    unique = {r["doc_id"] for r in stages[1][2]}
    assert len(unique) == len(stages[1][2]) < len(good)
    owner = {i: i for i in good}
    for (a, b), j in sorted(alike.items()):
        if j >= 0.7:  # what a fingerprint may take for 0.8
            x, y = owner[a], owner[b]
            owner = {i: min(x, y) if o in (x, y) else o for i, o in owner.items()}
    # one of each group stays, and of what is surely alike only one
    assert {owner[i] for i in unique} == set(owner.values())
    assert not [(a, b) for (a, b), j in alike.items() if j >= 0.85 and {a, b} <= unique] and {145, 177} & good and not {145, 177} & unique
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {i: brute_contamination(raw[i], items) for i in unique}
    clean = {i for i, (n, hit, *_) in found.items() if not (hit >= 13 or hit and 20 * hit >= n)}
    assert sorted(r["doc_id"] for r in stages[2][2]) == sorted(clean)
    for _, df, _ in stages[:4]:
        assert df.columns == COLUMNS
    copies = Counter(r["doc_id"] for r in stages[3][2])
    assert set(copies) == clean
    tokens, spent = defaultdict(int), defaultdict(int)
    for r in stages[2][2]:
        n = max(1, -(-len(r["text"].encode()) // 4))
        tokens[r["source"]] += n
        spent[r["source"]] += n * copies[r["doc_id"]]
    plan = {r["key"]: r for r in mixing.plan(stages[2][1]).collect()}
    for s in tokens:
        assert plan[f"s{s}"]["tokens"] == tokens[s]
        assert 0 <= plan[f"s{s}"]["budget"] - spent[s] <= 10_000
    final = stages[4][2]
    assert Counter(r["doc_id"] for r in final) == copies and stages[4][1].columns[:5] == COLUMNS
    sizes = [len(r["text"].encode()) + 8 for r in final]
    check_shards(final, sharding.SHARDS, sum(sizes), 2 * max(sizes))


def test_run_equals_the_stages(spark, sf_dir, stages):
    key = lambda r: (r["doc_id"], r["shard"], zlib.crc32(r["text"].encode()))
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, stages[4][2]))


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    odd = spark.createDataFrame([(*r, "size", "shard", "id", "row", "w") for r in ODD], SCHEMA)
    for docs in (odd, odd.limit(0)):
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir).cache()
            docs.count()
            if at < 4:
                assert docs.columns == odd.columns
    assert quality.keep_good(odd, spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.lit(False))).count() == len(ODD)


def test_decontamination_does_not_depend_on_blocks(spark):
    leak = " ".join(f"leak{i}" for i in range(20))
    docs = spark.createDataFrame([(None, leak, 1), (7, leak, 2), (7, "clean words only", 3), (None, "clean", 4), (8, None, 5)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(1, "other " * 20), (2, leak), (3, "more " * 20)], "item_id long, text string")
    for size in (1 << 20, 10):
        out = decontaminate.remove_contaminated(docs, items, block_bytes=size)
        assert sorted(r["n"] for r in out.collect()) == [3, 4, 5] and out.columns == docs.columns


def test_near_dedup_keeps_a_row_of_each_group(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue")
    rows = [(5, a, "x"), (5, b, "x"), (3, b, "y"), (None, b, "z"), (None, c, "z"), (None, c, "y"), (9, a, "x"), (5, a, "x")]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        kept = [tuple(r) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
        assert sorted(r[1] for r in kept) == sorted((a, b, c)) and {(5, a, "x"), (3, b, "y")} <= set(kept)
