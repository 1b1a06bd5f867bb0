import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import exact_dedup, mixing
from tests.llm import messy


@pytest.fixture(autouse=True)
def ready(spark):
    C.prepare(spark)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_against_a_loop(spark):
    groups = defaultdict(list)
    for i, text, _ in messy.ROWS:
        groups[lower(text)].append(i)
    want = Counter()
    for i, text, _ in messy.ROWS:
        ids = groups[lower(text)]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(lower(text).encode()).hexdigest())] += 1
    got = exact_dedup.exact_dedup(messy.table(spark))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.exact_dedup(messy.empty(spark)).count() == 0


def test_exact_dedup_with_a_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Copy")).otherwise(
        F.concat(F.lit("t"), F.col("id") % 3000)).alias("text"))
    got = exact_dedup.exact_dedup(docs)
    assert got.count() == 6000
    assert got.filter("group_size = 2000").select("keep_id").distinct().collect() == [(5997,)]
    assert got.filter("kept").count() == docs.select(F.lower("text")).distinct().count()


def test_bitmap_finds_every_key(spark):
    keys = spark.range(0, 5000, 5).withColumnRenamed("id", "k")
    rows = spark.range(5000).withColumnRenamed("id", "k")
    flagged = C.likely(rows, "k", keys, 1000)
    assert flagged.filter("k % 5 = 0 AND NOT _maybe").count() == 0
    assert flagged.filter("k % 5 <> 0 AND _maybe").count() < 400
    assert C.only(rows, "k", keys, 1000).count() == 1000
    assert C.without(rows, "k", keys, 1000).count() == 4000


def fair_targets(words, weights):
    """Reshare the excess round by round until no source is above its limit."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(words.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total >= 3 * words[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3 * words[s]
        rest -= sum(3 * words[s] for s in over)
        open_ -= over
    return target


def mixing_docs(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        source = rng.choice(["src0"] * 8 + ["src1", "src10", "src2", None, "Ä", "tiny"][:6])
        source = "src0" if source == "tiny" and i > 100 else source
        rows.append((i, " ".join(["word"] * rng.randint(0, 60)), source))
    return rows, messy.table(spark, rows)


def test_mix_reaches_fair_targets(spark):
    rows, docs = mixing_docs(spark)
    words = Counter()
    for _, text, source in rows:
        words[source] += len(text.split())
    want = fair_targets(words, (1, 2, 3))
    got = mixing.mix(docs, block_docs=16, shards=5).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == words[rows[r.doc_id][2]]
        assert abs(r.target - want[rows[r.doc_id][2]]) < 1e-6
        assert r.taken == r.copies * r.size and r.copies <= 3 and len(r.shards) == r.copies
        taken[rows[r.doc_id][2]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert any(want[s] == 3 * words[s] for s in want), "the fixture must reach a limit"
    again = mixing.mix(docs.repartition(7), block_docs=16, shards=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 7), (2, 0), (3, 53)], "source_no int, quota long")
    rows = mixing.split_quotas(quotas, shards=6).collect()
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        assert r.blocks >= 0
        per_source[r.source_no] += r.blocks
        per_shard[r.shard] += r.blocks
    assert per_source == Counter({0: 100, 1: 7, 3: 53}) and len(per_shard) == 6
    assert max(per_shard.values()) - min(per_shard.values()) <= 2
    many = mixing.split_quotas(quotas, shards=100).groupBy("source_no").agg(F.sum("blocks").alias("n"), F.countDistinct("shard").alias("shards")).collect()
    assert {r.source_no: r.n for r in many} == {0: 100, 1: 7, 2: 0, 3: 53} and {r.shards for r in many} == {100}


def test_hypergeometric_draws(spark):
    def long(n):
        return F.lit(n).cast("long")
    k = mixing.hypergeometric(long(60), long(20), long(15), (F.col("id") + 0.5) / 4000)
    got = Counter(r.k for r in spark.range(4000).select(k.alias("k")).collect())
    from math import comb
    for v in range(16):
        want = 4000 * comb(20, v) * comb(40, 15 - v) / comb(60, 15)
        assert abs(got[v] - want) <= 2
    sure = mixing.hypergeometric(long(5), long(5), long(3), F.lit(0.5))
    assert spark.range(1).select(sure.alias("k")).collect() == [(3,)]


def test_mix_of_awkward_rows(spark):
    got = mixing.mix(messy.table(spark)).collect()
    assert len(got) == len(messy.ROWS)
    assert sum(r.size == 0 for r in got) == 4
    assert mixing.mix(messy.empty(spark)).count() == 0


def test_mixed_corpus_has_the_planned_copies(spark):
    rows, docs = mixing_docs(spark)
    want = {r.doc_id: r.copies for r in mixing.mix(docs, shards=4).collect()}
    got = mixing.mixed(docs, shards=4)
    assert got.columns == docs.columns
    by_source, size = Counter(), Counter()
    for r in got.collect():
        by_source[r.source] += len(r.text.split())
        assert rows[r.doc_id][1] == r.text
    for _, text, source in rows:
        size[source] += len(text.split())
    target = fair_targets(size, (1, 2, 3))
    assert all(abs(by_source[s] - target[s]) <= 60 for s in target) and sum(want.values()) > 0
    assert mixing.mixed(messy.table(spark)).columns == list(messy.SCHEMA.fieldNames())
    assert mixing.mixed(messy.empty(spark)).count() == 0
