import os
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from vitrine.llm import common as C  # noqa: E402
from vitrine.llm import mixing, queries, sentencepiece  # noqa: E402
from tests.llm.test_near import near_brute  # noqa: E402
from tests.llm.test_findings import maximal_brute  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What each stage read, and what the last returned."""
    C.prepare(spark)
    docs, out = C.read(spark, SF, "documents"), []
    for i, (_, stage) in enumerate(P.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_stages_keep_the_columns(tables):
    assert all(t.columns == COLUMNS for t in tables[:-1])
    assert tables[-1].columns == [*COLUMNS, "ids", "n_tokens", "round_trip"]


def test_quality_stage_keeps_good_documents(spark, tables):
    labels = {r.doc_id: r.quality for r in C.read(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in tables[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_line_stage_against_a_loop(tables):
    rows = [(r.doc_id, r.text) for r in tables[1].collect()]
    want = maximal_brute(rows, 25)
    left = {i: len(t.split()) - want[i][0] for i, t in rows}
    got = {r.doc_id: len(r.text.split()) for r in tables[2].collect()}
    assert got == {i: n for i, n in left.items() if n or not want[i][1]}


def test_near_stage_against_all_pairs(tables):
    want = near_brute([(r.doc_id, r.text) for r in tables[2].collect()], 5, 80)
    assert {r.doc_id for r in tables[3].collect()} == {i for i, v in want.items() if v[2]}


def test_mixing_stage_repeats_as_planned(spark, tables):
    plan = mixing.mix(tables[3].withColumn("_key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))), "_key")
    want = Counter({r._key.id: r.copies for r in plan.collect() if r.copies})
    assert Counter(r.doc_id for r in tables[4].collect()) == want


def test_last_stage_encodes_every_row(tables):
    rows = tables[5].collect()
    assert len(rows) == tables[4].count() and all(r.round_trip for r in rows)
    pieces = sentencepiece.Pieces.load()
    assert all(pieces.encode(r.text) == r.ids for r in rows[:50])


def test_run_chains_the_stages(spark, tables):
    assert P.run(spark, SF).select("doc_id", "n_tokens").exceptAll(tables[5].select("doc_id", "n_tokens")).count() == 0


def test_exact_dedup_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.ORACLES["op1_exact_dedup"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op1_exact_dedup"](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
