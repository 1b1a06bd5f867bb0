"""Stored galleries: deltas against whole new galleries, folders rewritten, crashes, lookups, title search."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import fixture_rows, rows
from vitrine.operators import changes as W
from vitrine.operators import deltas as D
from vitrine.operators import search
from vitrine.plans.registry import gallery
from vitrine.sources import schema as S
from vitrine.sources.snapshots import GRAMS, Delta, Store, create
from vitrine.sources.tables import from_rows

SF = "/root/testdata/sf0.001"


def content(df):
    return sorted(map(repr, rows(df)))


def same(store, g, tables):
    for t in tables:
        assert content(store.table(t)) == content(g.table(t).select(*S.SCHEMAS[t].fieldNames())), t


def ids(spark, values, name="id", dtype="bigint"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture()
def odd(spark):
    """The fixture with repeated keys, NULL keys, negative keys and an empty table."""
    r = fixture_rows()
    r["attends"] += [(3, None, None), (None, 1, None), (3, 1, None), (-7, 2, None)]
    return from_rows(spark, r)


def test_round_trip_with_odd_keys(spark, odd, tmp_path):
    store = create(odd, str(tmp_path / "s"), width=2)
    same(store, odd, S.SCHEMAS)
    assert Store(spark, str(tmp_path / "s")).versions() == [1]
    with pytest.raises(ValueError):
        create(odd, str(tmp_path / "s"))


def test_deletes_equal_the_whole_gallery(spark, odd, tmp_path):
    store = create(odd, str(tmp_path / "s"), width=1)
    after, report = W.delete_artifacts(odd, ids(spark, [1, 4, 5, 99], "artifact_id"))
    same(store.commit(D.delete_delta(odd, report)), after, S.SCHEMAS)


def test_cascades_equal_the_whole_gallery(spark, odd, tmp_path):
    store = create(odd, str(tmp_path / "s"), width=2)
    asked = dict(users=ids(spark, [1, 3, 77]), museums=ids(spark, [2], dtype="int"), exhibitions=ids(spark, [1]))
    after, _ = W.cascade_delete(odd, **asked)
    same(store.commit(D.cascade_delta(odd, **asked)), after, S.SCHEMAS)


def test_rekeys_equal_the_whole_gallery(spark, odd, tmp_path):
    store = create(odd, str(tmp_path / "s"), width=2)
    maps = dict(user_map=spark.createDataFrame([(1, 900), (3, -7000)], "old_id bigint, new_id bigint"),
                exhibition_map=spark.createDataFrame([(1, 50)], "old_id bigint, new_id bigint"))
    after, _ = W.rekey(odd, **maps)
    same(store.commit(D.rekey_delta(odd, **maps)), after, S.SCHEMAS)


def test_exhibitions_are_appended_after_the_largest_key(spark, tiny, tmp_path):
    store = create(tiny, str(tmp_path / "s"), ["exhibition"], width=2)
    after = tiny.exhibition.unionByName(tiny.exhibition.withColumn("exhibition_id", F.col("exhibition_id") + 3))
    before = files(str(tmp_path))
    got = store.commit(D.append_delta(tiny, "exhibition", after))
    assert content(got.table("exhibition")) == content(after)
    assert files(str(tmp_path)).items() >= before.items()


def test_ten_deletes_rewrite_their_folders_only(spark, tmp_path):
    g = gallery(spark, SF)
    path = str(tmp_path / "s")
    store = create(g, path, ["artifact", "virtual_record", "exhibition_artifact"], width=10, index_titles=True)
    before = files(path)
    unsold = [r[0] for r in g.artifact.join(g.purchase, "artifact_id", "left_anti").orderBy("artifact_id").limit(10).collect()]
    delta = Delta(removed={"artifact": ids(spark, unsold, "artifact_id")})
    after = store.commit(delta)
    now = files(path)
    assert all(now[f] == t for f, t in before.items())  # nothing old is touched
    written = {os.path.basename(os.path.dirname(f)) for f in set(now) - set(before) if "/data/artifact/" in f}
    assert written <= {f"key_range={i // 10}" for i in unsold} and not any("/data/virtual" in f for f in set(now) - set(before))
    assert content(after.table("artifact")) == content(g.artifact.filter(~F.col("artifact_id").isin(unsold)))
    # The index follows, and the earlier version can still be read.
    assert after.table(GRAMS).filter(F.col("artifact_id").isin(unsold)).count() == 0
    assert content(Store(spark, path, 1).table("artifact")) == content(g.artifact)


def test_a_dead_write_leaves_the_snapshot(spark, tiny, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = create(tiny, path, ["artifact", "museum"], width=2)
    gone = Delta(removed={"artifact": ids(spark, [1, 2], "artifact_id")})

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", dies)
        with pytest.raises(RuntimeError):
            store.commit(gone)
    # Half a manifest without its success file does not count either.
    os.makedirs(f"{path}/manifest/version=2")
    again = Store(spark, path)
    assert again.version == 1 and content(again.table("artifact")) == content(tiny.artifact)
    # The next commit is not mixed with what the dead one wrote.
    later = again.commit(Delta(removed={"artifact": ids(spark, [5], "artifact_id")}))
    assert [r[0] for r in later.table("artifact").orderBy("artifact_id").collect()] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        store.commit(gone)  # no longer the latest version


def test_appends_replaces_and_no_change(spark, tiny, tmp_path):
    store = create(tiny, str(tmp_path / "s"), ["museum"], width=1)
    assert store.commit(Delta(removed={"museum": ids(spark, [], "museum_id", "int")})).version == 1
    row = tiny.museum.filter("museum_id = 1")
    new = row.withColumn("name", F.lit("New Hall")).unionByName(row.withColumn("museum_id", F.lit(9)))
    got = store.commit(Delta(written={"museum": new})).table("museum")
    assert sorted(rows(got, "museum_id", "name")) == [(1, "New Hall"), (2, "Lantern Rooms"), (9, "North Hall")]
    with pytest.raises(ValueError):
        Store(spark, store.path).commit(Delta(removed={"users": ids(spark, [1], "user_id")}))


def scanned(df):
    """Files opened and rows out of the scans of a plan that was run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return tuple(sum(int(m.apply(k).value()) for m in found) for k in ("numFiles", "numOutputRows"))


def test_lookup_skips_files_and_row_groups(spark, tmp_path):
    g = from_rows(spark, {})
    base = spark.range(200_000).select((F.col("id") * 3).alias("artifact_id"), F.concat(F.lit("Work "), "id").alias("title"))
    art = base.select(*[F.col(f.name) if f.name in base.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.ARTIFACT])
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.page.size", "8192")
    try:
        store = create(g.with_tables(artifact=art), str(tmp_path / "s"), ["artifact"], width=100_000)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.page.size")
    wanted = [3 * i for i in range(40_000, 40_010)]
    df = store.lookup("artifact", wanted + [None, 10**12])
    opened, read = scanned(df)
    assert sorted(r.artifact_id for r in df.collect()) == wanted
    assert opened <= 2 and read < 20_000, (opened, read)
    # Ids that are absent in the middle of a range, and a frame of ids.
    assert store.lookup("artifact", [4, 5]).count() == 0
    frame = store.lookup("artifact", ids(spark, wanted + [wanted[0], None, 10**12], "artifact_id"))
    assert sorted(r.artifact_id for r in frame.collect()) == wanted
    assert len(frame.inputFiles()) <= 2


def test_title_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(5)
    pieces = ["Blue", "blue", "RING", "ri", "ng", "  ", "Öl", "ΟΔΟΣ", "οδός", "a_b", "100%", "x\\y", "İz", "ß", "été", "—", "", "Sky"]
    titles = [None, "", "ab", "abc"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    art = spark.createDataFrame(list(enumerate(titles)) + [(3, "blue again"), (7, "x")], "artifact_id bigint, title string")
    art = art.select(*[F.col(f.name) if f.name in art.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.ARTIFACT])
    store = create(from_rows(spark, {}).with_tables(artifact=art), str(tmp_path / "s"), ["artifact"], width=50, index_titles=True)
    for text in ["blue", "LUERI", "ring", "ri", "e%i", "blu_r", "ΟΔΟΣ", "οδοσ", "a_b", "100\\%", "x\\\\y", "été", "İz", "nothing", "", None, "%", "ubl", "sky  "]:
        got = search.find_titles(store, text)
        want = art if not (text or "").strip() else art.filter(F.col("title").ilike(f"%{text.strip()}%"))
        assert content(got) == content(want), text


def test_title_search_reads_candidates_only(spark, tmp_path):
    titles = [(i, "Rare Zebra" if i == 700 else f"Plain {i % 7}") for i in range(1000)]
    art = spark.createDataFrame(titles, "artifact_id bigint, title string")
    art = art.select(*[F.col(f.name) if f.name in art.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.ARTIFACT])
    store = create(from_rows(spark, {}).with_tables(artifact=art), str(tmp_path / "s"), ["artifact"], width=50, index_titles=True)
    found = search.find_titles(store, "zebra")
    assert [f.split("key_range=")[1].split("/")[0] for f in found.inputFiles()] == ["14"]
    assert [r.artifact_id for r in found.collect()] == [700]
    plan = search.title_candidates(store, ["zeb"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,zeb)" in plan
