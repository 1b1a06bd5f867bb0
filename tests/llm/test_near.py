import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm import embedding, minhash
from vitrine.llm.components import connected_components
from tests.llm import messy


@pytest.fixture(autouse=True)
def ready(spark):
    C.prepare(spark)


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {"path": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 200)] + [(500, 501)],
             "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]}[shape]
    want = Union({x for e in links for x in e})
    for a, b in links:
        want.join(a, b)
    with C.Scratch(spark) as scratch:
        got = dict(map(tuple, connected_components(spark.createDataFrame(links, "u long, v long"), scratch).collect()))
    assert got == {i: want.find(i) for i in {x for a, b in links if a != b for x in (a, b)}}


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def near_brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    found = Union(sets)
    ids = [i for i in sets if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * len(sets[i] | sets[j]):
                found.join(i, j)
    return {i: (len(sets[i]), found.find(i), found.find(i) == i) for i in sets}


def near_rows(seed=1):
    """Chains of ever more edited copies, exact copies, short texts, shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, i = [], 0
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        if rng.random() < 0.5:
            words = passage + words
        for _ in range(rng.randint(1, 7)):
            rows.append((i, " ".join(words)))
            i += rng.randint(1, 3)
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rng.shuffle(rows)
    return rows + [(9000, "One two"), (9001, "one  TWO"), (9002, ""), (9003, None), (9004, "a b c d"), (9005, "A b c d"), (9006, "  ")]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_all_pairs(spark, size):
    rows = near_rows(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(docs, size=size).collect()}
    assert got == near_brute(rows, size, 80)


def test_large_group_of_near_copies(spark):
    """All in many buckets together; far fewer comparisons than pairs."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_near_duplicates_of_awkward_rows(spark):
    got = minhash.near_duplicates(messy.table(spark)).collect()
    assert len(got) == len(messy.ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == by[10].component_id == 1 and by[7].component_id == 6
    assert all(by[i].kept and by[i].n_shingles == 0 for i in (3, 4, 5)) and by[8].component_id == by[9].component_id == 8
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(messy.empty(spark)).count() == 0


def test_keep_one(spark):
    kept = minhash.keep_one(messy.table(spark))
    assert kept.columns == list(messy.SCHEMA.fieldNames())
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 11: 1, 12: 1, None: 2})


def test_pruning_bounds():
    for places in (16, 32, 96):
        least = minhash.fewest_matches(0.8, places, 1e-6)
        tail = [sum(math.comb(places + 1, k) * 0.8 ** k * 0.2 ** (places + 1 - k) for k in range(m + 1)) for m in (least, least - 1)]
        assert tail[0] >= 1e-6 and (least == 0 or tail[1] < 1e-6)


def near_vectors(seed=0):
    rng = np.random.RandomState(seed)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(24)
        for _ in range(rng.randint(1, 12)):
            rows.append(centre + rng.standard_normal(24) * np.linalg.norm(centre) / math.sqrt(24) * rng.choice([0.1, 0.3, 0.5]))
    rows += [rows[0], rows[0], rows[3] * 7]
    return [(int(i) * 2 + 1, [float(x) for x in np.asarray(v)]) for i, v in enumerate(rows)]


def test_embeddings_against_all_pairs(spark):
    rows = near_vectors()
    odd = [(1001, None), (1002, []), (1003, [0.0] * 24), (1004, [float("nan")] + [1.0] * 23), (1005, [None] + [1.0] * 23),
           (1006, [float("inf")] + [1.0] * 23), (1007, [1.0, 2.0]), (1008, [2.0, 4.0]), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, "c") for i, v in rows + odd], "vec_id long, embedding array<double>, kept string")
    got = embedding.near_embeddings(table).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    linked = units @ units.T >= 0.9
    np.fill_diagonal(linked, False)
    ids = [i for i, _ in rows]
    found = Union(ids)
    for a, b in zip(*np.nonzero(linked)):
        found.join(ids[a], ids[b])
    right = sum(by[i] == (int(linked[k].sum()), found.find(i), found.find(i) == i) for k, i in enumerate(ids))
    assert right >= 0.98 * len(ids)
    assert all(by[i][0] <= linked[k].sum() for k, i in enumerate(ids)), "no link below the threshold"
    assert all(by[i] == (0, i, True) for i in (1001, 1002, 1003, 1004, 1005, 1006))
    assert by[1007] == (1, 1007, True) and by[1008] == (1, 1007, False) and by[None] == (0, None, True)
    assert len(got) == len(rows) + len(odd)
    assert embedding.near_embeddings(table.limit(0)).count() == 0


def test_blocks_of_a_hot_bucket(spark):
    """More near copies than a block holds: blocks meet in pairs, and every link counts once."""
    rng = np.random.RandomState(4)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + rng.standard_normal(16) * 0.01]) for i in range(1500)]
    got = embedding.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).collect() == [(1499, 1499, 0)]


def test_estimates_are_unbiased():
    rng = np.random.RandomState(1)
    units = rng.standard_normal((400, 32))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rotated, signs, factor = embedding.encode(units, embedding.rotation(32, 384))
    estimate = signs @ rotated.T / (factor * math.sqrt(384))[:, None]
    off = ~np.eye(400, dtype=bool)
    assert abs((estimate - units @ units.T)[off].mean()) < 2e-3 and np.allclose(np.diag(estimate), 1, atol=1e-4)


def test_recall_at_the_threshold():
    for n in (1000, 50_000, 10 ** 8):
        rows, bands = embedding.plan_bands(n)
        agree = (1 - math.acos(0.9) / math.pi) ** rows
        assert (1 - agree) ** bands <= embedding.MISS


def test_survivors_grow_with_the_members(spark, monkeypatch):
    """Near copies that the first bands leave apart: blocks give back a few forests, not their pairs."""
    counts = []
    real = minhash.block_survivors

    def watched(rows, *args):
        found = real(rows, *args).cache()
        counts.append((found.count(), rows.count()))
        return found

    monkeypatch.setattr(minhash, "block_survivors", watched)
    monkeypatch.setattr(minhash, "FIRST", 0)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.randrange(150)] = f"x{i}y{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(docs, size=4).collect()}
    assert got == near_brute(rows, 4, 80)
    assert counts and all(n <= (minhash.FORESTS + 1) * members for n, members in counts)


@pytest.mark.parametrize("count", [1, 2, 3, 100])
def test_forests(count):
    rng = random.Random(count)
    ends = [(rng.randrange(12), rng.randrange(12, 24)) for _ in range(200)]
    taken, more = minhash.forests(ends, count)
    assert len(set(taken)) == len(taken) and more == (len(taken) < len(ends))
    assert len(taken) <= count * 23 or count > minhash.MOST_FORESTS
    one, _ = minhash.forests(ends, 1)

    def joined(some):
        parent = list(range(24))
        for k in some:
            a, b = ends[k]
            parent = [parent[b] if p == parent[a] else p for p in parent]
        return len(set(parent))

    assert joined(one) == joined(range(200))


def edited_copies(count, words, edits, seed):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(count):
        mine = list(base)
        for _ in range(rng.choice(edits)):
            mine[rng.randrange(words)] = f"x{i}y{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(mine)))
    return rows


def test_near_copies_under_the_threshold_make_no_rows_of_pairs(spark, monkeypatch):
    """Pairs at about 0.7, which signatures cannot tell from 0.8: rows grow with the members, not their pairs."""
    counts = []
    real = minhash.verified

    def watched(pairs, *args):
        counts.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(minhash, "verified", watched)
    rows = edited_copies(200, 150, [1, 4, 5, 6], 5)
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == near_brute(rows, 4, 80)
    assert sum(counts) <= minhash.FIRST * len(rows)


@pytest.mark.parametrize("shingles", [1 << 20, 3000])
def test_links_between_blocks(spark, monkeypatch, shingles):
    """Buckets of several blocks, cut by members or by the size of their sets, and sets compared in several parts."""
    monkeypatch.setattr(minhash, "FIRST", 1)
    monkeypatch.setattr(minhash, "BLOCK", 25 if shingles > 3000 else 512)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    rows = edited_copies(120, 150, [2, 3, 4, 5], 6)
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == near_brute(rows, 4, 80)


def test_overlaps_are_exact():
    rng = np.random.RandomState(3)
    sets = [np.unique(rng.randint(0, 5000, rng.randint(1, 3000)).astype(np.uint64) << np.uint64(40)) for _ in range(20)] + [np.zeros(0, np.uint64)]
    i, j = np.nonzero(np.ones((21, 21), bool))
    assert minhash.overlaps(sets, i, j)[i != j].tolist() == [len(np.intersect1d(sets[p], sets[q])) for p, q in zip(i, j) if p != q]
    disjoint = [np.arange(3, dtype=np.uint64), np.arange(3, 6, dtype=np.uint64)]
    assert minhash.overlaps(disjoint, np.array([0]), np.array([1])).tolist() == [0]


def test_texts_of_a_repeated_id_meet_in_blocks(spark, monkeypatch):
    """An id with texts in several buckets, some of equal size: each of them links."""
    monkeypatch.setattr(minhash, "FIRST", 0)
    first, second = edited_copies(4, 120, [1], 7), edited_copies(4, 121, [1], 8)
    second = [(i, text.replace("b", "c")) for i, text in second]
    rows = [(i + 10, t) for i, t in first] + [(i + 20, t) for i, t in second] + [(5, first[0][1] + " z"), (5, second[0][1] + " z"), (5, "q" + first[1][1])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {5}
