"""Near duplicates by MinHash with sequential Bayesian verification.

A document's set holds its distinct word shingles.  Documents with equal sets
form one class, which a representative stands for.  Classes whose signatures
agree in a band are candidates.  A pair's signatures are compared batch by
batch, and the pair is dropped as soon as the posterior probability of a
similarity at the threshold falls below ``MISS``; survivors are verified on
their full sets.

Only links that can join components matter, so a band's bucket is not turned
into all its pairs.  First, in the first ``FIRST`` bands, its members are compared
with its least one, at most that many pairs a document.  Of what then remains in different components, blocks of a
bucket's members meet in pairs, so no task holds a whole bucket; members in
its most frequent component meet the others only.  Their signatures meet first;
members that have a survivor then meet with their full sets, and each pair of
survivors is verified where it meets: no row is made of it.  A block gives back
a forest of its links, one fewer than the components in it at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm.common import values_of
from vitrine.llm.components import connected_components

BANDS, ROWS = 24, 4       # at similarity 0.8 a pair shares no band with probability 3e-6
FIRST = 4                 # bands in which members are compared with their bucket's least one
BATCH = 16                # signature places compared at a time
MISS = 1e-6               # posterior probability below which a pair is dropped
BLOCK = 512               # members of a bucket that meet at a time
BLOCK_SHINGLES = 1 << 20  # fewer of them where their sets hold more than this together
COLUMNS = 1 << 13         # shingles that a block's sets are compared in at a time
FORESTS = 1               # forests of links that a block gives back: one joins what its links join
MOST_FORESTS = 32         # more are not told apart
SHINGLES_PER_TASK = 50_000
PAIRS_PER_TASK = 64
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: A-Z lower-cased,
    words by ASCII white space.  With fewer words the whole sequence is one
    shingle; without words there are none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(h))], np.uint64)
    n = len(h) - size + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed += h[i:i + n] * _MIX[i % len(_MIX)] + np.uint64(i // len(_MIX))
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed)


def signature(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each of the linear permutations, in blocks that fit a cache."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        out = np.minimum(out, (factors[:, None] * low[None, i:i + 512] + shifts[:, None]).min(axis=1))
    return out


def fewest_matches(threshold: float, places: int, miss: float) -> int:
    """Fewest matches of ``places`` for which a similarity of ``threshold`` or
    more keeps a posterior probability of ``miss`` (uniform prior)."""
    total = 0.0
    for m in range(places + 1):
        total += comb(places + 1, m) * threshold ** m * (1 - threshold) ** (places + 1 - m)
        if total >= miss:
            return m
    return places


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """The bucket of each band, a row for each signature."""
    quads = sigs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0]
    for r in range(ROWS):
        key = (key ^ quads[:, :, r]) * _MIX[1]
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """(_id, n, set_hash, sig, bands) of every row (_id, _text) with words; (_id, 0) else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.RandomState(7)
        factors = rng.randint(0, 2 ** 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        shifts = rng.randint(0, 2 ** 31, BANDS * ROWS).astype(np.uint32)
        for batch in batches:
            n, digest, sigs, bands = [], [], [], []
            for text, in values_of(batch, "_text"):
                hashes = shingle_hashes(text, size)
                n.append(len(hashes))
                if not len(hashes):
                    digest.append(None), sigs.append(None), bands.append(None)
                    continue
                sig = signature(hashes, factors, shifts)
                digest.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sigs.append(sig.tobytes())
                bands.append(band_keys(sig)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["_id", "n", "set_hash", "sig", "bands"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(C.tidy(run), f"_id {kind}, n long, set_hash binary, sig binary, bands array<long>")


def likely_pairs(pairs: DataFrame, sigs: DataFrame, n_pairs: int, threshold: float, scratch: C.Scratch) -> DataFrame:
    """The pairs (u, v, n_v) whose signatures leave them a chance."""
    needed = [(p, fewest_matches(threshold, p, MISS)) for p in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
                    for c in (batch.column(2), batch.column(3)))
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for places, least in needed:
                matches[alive] += (a[alive, done:places] == b[alive, done:places]).sum(1)
                alive, done = alive[matches[alive] >= least], places
            yield batch.select(["u", "v", "n_v"]).take(pa.array(alive))

    hubs = pairs.groupBy("u").agg(F.count("*").alias("degree"))
    left = sigs.select(F.col("_id").alias("u"), F.col("sig").alias("sig_u")).join(hubs, "u")
    right = sigs.select(F.col("_id").alias("v"), F.col("sig").alias("sig_v"))
    both = C.join_hot(pairs.select("u", "v", "n_v").join(right, "v"), scratch.table(left), "u", "degree", n_pairs)
    kind = dict(pairs.dtypes)["u"]
    return both.select("u", "v", "sig_u", "sig_v", "n_v").mapInArrow(C.tidy(run), f"u {kind}, v {kind}, n_v long")


def survivors_of(a: dict, b: dict | None, needed: list[tuple[int, int]], band: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs between two blocks, or within one (``b`` None), of a bucket of
    ``band`` that lie in different components and keep a chance.  A pair that
    shares an earlier band is met in that band's bucket."""
    other = a if b is None else b
    i, j = np.nonzero(a["label"][:, None] != other["label"][None, :])
    if b is None:
        i, j = i[i < j], j[i < j]
    keep_i, keep_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(i), 1 << 16):
        p, q = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        near = a["scale"] * np.minimum(a["n"][p], other["n"][q]) >= np.maximum(a["n"][p], other["n"][q])
        p, q = p[near], q[near]
        matches, done = np.zeros(len(p), np.int64), 0
        for places, least in needed:
            matches = matches + (a["sig"][p, done:places] == other["sig"][q, done:places]).sum(1)
            alive = matches >= least
            p, q, matches, done = p[alive], q[alive], matches[alive], places
        earlier = (a["sig"][p, :band * ROWS] == other["sig"][q, :band * ROWS]).reshape(len(p), band, ROWS).all(2).any(1)
        keep_i.append(p[~earlier]), keep_j.append(q[~earlier])
    return np.concatenate(keep_i), np.concatenate(keep_j)


def forests(ends: list[tuple], count: int) -> tuple[list[int], bool]:
    """Positions in ``ends`` (pairs of components, the likeliest first) of ``count``
    forests that share no position, each of the first that join what the forest
    has not joined, and whether positions are left over.  Beyond ``MOST_FORESTS`` all."""
    taken, rest = [], list(range(len(ends)))
    if count > MOST_FORESTS:
        return rest, False
    for _ in range(count):
        if not rest:
            break
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        over = []
        for k in rest:
            x, y = root(ends[k][0]), root(ends[k][1])
            if x == y:
                over.append(k)
            else:
                parent[x] = y
                taken.append(k)
        rest = over
    return taken, bool(rest)


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Elements that the sets ``i`` and ``j`` (positions in ``sets``) share, pair by
    pair: a bit for each set and element, ``COLUMNS`` elements at a time.  Elements
    of one set only have no bit."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros(len(i), np.int64)
    for start in range(0, int(shared.sum()), COLUMNS):
        some = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        bits = np.zeros((len(sets), COLUMNS), bool)
        bits[owner[some], column[some] - start] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for at in range(0, len(i), 1 << 12):
            p, q = i[at:at + (1 << 12)], j[at:at + (1 << 12)]
            both[at:at + (1 << 12)] += np.bitwise_count(words[p] & words[q]).sum(1, dtype=np.int64)
    return both


def block_tasks(rows: DataFrame) -> DataFrame:
    """The pairs of blocks (key, lo, hi) in which members meet, from bucket rows
    (key, _id, n, label, bulk, size, others, shingles, other_shingles): ``bulk`` marks
    members in the bucket's most frequent component, of which there are size - others."""
    def blocks(members: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    one_block = blocks(F.col("size"), F.col("shingles")) == 1
    p_blocks = F.when(one_block, 1).otherwise(blocks(F.col("others"), F.col("other_shingles")))
    b_blocks = F.when(one_block, 0).otherwise(blocks(F.col("size") - F.col("others"), F.col("shingles") - F.col("other_shingles")))
    bulk = F.col("bulk") & ~one_block
    rows = rows.withColumn("pb", p_blocks).withColumn("bb", b_blocks).withColumn("bulk", bulk)
    # Blocks 0 .. pb - 1 hold the others, pb .. pb + bb - 1 the bulk; two blocks of the bulk never meet.
    own = F.when(F.col("bulk"), F.col("pb") + F.pmod(F.xxhash64("_id"), F.greatest("bb", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("_id"), F.greatest("pb", F.lit(1)))).cast("int")
    met = F.explode(F.when(F.col("bulk"), F.sequence(F.lit(0), F.col("pb") - 1)).otherwise(F.sequence(F.lit(0), F.col("pb") + F.col("bb") - 1)))
    return rows.withColumn("own", own).withColumn("met", met).select(
        "key", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), "own", "_id", "n", "label")


def each_block(rows: DataFrame, columns: tuple[str, ...], settle: Callable[[list[tuple]], list[tuple]], out: str) -> DataFrame:
    """What ``settle`` makes of the rows (own, _id, n, label, sig, ...), with their
    (key, lo, hi) before them, of each block that meets itself or another.  ``out``
    names its columns; those without a type are ids."""
    kind = dict(rows.dtypes)["_id"]
    names = [c.split() for c in out.split(", ")]
    own_types = {"long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        like = None

        def emit(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, own_types[c[1]] if c[1:] else like) for c, values in zip(names, zip(*found))],
                                              [c[0] for c in names])

        for batch in batches:
            found, like = [], batch.schema.field("_id").type
            for row in values_of(batch, "key", "lo", "hi", *columns):
                if group and group[0][:3] != row[:3]:
                    found += settle(group)
                    group = []
                group.append(row)
            if found:
                yield emit(found)
        if group and (found := settle(group)):
            yield emit(found)

    return (rows.select("key", "lo", "hi", *columns).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(C.tidy(run), ", ".join(" ".join(c) if c[1:] else f"{c[0]} {kind}" for c in names)))


def met_in(group: list[tuple], percent: int, needed: list[tuple[int, int]]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """A block's rows, those of ``lo`` first, and the positions of its survivors."""
    key, lo, hi = group[0][:3]
    first, second = [g for g in group if g[3] == lo], [g for g in group if g[3] != lo]
    members = first + second
    if not first or (lo != hi and not second):
        return members, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def block(some: list[tuple]) -> dict:
        return {"n": np.array([g[5] for g in some]), "label": np.array([g[6] for g in some]), "scale": 100 / percent,
                "sig": np.frombuffer(b"".join(g[7] for g in some), np.uint32).reshape(len(some), -1)}

    a = block(first)
    band = int(np.flatnonzero((band_keys(a["sig"]) == key).any(0))[0])
    if lo == hi:
        i, j = survivors_of(a, None, needed, band)
        return members, i, j
    i, j = survivors_of(a, block(second), needed, band)
    return members, i, j + len(first)


def block_survivors(rows: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Of task rows (key, lo, hi, own, _id, n, label), those that have a survivor in
    a different component in their block."""
    needed = [(p, fewest_matches(percent / 100, p, MISS)) for p in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def settle(group: list[tuple]) -> list[tuple]:
        members, i, j = met_in(group, percent, needed)
        return list(dict.fromkeys(members[k][:7] for k in np.union1d(i, j)))

    return each_block(rows.join(sigs.select("_id", "n", "sig"), ["_id", "n"]), ("own", "_id", "n", "label", "sig"), settle,
                      "key long, lo int, hi int, own int, _id, n long, label")


def block_links(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """A forest (u, v) of each block's links between different components, from the
    rows of :func:`block_survivors` and ``full`` (_id, n, sig, hashes)."""
    needed = [(p, fewest_matches(percent / 100, p, MISS)) for p in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def settle(group: list[tuple]) -> list[tuple]:
        members, i, j = met_in(group, percent, needed)
        if not len(i):
            return []
        sets = [np.frombuffer(g[8], np.uint64) for g in members]
        both, n = overlaps(sets, i, j), np.array([len(x) for x in sets])
        linked = (both > 0) & (100 * both >= percent * (n[i] + n[j] - both))
        i, j = i[linked].tolist(), j[linked].tolist()
        taken, _ = forests([(members[p][6], members[q][6]) for p, q in zip(i, j)], FORESTS)
        return [(members[i[k]][4], members[j[k]][4]) for k in taken]

    return each_block(rows.join(full, ["_id", "n"]), ("own", "_id", "n", "label", "sig", "hashes"), settle, "u, v")


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """(_id, set_hash, hashes) of rows (_id, _text) with words, once for each id and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digest, sets = [], [], []
            for i, text in values_of(batch, "_id", "_text"):
                hashes = shingle_hashes(text, size).tobytes()
                if hashes:
                    ids.append(i), digest.append(hashlib.blake2b(hashes, digest_size=16).digest()), sets.append(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("_id").type), pa.array(digest, pa.binary()),
                                              pa.array(sets, pa.binary())], ["_id", "set_hash", "hashes"])

    kind = dict(rows.dtypes)["_id"]
    return rows.select("_id", "_text").mapInArrow(C.tidy(run), f"_id {kind}, set_hash binary, hashes binary").dropDuplicates(["_id", "set_hash"])


def rows_of(rows: DataFrame, named: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The rows whose _id is in ``named``."""
    ids = scratch.table(named.select("_id").distinct())
    return C.only(rows, "_id", ids, ids.count())


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, scratch: C.Scratch) -> DataFrame:
    """The pairs (u, v, n_v) whose full sets overlap enough.  A centre's pairs
    are dealt to tasks by the size of their sets; each task reads the centre's text,
    then its partners one by one."""
    kind = dict(pairs.dtypes)["u"]
    work = scratch.table(pairs.groupBy("u").agg(
        F.count("*").alias("degree"), F.greatest(F.ceil(F.sum("n_v") / SHINGLES_PER_TASK), F.ceil(F.count("*") / PAIRS_PER_TASK)).cast("int").alias("parts")))
    dealt = C.join_hot(pairs.select("u", "v"), work, "u", "degree", pairs.count()).select(
        "u", F.col("v").alias("_id"), F.pmod(F.xxhash64("v"), F.greatest("parts", F.lit(1))).alias("part"), F.lit(1).alias("role"))
    centres = work.select("u", F.col("u").alias("_id"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)).cast("long") - 1)).alias("part"), F.lit(0).alias("role"))
    tasks = scratch.table(dealt.unionByName(centres))
    ids = scratch.table(tasks.select("_id").distinct())
    texts = C.only(docs, "_id", ids, ids.count())
    rows = tasks.join(texts, "_id").repartition("u", "part").sortWithinPartitions("u", "part", "role", "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, []
        for batch in batches:
            us, vs = [], []
            for u, v, role, text in values_of(batch, "u", "_id", "role", "_text"):
                hashes = shingle_hashes(text, size)
                if role == 0:
                    own = [*own, hashes] if centre == u else [hashes]
                    centre = u
                    continue
                for mine in own:
                    both = len(np.intersect1d(mine, hashes, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(hashes) - both) and both:
                        us.append(u), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, batch.schema.field("u").type), pa.array(vs, batch.schema.field("u").type)], ["u", "v"])

    return rows.select("u", "_id", "role", "_text").mapInArrow(C.tidy(run), f"u {kind}, v {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id that links reach, and the
    document of that id is kept.  Null and empty texts and those without words
    have an empty set and are linked with nothing.  Rows that repeat an id are
    one document.  A row with a null id is linked with nothing, has a null
    component and is kept.  An empty table gives no rows; other columns are not
    read."""
    with C.Scratch(docs.sparkSession) as scratch:
        threshold = percent / 100
        docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        sets = scratch.table(signatures(docs, size))
        total = sets.count()
        in_use = sets.filter("n > 0 AND _id IS NOT NULL")
        classes = scratch.table(in_use.groupBy("set_hash").agg(F.min("_id").alias("rep"), F.count("*").alias("members")))
        several = classes.filter("members > 1")
        spare = scratch.table(C.join_hot(in_use.select("_id", "set_hash"), several, "set_hash", "members", total)
                              .filter("_id <> rep").select("_id").distinct())
        reps = C.without(in_use.select("_id", "n", "set_hash", "sig", "bands"), "_id", spare, spare.count())
        rows = reps.select(F.posexplode("bands").alias("band", "key"), "_id", "n").distinct()
        buckets = rows.groupBy("key").agg(F.min(F.struct("_id", "n")).alias("centre"), F.count("*").alias("size")).filter("size > 1")
        buckets = scratch.table(buckets.select("key", F.col("centre._id").alias("u"), F.col("centre.n").alias("n_u"), "size"))
        open_rows = scratch.table(C.join_hot(rows, buckets, "key", "size", total * BANDS))
        pairs = open_rows.filter(F.col("band") < FIRST).select("u", F.col("_id").alias("v"), "n_u", F.col("n").alias("n_v"))
        open_rows = open_rows.filter((F.col("band") >= FIRST) | (F.col("_id") != F.col("u"))).select("key", "_id", "n")
        fits = (F.col("u") != F.col("v")) & (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
        pairs = scratch.table(pairs.filter(fits).select("u", "v", "n_v").distinct())
        n_pairs = pairs.count()
        links, labels = None, None
        if n_pairs:
            ids = scratch.table(pairs.select(F.explode(F.array("u", "v")).alias("_id")).distinct())
            sigs = scratch.table(C.only(reps.select("_id", "sig"), "_id", ids, ids.count()).distinct())
            chance = scratch.table(likely_pairs(pairs, sigs, n_pairs, threshold, scratch))
            links = scratch.table(verified(chance, docs, size, percent, scratch))
            labels = scratch.table(connected_components(links, scratch))
        # What is left: members of a bucket, other than the least where it is done, in different components.
        labelled = (open_rows.withColumn("label", F.col("_id")) if labels is None else
                    open_rows.join(labels.withColumnRenamed("id", "_id"), "_id", "left")
                    .select("key", "_id", "n", F.coalesce("component", "_id").alias("label")))
        labelled = scratch.table(labelled)
        per_label = labelled.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"))
        mixed = scratch.table(per_label.groupBy("key").agg(
            F.sum("c").alias("size"), F.sum("shingles").alias("shingles"), F.max(F.struct("c", "label", "shingles")).alias("most"),
            F.count("*").alias("labels")).filter("labels > 1").select(
            "key", "size", "shingles", F.col("most.label").alias("most"), (F.col("size") - F.col("most.c")).alias("others"),
            (F.col("shingles") - F.col("most.shingles")).alias("other_shingles")))
        if mixed.count():
            left = C.join_hot(labelled, mixed, "key", "size", labelled.count()).withColumn("bulk", F.col("label") == F.col("most"))
            tasks = scratch.table(block_tasks(left))
            sigs = scratch.table(rows_of(reps.select("_id", "n", "set_hash", "sig"), tasks, scratch).distinct())
            near = scratch.table(block_survivors(tasks, sigs, percent))
            full = scratch.table(full_sets(rows_of(docs, near, scratch), size).join(sigs, ["_id", "set_hash"]).drop("set_hash"))
            fresh = scratch.table(block_links(near, full, percent))
            if fresh.count():
                links = fresh if links is None else links.unionByName(fresh)
                labels = scratch.table(connected_components(links, scratch))
        if labels is not None:
            classes = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
                "set_hash", F.coalesce("component", "rep").alias("component_id"), "members")
        else:
            classes = classes.select("set_hash", F.col("rep").alias("component_id"), "members")
        narrow = sets.select("_id", "n", "set_hash")
        grouped = C.join_hot(narrow.filter("n > 0 AND _id IS NOT NULL"), scratch.table(classes), "set_hash", "members", total)
        alone = narrow.filter("n = 0 OR _id IS NULL").select("_id", "n", F.col("_id").alias("component_id"))
        return grouped.select("_id", "n", "component_id").unionByName(alone).select(
            F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
            F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")).checkpoint()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their
    columns; of rows that repeat an id, one.  Rows with a null id all stay."""
    found = near_duplicates(docs, id_col, text_col, size, percent).select(F.col(id_col).alias("_id"), "kept")
    gone = found.filter("NOT kept").select("_id").distinct().checkpoint()
    again = found.filter("kept AND _id IS NOT NULL").groupBy("_id").count().filter("count > 1").select("_id").checkpoint()
    kept = C.without(docs.select(F.col(id_col).alias("_id"), F.struct("*").alias("_row")), "_id", gone, gone.count())
    n = again.count()
    if n:
        kept = C.without(kept, "_id", again, n).unionByName(C.only(kept, "_id", again, n).dropDuplicates(["_id"]))
    return kept.select("_row.*")
