"""Near-duplicate embeddings by randomised-rotation binary codes.

Every unit vector is rotated at random into a longer space; the signs of its
coordinates are its code, and the inner product of the vector with its code its
stored correction factor.  The product of one vector's code with another
rotated vector, divided by the factor, estimates their cosine without bias; its
confidence bound decides which pairs are recomputed exactly, in double precision.

Bands of code bits deal vectors to buckets.  Their width grows with the
logarithm of the number of vectors and their number follows from ``MISS``, the
chance that a pair at the threshold shares no band.  A bucket larger than a
block is split, and blocks meet in pairs, so no task holds a whole bucket.  A
pair counts only in the first band that it shares.  Blocks return counts and a
spanning forest of their links, never all pairs.  Equal vectors form one class
with a weight.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import common as C
from vitrine.llm.common import values_of
from vitrine.llm.components import connected_components

THRESHOLD = 0.9
MISS = 0.002        # a pair at the threshold shares no band
MIN_ROWS = 12       # bits of a band
BUCKET = 64         # expected vectors that share a band by chance, at most
DEVIATIONS = 5.0    # of the estimate's confidence bound
BLOCK = 1024        # vectors of a bucket that meet at a time


def plan_bands(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, bands) for ``n`` vectors."""
    rows = max(MIN_ROWS, math.ceil(math.log2(max(n, 2) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** rows
    return rows, math.ceil(math.log(miss) / math.log1p(-agree))


def rotation(dim: int, length: int) -> np.ndarray:
    """``length`` x ``dim`` with orthonormal columns, drawn at random from a fixed seed."""
    q, r = np.linalg.qr(np.random.RandomState(dim).standard_normal((max(length, dim), dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, signs as +-1, correction factors)."""
    rotated = units.astype(np.float32) @ turn.T
    signs = np.where(rotated >= 0, np.float32(1), np.float32(-1))
    return rotated, signs, (rotated * signs).sum(1) / math.sqrt(turn.shape[0])


def band_keys(signs: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The bits of each band as a number."""
    bits = (signs[:, :rows * bands] > 0).reshape(-1, bands, rows)
    return bits @ (1 << np.arange(rows, dtype=np.int64))


def block_links(mine: dict, other: dict | None, band: int, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of links between two blocks, or within one (``other`` None)
    that share ``band`` first."""
    b = mine if other is None else other
    length = turn.shape[0]
    factor = np.maximum(mine["factor"], 1e-6)
    estimate = (mine["signs"] @ b["rotated"].T) / (factor * math.sqrt(length))[:, None]
    bound = DEVIATIONS * np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(max(length - 1, 1))
    i, j = np.nonzero(estimate >= (threshold - bound)[:, None])
    if other is None:
        i, j = i[i < j], j[i < j]
    keep_i, keep_j = [], []
    for at in range(0, len(i), 65536):
        p, q = i[at:at + 65536], j[at:at + 65536]
        linked = np.einsum("ij,ij->i", mine["units"][p], b["units"][q]) >= threshold
        p, q = p[linked], q[linked]
        same = mine["keys"][p] == b["keys"][q]
        first = same.argmax(1) == band
        keep_i.append(p[first]), keep_j.append(q[first])
    return (np.concatenate(keep_i), np.concatenate(keep_j)) if keep_i else (np.zeros(0, int), np.zeros(0, int))


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id of each row's part under the links (i, j)."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            return root


def width_of(vectors: DataFrame, vec_col: str) -> int:
    """Bytes of a component: single precision stays so in shuffles."""
    return 4 if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else 8


def units_of(raw: list[bytes], width: int) -> np.ndarray:
    """Unit vectors in double precision from vectors of one length."""
    v = np.frombuffer(b"".join(raw), f"f{width}").reshape(len(raw), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def classes(vectors: DataFrame, id_col: str, vec_col: str, width: int) -> DataFrame:
    """(_id, digest, vec) with the vector's bytes; null digest for a vector that
    links with nothing."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast(f"array<{'float' if width == 4 else 'double'}>").alias("_vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, raw = [], []
            for vec, in values_of(batch, "_vec"):
                v = np.array(vec if vec and None not in vec else [], f"f{width}")
                if v.size and np.isfinite(v).all() and v.any():
                    v = (v + 0.0).tobytes()  # -0.0 is 0.0
                    digests.append(hashlib.blake2b(v, digest_size=16).digest()), raw.append(v)
                else:
                    digests.append(None), raw.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["_id", "digest", "vec"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, digest binary, vec binary")


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: the id, n_links, component_id, kept.

    Two vectors are linked if their cosine in double precision is ``threshold``
    or more; a pair at the threshold itself is missed with probability ``MISS``,
    nearer ones more rarely.  n_links counts the other vectors linked directly,
    component_id is the smallest id that links reach, and the vector of that id
    is kept.  Null, empty and zero vectors, those with null or non-finite
    components, and those with a null id link with nothing; so do vectors of
    different lengths.  Ids are integers.  Each row that repeats an id counts as a vector of its own
    in n_links.  An empty table gives no rows."""
    with C.Scratch(vectors.sparkSession) as scratch:
        width = width_of(vectors, vec_col)
        known = scratch.table(classes(vectors, id_col, vec_col, width))
        total = known.count()
        kind = dict(known.dtypes)["_id"]
        usable = known.filter("digest IS NOT NULL AND _id IS NOT NULL")
        reps = scratch.table(usable.groupBy("digest").agg(F.min("_id").alias("rep"), F.count("*").alias("members"), F.first("vec").alias("vec")))
        rows, bands = plan_bands(reps.count(), threshold)
        length = rows * bands

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns: dict[int, np.ndarray] = {}
            for batch in batches:
                out = []
                for vec, in values_of(batch, "vec"):
                    v = units_of([vec], width)
                    if v.shape[1] not in turns:
                        turns[v.shape[1]] = rotation(v.shape[1], length)
                    out.append(band_keys(encode(v, turns[v.shape[1]])[1], rows, bands)[0])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

        coded = scratch.table(reps.select("rep", "members", "vec").mapInArrow(keys, f"rep {kind}, members long, vec binary, keys array<long>"))
        dim = F.octet_length("vec")
        spread = coded.select("rep", dim.alias("dim"), F.posexplode("keys").alias("band", "key"))
        sizes = spread.groupBy("dim", "band", "key").agg(F.count("*").alias("size")).filter("size > 1")
        bucket = F.struct("dim", "band", "key")
        sizes = scratch.table(sizes.select(bucket.alias("bucket"), "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
        placed = C.join_hot(spread.withColumn("bucket", bucket).drop("dim", "key"), sizes, "bucket", "size", total * bands)
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        placed = placed.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.select(F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), "own", "band",
                               F.col("bucket.dim").alias("dim"), F.col("bucket.key").alias("key"), "rep")
        members = placed.join(coded.select("rep", "members", "vec"), "rep").withColumn("task", F.xxhash64("dim", "band", "key", "lo", "hi"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns: dict[int, np.ndarray] = {}

            def settle(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
                dim = len(group[0][4]) // width
                if dim not in turns:
                    turns[dim] = rotation(dim, length)
                parts = []
                for block in sorted({g[1] for g in group}):
                    some = [g for g in group if g[1] == block]
                    units = units_of([g[4] for g in some], width)
                    rotated, signs, factor = encode(units, turns[dim])
                    parts.append({"ids": np.array([g[2] for g in some]), "weight": np.array([g[3] for g in some], np.int64), "units": units,
                                  "rotated": rotated, "signs": signs, "factor": factor, "keys": band_keys(signs, rows, bands)})
                (_, lo, hi, band, _), first = group[0][0], parts[0]
                if lo != hi and len(parts) < 2:
                    return None
                i, j = block_links(first, parts[1] if lo != hi else None, band, turns[dim], threshold)
                if not len(i):
                    return None
                ids = np.concatenate([p["ids"] for p in parts])
                weight = np.concatenate([p["weight"] for p in parts])
                if lo != hi:
                    j = j + len(first["ids"])
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                root = forest(ids, i, j)
                hit = links > 0
                return ids[hit], links[hit], root[hit]

            def emit(found, like) -> pa.RecordBatch:
                ids, links, root = (np.concatenate(c) for c in zip(*found))
                return pa.RecordBatch.from_arrays([pa.array(ids, like), pa.array(links, pa.int64()), pa.array(root, like)], ["rep", "links", "root"])

            group: list[tuple] = []
            for batch in batches:
                found = []
                like = batch.schema.field("rep").type
                for task, lo, hi, own, band, key, rep, n, vec in values_of(batch, "task", "lo", "hi", "own", "band", "key", "rep", "members", "vec"):
                    at = (task, lo, hi, band, (key, len(vec)))
                    if group and group[0][0] != at:
                        if len(group) > 1 and (settled := settle(group)):
                            found.append(settled)
                        group = []
                    group.append((at, own, rep, n, vec))
                if found:
                    yield emit(found, like)
            if len(group) > 1 and (settled := settle(group)):
                yield emit([settled], like)

        linked = scratch.table(members.repartition("task").sortWithinPartitions("task", "lo", "hi", "band", "key", "dim")
                               .mapInArrow(compare, f"rep {kind}, links long, root {kind}"))
        counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
        labels = connected_components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
        final = (reps.select("digest", "rep", "members").join(counts, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
                 .select("digest", "members", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id")))
        grouped = C.join_hot(usable.select("_id", "digest"), scratch.table(final), "digest", "members", total)
        alone = known.filter("digest IS NULL OR _id IS NULL").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
        return grouped.select("_id", "n_links", "component_id").unionByName(alone).select(
            F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")).checkpoint()
