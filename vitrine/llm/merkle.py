"""A Merkle manifest of a table, and a proof for every row.

Each row is a leaf.  The leaves of a group (a language, say) make a tree, the
roots of the trees make one more.  A node's label is the interval of leaf ranks
that it covers, so an ancestor is a node that contains a leaf's rank, and a
node's siblings cover what is left of its parent's interval.

Ranks come from a range partitioning.  Leaves then meet in buckets, the intervals
of 2^10 ranks, each of which holds ten levels of the tree whole; the buckets'
roots are the leaves of the next tier.  On the way down a bucket takes over what
lies above it, one row a bucket, and attaches the ancestors inside it.  So a leaf
moves three times whatever the height, and no bucket holds more than 1,024.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm import common as C

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT_BITS = 1             # every 2 consecutive nodes become one
BUCKET_LEVELS = 10
MAX_CHUNKS = 100_000        # chunks (trees times partitions met) that are broadcast; more are joined
MEMBERS = ("lo", "digest", "claim", "id")


def leaf(values: list[Column]) -> Column:
    """The digest of a row: '-' for a null, else the byte count, ':' and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                             for t in texts)), 256)


def digest_of(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def ranked(rows: DataFrame, order: list[str], scratch: C.Scratch) -> DataFrame:
    """``rows`` with ``lo``, the rank in its tree from 0, and ``n``, the leaves of
    the tree.  A tree of any size spans range partitions; a chunk is the part of
    a tree in one of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = scratch.table(rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
                           .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    tree = Window.partitionBy("tree")
    chunks = scratch.table(placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size")).select(
        "tree", "part", F.sum("size").over(tree).alias("n"),
        (F.coalesce(F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift")))
    side = F.broadcast(chunks) if chunks.count() <= MAX_CHUNKS else chunks
    return placed.join(side, ["tree", "part"]).withColumn("lo", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def subtree(digests: list[str], base: int, width: int, n: int) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
    """The levels of a bucket, from its children up: (lo, hi, digest) of the nodes.
    A child covers ``width`` ranks from ``base`` on, the last one of the tree up
    to ``n``.  It ends where the tree has one node, or the bucket's levels end."""
    lo = base + width * np.arange(len(digests))
    levels = [(lo, np.minimum(lo + width, n), digests)]
    for _ in range(BUCKET_LEVELS):
        if width >= n:
            break
        width <<= FANOUT_BITS
        lo, hi, below = levels[-1]
        starts = np.flatnonzero(np.diff(lo // width, prepend=-1))
        ends = np.append(starts[1:], len(lo))
        levels.append((lo[starts], hi[ends - 1], [digest_of(below[a:b]) for a, b in zip(starts, ends)]))
    return levels


def steps(levels: list[tuple[np.ndarray, np.ndarray, list[str]]]) -> list[list[tuple[str, str, int]]]:
    """For every node below the top: the digests of its siblings before and after
    it, and its parent.  The parent is the node of the next level that contains
    it; its interval without the node's own is that of the siblings."""
    out = []
    for (lo, hi, digests), (p_lo, p_hi, _) in zip(levels, levels[1:]):
        parent = np.searchsorted(p_lo, lo, "right") - 1
        first = np.searchsorted(lo, p_lo[parent], "left")
        last = np.searchsorted(hi, p_hi[parent], "right")
        out.append([("".join(digests[a:i]), "".join(digests[i + 1:b]), p)
                    for i, (a, b, p) in enumerate(zip(first.tolist(), last.tolist(), parent.tolist()))])
    return out


def members_of(column: pa.Array, r: int) -> dict[str, list]:
    values = column.slice(r, 1).flatten()
    return {name: values.field(name).to_pylist() for name in MEMBERS}


def gathered(nodes: DataFrame, tier: int) -> DataFrame:
    """One row per bucket of the tier: its children in order, 1,024 at most."""
    shift = BUCKET_LEVELS * FANOUT_BITS * (tier + 1)
    return nodes.groupBy("tree", "n", F.shiftright("lo", shift).alias("bucket")).agg(
        F.sort_array(F.collect_list(F.struct(*MEMBERS))).alias("members"))


def grow(leaves: DataFrame, scratch: C.Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of buckets over ``leaves`` (tree, lo, n, digest, claim, id), and
    the roots (tree, top)."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    tiers, roots, nodes = [], None, leaves
    while roots is None or largest > 1 << (BUCKET_LEVELS * FANOUT_BITS * len(tiers)):
        tier = len(tiers)
        width = 1 << (BUCKET_LEVELS * FANOUT_BITS * tier)

        def up(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column("n").to_pylist()
                found = [members_of(batch.column("members"), r) for r in range(batch.num_rows)]
                tops = [subtree(m["digest"], m["lo"][0], width, n)[-1] for m, n in zip(found, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tree"), batch.column("n"), pa.array([int(t[0][0]) for t in tops], pa.int64()), pa.array([t[2][0] for t in tops], pa.string())],
                    ["tree", "n", "lo", "digest"])

        tiers.append(scratch.table(gathered(nodes, tier)))
        above = scratch.table(tiers[-1].mapInArrow(up, "tree string, n long, lo long, digest string"))
        done = F.col("n") <= width << (BUCKET_LEVELS * FANOUT_BITS)
        ready = above.filter(done).select("tree", F.col("digest").alias("top"))
        roots = ready if roots is None else roots.unionByName(ready)
        nodes = above.filter(~done).withColumns({"claim": F.lit(None).cast("string"), "id": F.lit(None).cast("long")})
    return tiers, roots


def descend(tiers: list[DataFrame], tops: DataFrame, scratch: C.Scratch, id_type: str, last: bool) -> DataFrame:
    """The leaves with what lies above them.  ``tops`` (tree, before, after,
    subroot, root) has the siblings above each tree's root, level by level;
    ``last`` gives proofs instead of such lists."""
    def out_schema(tier: int) -> str:
        if tier == 0 and last:
            return f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        return "tree string, lo long, digest string, before array<string>, after array<string>, subroot string, root string"

    paths = None
    for tier in reversed(range(len(tiers))):
        width = 1 << (BUCKET_LEVELS * FANOUT_BITS * tier)
        proofs = tier == 0 and last

        def down(batches: Iterator[pa.RecordBatch], width: int = width, proofs: bool = proofs) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("members").type.value_type.field("id").type
                for r in range(batch.num_rows):
                    tree, n, before, after, subroot, root = (batch.column(c)[r].as_py() for c in ("tree", "n", "before", "after", "subroot", "root"))
                    m = members_of(batch.column("members"), r)
                    levels = subtree(m["digest"], m["lo"][0], width, n)
                    local = steps(levels)
                    over = list(zip(before, after))
                    size = len(m["digest"])
                    chains = []
                    for i in range(size):
                        chain, at = [], i
                        for level in local:
                            left, right, up = level[at]
                            chain.append((left, right))
                            at = up
                        chains.append(chain + over)
                    if not proofs:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tree] * size, pa.string()), pa.array(m["lo"], pa.int64()), pa.array(m["digest"], pa.string()),
                             pa.array([[a for a, _ in c] for c in chains], pa.list_(pa.string())),
                             pa.array([[b for _, b in c] for c in chains], pa.list_(pa.string())),
                             *(pa.array([x] * size, pa.string()) for x in (subroot, root))],
                            ["tree", "lo", "digest", "before", "after", "subroot", "root"])
                        continue
                    folded = []
                    for digest, claim, chain in zip(m["digest"], m["claim"], chains):
                        at = claim or digest
                        for left, right in chain:
                            at = digest_of([left, at, right])
                        folded.append(at)
                    proof = [digest_of([x for step in chain for x in step]) for chain in chains]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(m["id"], ids), *(pa.array(c, pa.string()) for c in (m["digest"], [subroot] * size, [root] * size, proof, folded))],
                        ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

        shift = BUCKET_LEVELS * FANOUT_BITS * (tier + 1)
        columns = ["tree", "before", "after", "subroot", "root"]
        # A tree whose root is a bucket of this tier goes on above it in ``tops``; the others in the tier above.
        ends = tiers[tier].filter(F.col("n") <= F.lit(1 << shift)).join(tops.select(*columns), "tree")
        if paths is not None:
            inner = tiers[tier].filter(F.col("n") > F.lit(1 << shift)).join(
                paths.select(*columns, F.shiftright("lo", shift).alias("bucket")), ["tree", "bucket"])
            ends = ends.unionByName(inner)
        paths = ends.mapInArrow(down, out_schema(tier))
        if tier:
            paths = scratch.table(paths)
    return paths


def proofs(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS,
           claim: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, leaf, subroot (of its tree), root,
    proof_sha256 (of its siblings from leaf to root), folded_root (the root that
    its claim and the siblings give) and verified (whether that is the root).

    The leaves of a tree ascend by id, null first, then by digest; rows that
    repeat take places one after the other.  Trees ascend by ``tree_col``, null
    first, then bytewise.  ``claim`` is a digest to be folded in place of the
    leaf where it is not null.  A table of one row is its own root and has no
    siblings; an empty table gives no rows.  Other columns are not read."""
    key = F.col(tree_col).cast("string")
    kind = dict(docs.dtypes)[id_col]
    with C.Scratch(docs.sparkSession) as scratch:
        leaves = scratch.table(docs.select(
            F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), key)).alias("tree"), F.col(id_col).alias("id"),
            leaf([F.col(c) for c in fields]).alias("digest"), (F.lit(None) if claim is None else claim).cast("string").alias("claim"),
            F.monotonically_increasing_id().alias("row")))
        tiers, roots = grow(ranked(leaves, ["id", "digest", "row"], scratch).drop("row"), scratch)
        # The trees' roots are the leaves of one more tree; its ids are not needed.
        crowns = scratch.table(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")))
        placed = scratch.table(ranked(crowns, ["name"], scratch).withColumns({"claim": F.lit(None).cast("string"), "id": F.lit(None).cast("long")}))
        upper, root = grow(placed.drop("name"), scratch)
        nothing = F.array().cast("array<string>")
        # One row: above the root there is nothing.
        crown = descend(upper, root.select("tree", nothing.alias("before"), nothing.alias("after"), F.lit(None).cast("string").alias("subroot"),
                                           F.col("top").alias("root")), scratch, "long", last=False)
        tops = scratch.table(placed.select(F.col("name").alias("tree"), "lo").join(
            crown.select("lo", "before", "after", F.col("digest").alias("subroot"), "root"), "lo"))
        found = descend(tiers, tops, scratch, kind, last=True)
        return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                            (F.col("folded_root") == F.col("root")).alias("verified")).checkpoint()
