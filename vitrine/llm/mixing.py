"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are dealt by hash to blocks; the block number, being
random, is the permuted order in which blocks are drawn.  Laid end to end (and
over again, up to three times) they make the source's tape of words, of which
the mix takes the first ``target`` words.  So a source's quota is a whole number
of block copies.  A splitting tree deals the quotas to output shards: every
node halves its shards and draws, per source, how many block copies go left
from the multivariate hypergeometric distribution, as dealing a shuffled deck
would.  Each shard then takes the next disjoint run of every source's permuted
blocks, and rows are shuffled locally within the shard.

Prefix sums run over documents of a block, blocks of a 1024-block stretch and
stretches of a source, so no window holds a whole source.  Sources themselves
are settings of the mix, one row each; arrays and windows run over them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm import common as C

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_DOCS = 256
STRETCH = 1024
LEAST_SHARDS = 16
WORDS_PER_SHARD = 20_000_000
SPREAD_LEVEL = 6      # of the tree: from 64 nodes on they are dealt to tasks
SEED = 20240


def source_targets(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``stats`` (source, docs, words) with source_no, weight and target.

    All words are shared by weight (1, 2, 3, ... by code point of the source,
    null last); a target stops at ``max_epochs`` times its source's words and the
    excess is reshared by weight.  In order of words per weight, a source is at
    its limit if its fair share of what the earlier ones left exceeds it."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = (stats.withColumn("source_no", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
         .withColumn("limit", F.col("words") * max_epochs))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("words").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    w = w.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    # The shares of sources below their limit all follow the level at the first of them.
    w = w.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return w.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double"))
                        .otherwise(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))).drop("limit", "level", "full")


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from n + 8, exact to about 1e-13."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (n + i)
    return series - F.ln(product)


def _let(value: Column, body) -> Column:
    """``body`` of a variable holding ``value``, which is so worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` balls are among ``marked`` of ``total``, by inverting
    the distribution at ``uniform``.  Values further than 9 standard deviations
    + 30 from the mode weigh less than a double can tell and are not visited."""
    zero = F.lit(0).cast("long")
    low, high = F.greatest(zero, drawn - (total - marked)), F.least(drawn, marked)
    mode = F.floor((drawn + 1.0) * (marked + 1.0) / (total + 2.0)).cast("long")
    share = marked / F.greatest(total, F.lit(1).cast("long"))
    sd = F.sqrt(F.greatest(F.lit(0.0), drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1).cast("long"))))
    reach = F.ceil(9 * sd + 30).cast("long")

    def log_weight(k: Column) -> Column:
        return -(_log_factorial(k) + _log_factorial(marked - k) + _log_factorial(drawn - k)
                 + _log_factorial(total - marked - drawn + k))

    def pick(weights: Column, top: Column) -> Column:
        mass = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + F.exp(x["w"] - top))
        return _let(mass, lambda m: F.aggregate(
            weights, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k")),
            lambda acc, x: _let(acc["sum"] + F.exp(x["w"] - top), lambda s: F.struct(
                s.alias("sum"), F.when((acc["k"] < 0) & (s > uniform * m), x["k"]).otherwise(acc["k"]).alias("k")))))["k"]

    values = F.sequence(F.greatest(low, mode - reach), F.least(high, mode + reach))
    weights = F.transform(values, lambda k: F.struct(log_weight(k).alias("w"), k.alias("k")))
    picked = _let(weights, lambda ws: _let(F.array_max(ws)["w"], lambda top: pick(ws, top)))
    return _let(picked, lambda k: F.when(k < 0, F.least(high, mode + reach)).otherwise(k))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(source_no, shard, blocks) from (source_no, quota): the splitting tree.
    Per shard and source one row; the rows of a source add up to its quota, and
    those of a shard to its even part of all quotas."""
    entry = F.struct(F.col("source_no").cast("int").alias("source_no"), F.col("quota").cast("long").alias("n"))
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("counts")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts")
    state = "struct<rest:bigint,left:bigint,out:array<struct<source_no:int,n:bigint,l:bigint>>>"
    for level in range(math.ceil(math.log2(max(shards, 1)))):
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition("lo")
        lo, hi = F.col("lo"), F.col("hi")
        mid = F.floor((lo + hi) / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        to_left = F.floor(total * (mid - lo) / (hi - lo)).cast("long")

        def draw(acc: Column, x: Column) -> Column:
            k = hypergeometric(acc["rest"], x["n"], acc["left"], _uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["source_no"]))
            return _let(k, lambda v: F.struct(
                (acc["rest"] - x["n"]).alias("rest"), (acc["left"] - v).alias("left"),
                F.concat(acc["out"], F.array(F.struct(x["source_no"].alias("source_no"), x["n"].alias("n"), v.alias("l")))).alias("out")))

        start = F.struct(total.alias("rest"), to_left.alias("left"), F.array().cast(
            "array<struct<source_no:int,n:bigint,l:bigint>>").alias("out")).cast(state)
        drawn = F.aggregate("counts", start, lambda acc, x: draw(acc, x).cast(state))["out"]
        nodes = nodes.select("lo", "hi", mid.alias("mid"), F.when(hi - lo > 1, drawn).otherwise(F.transform(
            "counts", lambda x: F.struct(x["source_no"].alias("source_no"), x["n"].alias("n"), x["n"].alias("l")))).alias("drawn"))
        left = F.struct(F.col("lo").alias("lo"), F.when(hi - lo > 1, F.col("mid")).otherwise(hi).alias("hi"), F.transform(
            "drawn", lambda x: F.struct(x["source_no"].alias("source_no"), x["l"].alias("n"))).alias("counts"))
        right = F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.transform(
            "drawn", lambda x: F.struct(x["source_no"].alias("source_no"), (x["n"] - x["l"]).alias("n"))).alias("counts"))
        children = F.when(hi - lo > 1, F.array(left, right)).otherwise(F.array(left))
        nodes = nodes.select(F.explode(children).alias("c")).select("c.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("counts").alias("c")).select(
        "shard", F.col("c.source_no").alias("source_no"), F.col("c.n").alias("blocks"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int | None = None,
        block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """The plan of the mix, one row per row of ``docs``: the id, size, source,
    source_size, target, copies, taken, and the output shard of each copy.

    Size: words of the text; null text counts 0.  A null source is a source of
    its own.  A copy is taken if the middle of its words lies before the target,
    so a source misses its target by half a document at most.  Shards number one
    for every ``WORDS_PER_SHARD`` words, ``LEAST_SHARDS`` at least, unless given.  Rows that repeat
    an id are dealt like others.  The draw depends only on ids, sizes and the
    seed: reruns agree.  An empty table gives no rows.  Other columns are not read."""
    with C.Scratch(docs.sparkSession) as scratch:
        sized = scratch.table(docs.select(
            F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(C.WORD)), F.lit(0)).cast("long").alias("size")))
        stats = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        sources = scratch.table(source_targets(stats, weights, max_epochs)
                                .withColumn("n_blocks", F.ceil(F.col("docs") / block_docs).cast("long")))
        shards = shards or max(LEAST_SHARDS, math.ceil((sources.agg(F.sum("words")).first()[0] or 0) / WORDS_PER_SHARD))
        # One row per source: a setting of the mix, so broadcast by size only where Spark measures it small.
        keyed = sized.join(sources.select(F.col("source").alias("s"), "source_no", "n_blocks"),
                           F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
        key = F.xxhash64(F.lit(seed), F.col("source_no"), F.col("_id"), F.col("size"))
        dealt = scratch.table(keyed.select("_id", "size", "source_no", key.alias("order"), F.pmod(
            F.xxhash64(key, F.lit(1)), F.col("n_blocks")).alias("block")))
        in_stretch = Window.partitionBy("source_no", "stretch").orderBy("block")
        blocks = (dealt.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
                  .withColumn("stretch", F.floor(F.col("block") / STRETCH)))
        stretches = blocks.groupBy("source_no", "stretch").agg(F.sum("words").alias("words")).select(
            "source_no", "stretch", (F.sum("words").over(Window.partitionBy("source_no").orderBy("stretch")) - F.col("words")).alias("offset"))
        tape = scratch.table(
            blocks.withColumn("inner", F.sum("words").over(in_stretch) - F.col("words"))
            .withColumn("nth", F.row_number().over(in_stretch))
            .join(stretches, ["source_no", "stretch"])
            .join(sources.select("source_no", "source", "target", F.col("words").alias("source_size")), "source_no")
            .withColumn("start", F.col("offset") + F.col("inner")))
        # Copies of a block whose start lies before the target are drawn.
        epochs = F.expr(f"filter(sequence(0, {max_epochs - 1}), e -> e * source_size + start < target)")
        copies = tape.select("source_no", "block", F.posexplode(epochs).alias("nth_copy", "epoch"))
        turn = Window.partitionBy("source_no", "epoch", "turn_stretch").orderBy("block")
        copies = copies.withColumn("turn_stretch", F.floor(F.col("block") / STRETCH))
        per = copies.groupBy("source_no", "epoch", "turn_stretch").agg(F.count("*").alias("n")).withColumn(
            "offset", F.sum("n").over(Window.partitionBy("source_no").orderBy("epoch", "turn_stretch")) - F.col("n")).drop("n")
        copies = (copies.withColumn("inner", F.row_number().over(turn) - 1).join(per, ["source_no", "epoch", "turn_stretch"])
                  .select("source_no", "block", "epoch", (F.col("offset") + F.col("inner")).alias("turn")))
        copies = scratch.table(copies)
        quotas = copies.groupBy("source_no").agg(F.count("*").alias("quota"))
        upto = Window.partitionBy("source_no").orderBy("shard")
        runs = split_quotas(quotas, shards, seed).withColumn("until", F.sum("blocks").over(upto)).filter("blocks > 0")
        turns = scratch.table(runs).select("source_no", "shard", F.explode(
            F.sequence(F.col("until") - F.col("blocks"), F.col("until") - 1)).alias("turn"))
        drawn = (copies.join(turns, ["source_no", "turn"]).groupBy("source_no", "block")
                 .agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("drawn")))  # max_epochs entries at most
        plan = scratch.table(tape.select("source_no", "block", "source", "source_size", "target", "start")
                             .join(drawn, ["source_no", "block"], "left"))
        inner = Window.partitionBy("source_no", "block").orderBy("order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        rows = (dealt.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
                .join(plan, ["source_no", "block"])
                .withColumn("taken_by", F.expr(
                    "transform(filter(drawn, d -> d.epoch * source_size + start + before + size / 2 < target), d -> d.shard)")))
        n = F.coalesce(F.size("taken_by"), F.lit(0))
        n = F.when(F.col("taken_by").isNull(), 0).otherwise(n).cast("long")
        return rows.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", n.alias("copies"),
                           (n * F.col("size")).alias("taken"),
                           F.coalesce("taken_by", F.array().cast("array<int>")).alias("shards")).checkpoint()


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **settings) -> DataFrame:
    """The mixed corpus: each row of ``docs`` once per copy that the mix takes,
    dealt to its output shard and shuffled within it.  Columns are those of
    ``docs``.  Rows with equal id and text are one document with the copies of all;
    null ids, null texts and null sources are mixed like others."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    keyed = docs.select(key.alias("_key"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    plan = mix(keyed, "_key", "_text", "_source", seed=seed, **settings)
    per_shard = plan.select(F.col("_key").alias("doc_key"), F.explode("shards").alias("shard"))
    taken = per_shard.groupBy("doc_key", "shard").agg(F.count("*").alias("n")).groupBy("doc_key").agg(
        F.collect_list(F.struct("shard", "n")).alias("takes"))  # an entry per shard at most
    rows = docs.select(key.alias("doc_key"), F.struct("*").alias("_row")).join(taken, "doc_key").dropDuplicates(["doc_key"])
    copies = rows.select("doc_key", "_row", F.explode("takes").alias("take")).select(
        "doc_key", "_row", F.col("take.shard").alias("_shard"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("take.n"))).alias("_copy"))
    return (copies.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64(F.lit(seed), "_shard", "doc_key", "_copy"))
            .select("_row.*"))
