"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources in code-point order (null last) get the weights 5, 2, 1, repeating, of the total size; a target
   stops at ``max_repeat`` times its source's size and the excess is reshared by weight (water filling: the targets are
   ``least(cap, level * weight)`` for the one level that spends the total).
2. Blocks: a source's documents fall by hash into a power-of-two number of blocks of about ``block_words`` words. An
   epoch visits the blocks in an affine permutation of their numbers. A source draws whole epochs, then blocks of one
   more epoch up to its target. What is left of the target is filled with texts of the following blocks, in the same
   order, as long as any of them fits (:func:`fill_remainders`); together they are one more draw.
3. Tree: the exact vector of block quotas by source is split recursively among the output shards. Each node draws its
   left child's vector from the multivariate hypergeometric law (a chain of hypergeometric draws by inverse CDF), so
   every shard gets an exact share and all draws are disjoint.
4. Each draw goes to its shard; rows are ordered inside the shard by hash only (a local shuffle).

Everything is a DataFrame or SQL expression and all randomness is a hash of ``seed``, so reruns agree. One row of
totals comes to the driver. A node of the tree holds one number per source, and targets are set in one task over one
row per source: meant for sources (hosts, collections) by the million, not for one per document.

Defined results: a null or empty text has size 0, is in no block and takes 0 words; a null source is a source of its
own, ordered last; equal rows (same id and text) are taken together, texts of equal size in the order of their hash; a
text longer than the room that is left is passed over and others that fit are taken (if none does, the source stays
short by less than its smallest text that was not taken); an empty table gives an empty result; other columns are
ignored unless ``carry`` names them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, group_key, hinted, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 16_384
#: Block draws per output shard.
SHARD_BLOCKS = 256
SEED = 20_240_601
#: Blocks whose words are summed together before the running sum over a source.
RUN = 4096


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(src, source, source_size) -> the same with ``target``. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    x = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    x = x.withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumns({"at": F.row_number().over(by_ratio), "level": (F.sum("source_size").over(whole) - before) / rest})
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("at", "level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(first["level"] * F.col("weight"), F.col("cap")))
    return x.select("src", "source", "source_size", target.alias("target"))


def _uniform(*parts: str) -> str:
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992D)"


def _log_weight(x: str) -> str:
    """SQL: minus the sum of ln t! over t = x, k - x, d - x, n - k - d + x (one lambda for the four): a table below 16,
    Stirling's series above."""
    table = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(16))
    series = f"(t + 0.5D) * ln(t) - t + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * t) - 1D / (360D * t * t * t)"
    return (f"aggregate(array(cast({x} AS DOUBLE), p.marked - {x}, p.drawn - {x}, p.total - p.marked - p.drawn + {x}), 0D, "
            f"(a, t) -> a - CASE WHEN t < 16 THEN element_at(array({table}), cast(t AS INT) + 1) ELSE {series} END)")


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is computed and written once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many of ``drawn`` items taken from ``total``, of which ``marked`` are marked, are marked.

    Inverse CDF over the support within 12 standard deviations of the mean, weights relative to the largest."""
    p = f"named_struct('total', cast({total} AS DOUBLE), 'marked', cast({marked} AS DOUBLE), 'drawn', cast({drawn} AS DOUBLE), 'u', {u})"
    mean = "p.drawn * p.marked / greatest(p.total, 1D)"
    around = "12D * sqrt(mean * (1D - p.marked / greatest(p.total, 1D)) * (p.total - p.drawn) / greatest(p.total - 1D, 1D)) + 12D"
    ends = ("named_struct('lo', cast(greatest(0D, p.drawn - (p.total - p.marked), floor(mean - wide)) AS BIGINT), "
            "'hi', cast(least(p.drawn, p.marked, ceil(mean + wide)) AS BIGINT))")
    pick = ("aggregate(w, named_struct('left', p.u * aggregate(w, 0D, (s, v) -> s + v), 'x', q.lo), "
            "(s, v) -> named_struct('left', s.left - v, 'x', s.x + CASE WHEN s.left > v THEN 1L ELSE 0L END), s -> least(s.x, q.hi))")
    weights = _let(f"transform(sequence(q.lo, q.hi), x -> {_log_weight('x')})", "lw", _let("array_max(lw)", "top", "transform(lw, v -> exp(v - top))"))
    return _let(p, "p", _let(mean, "mean", _let(around, "wide", _let(ends, "q", _let(weights, "w", pick)))))


def split_quotas(sources: DataFrame, shards: int, total: int, seed: int = SEED) -> DataFrame:
    """(src, draws) per source -> (shard, src, quota): the splitting tree, ``ceil(log2(shards))`` levels of it.

    Shard i of n gets floor((i + 1) * total / n) - floor(i * total / n) draws. Each level of the tree is written to the
    shared folder, so the plan has the same size for any number of shards."""
    node = sources.groupBy().agg(F.sort_array(F.collect_list(F.struct("src", F.col("draws").cast("bigint").alias("q")))).alias("v"))
    node = node.select(F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"), "v")
    cut = f"(floor(mid * {total}D / {shards}) - floor(lo * {total}D / {shards}))"
    x = _hypergeometric("s.total", "e.q", "s.drawn", _uniform(f"{seed}L", "lo", "hi", "e.src"))
    step = "named_struct('total', s.total - e.q, 'drawn', s.drawn - k, 'part', concat(s.part, array(k)))"
    part = (f"aggregate(v, named_struct('total', aggregate(v, 0L, (s, e) -> s + e.q), 'drawn', cast({cut} AS BIGINT), 'part', cast(array() AS array<bigint>)), "
            f"(s, e) -> {_let(x, 'k', step)}, s -> s.part)")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        node = node.withColumn("mid", F.expr("CASE WHEN hi - lo > 1 THEN lo + (hi - lo) div 2 ELSE hi END"))
        node = node.withColumn("part", F.expr(f"CASE WHEN hi - lo > 1 THEN {part} END"))
        node = node.select(F.explode(F.expr(
            "CASE WHEN hi - lo > 1 THEN array("
            "named_struct('lo', lo, 'hi', mid, 'v', zip_with(v, part, (e, k) -> named_struct('src', e.src, 'q', k))), "
            "named_struct('lo', mid, 'hi', hi, 'v', zip_with(v, part, (e, k) -> named_struct('src', e.src, 'q', e.q - k)))) "
            "ELSE array(named_struct('lo', lo, 'hi', hi, 'v', v)) END")).alias("n")).select("n.*")
        node = materialize(node.repartition("lo"), "mix-tree")
    return node.select(F.col("lo").alias("shard"), F.explode("v").alias("e")).select("shard", "e.src", F.col("e.q").alias("quota"))


def _rank(epoch: Column, block: Column, blocks: Column, seed: int) -> Column:
    """Place of a block in an epoch's order: an affine permutation of 0 .. blocks - 1, ``blocks`` a power of two."""
    factor = F.pmod(F.xxhash64(F.lit(seed), F.lit("factor"), "src", epoch), F.lit(1 << 30)) * 2 + 1
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), "src", epoch), F.lit(1 << 30))
    return F.pmod(factor * block + shift, blocks)


def fill_remainders(base: DataFrame, sources: DataFrame, state: DataFrame, seed: int) -> DataFrame:
    """(src, key) of the texts that fill each source's ``room`` behind its place ``last`` of the last epoch.

    Blocks follow in permuted order, of each the texts that fit into the room; those of the block in which the room ends
    are taken largest first, which fills half of what was left there or more. What then remains is offered to the blocks
    behind it: a round for each halving of the room at most, until no text behind the place fits."""
    parts, live = [], materialize(state, "mix-room")
    place = _rank(F.col("epochs"), F.pmod(F.col("key"), F.col("blocks")), F.col("blocks"), seed)
    while True:
        known = sources.select("src", "blocks", "epochs").join(live, "src")
        fits = base.select("src", "key", "size").filter("size > 0").join(hinted(known, "src"), "src").filter(F.col("size") <= F.col("room"))
        fits = fits.withColumn("place", place).filter("place > last").groupBy("src", "place", "key").agg(
            F.sum("size").alias("s"), F.first("room").alias("room")).filter(F.col("s") <= F.col("room"))
        fits = materialize(fits, "mix-fits")
        blocks = fits.groupBy("src", "place").agg(F.sum("s").alias("s"), F.first("room").alias("room")).withColumn("run", F.floor(F.col("place") / RUN))
        blocks = materialize(blocks, "mix-behind")
        if blocks.isEmpty():
            break
        runs = blocks.groupBy("src", "run").agg(F.sum("s").alias("run_size"))
        ahead = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select("src", "run", F.coalesce(F.sum("run_size").over(ahead), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("src", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        blocks = blocks.join(runs, ["src", "run"]).withColumn("upto", F.col("offset") + F.sum("s").over(inside))
        ends = blocks.groupBy("src").agg(
            F.min(F.when(F.col("upto") > F.col("room"), F.struct("place", (F.col("room") - F.col("upto") + F.col("s")).alias("room")))).alias("end"))
        ends = materialize(ends.select("src", F.col("end.place").alias("end"), F.col("end.room").alias("left")), "mix-ends")
        x = fits.join(hinted(ends, "src"), "src")
        whole = x.filter("end IS NULL OR place < end").select("src", "key")
        # one block per source: bounded by the block's texts
        listed = x.filter("place = end").groupBy("src").agg(F.max("end").alias("last"), F.max("left").alias("left"), F.sort_array(
            F.collect_list(F.struct("s", "key")), asc=False).alias("docs"))
        start = F.struct(F.col("left").alias("room"), F.array().cast("array<bigint>").alias("keys"))
        listed = materialize(listed.select("src", "last", F.aggregate("docs", start, lambda s, d: F.when(
            d["s"] <= s["room"], F.struct((s["room"] - d["s"]).alias("room"), F.concat(s["keys"], F.array(d["key"])).alias("keys"))).otherwise(s)).alias("r")), "mix-cut")
        parts.append(materialize(whole.unionByName(listed.select("src", F.explode("r.keys").alias("key"))), "mix-part"))
        live = listed.select("src", "last", F.col("r.room").alias("room"))
    taken = base.select("src", "key").limit(0) if not parts else parts[0]
    for p in parts[1:]:
        taken = taken.unionByName(p)
    return materialize(taken, "mix-taken")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
                seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """One row per document: (id, source, size, source_size, target, copies, placements[, row]).

    ``placements`` lists the (epoch, shard) of each copy that the mix takes; ``mixed_rows`` lays them out."""
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    text = text_or_empty(text_col)
    base = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), group_key(source_col).alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), id_col, text).alias("key"), *row), "mix-base")

    sizes = base.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, max_repeat)
    size, target = F.col("source_size"), F.col("target")
    blocks = F.when(size > 0, F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size / block_words, F.lit(1.0)))))).otherwise(0).cast("bigint")
    epochs = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("bigint")
    sources = materialize(sources.withColumns({"blocks": blocks, "epochs": epochs}).withColumn(
        "rest", F.when(size > 0, target - F.col("epochs") * size).otherwise(0.0)), "mix-sources")

    member = base.join(hinted(sources.drop("source"), "src"), "src")
    member = member.withColumn("block", F.when((F.col("size") > 0) & (F.col("blocks") > 0), F.pmod(F.col("key"), F.col("blocks"))))

    # running words of the blocks in the order of the last, partial epoch: by runs of blocks, then inside each run
    per = member.filter("block IS NOT NULL").groupBy("src", "block").agg(F.sum("size").alias("block_size"), *[
        F.first(c).alias(c) for c in ("blocks", "epochs", "rest")])
    per = materialize(per.withColumn("place", _rank(F.col("epochs"), F.col("block"), F.col("blocks"), seed)).withColumn(
        "run", F.floor(F.col("place") / RUN)), "mix-blocks")
    runs = per.groupBy("src", "run").agg(F.sum("block_size").alias("run_size"))
    ahead = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("src", "run", F.coalesce(F.sum("run_size").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("src", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    per = per.join(runs, ["src", "run"]).withColumn("upto", F.col("offset") + F.sum("block_size").over(inside))
    per = materialize(per.select("src", "block", "block_size", "blocks", "epochs", "place", (F.col("upto") <= F.col("rest")).alias("whole"),
                                 (F.col("place") == 0).alias("first"), (F.col("rest") - F.col("upto") + F.col("block_size")).alias("room")), "mix-cut")

    # what is left of each target is filled from the following blocks
    state = per.filter("whole OR first").groupBy("src").agg(
        F.coalesce(F.max(F.when(F.col("whole"), F.col("place"))), F.lit(-1)).alias("last"),
        F.min(F.when(F.col("whole"), F.col("room") - F.col("block_size")).otherwise(F.col("room"))).alias("room"))
    extra = fill_remainders(base, sources, state, seed)

    # draws by source: whole epochs, the whole blocks of the last epoch, and one of the texts that fill the remainder
    filled = extra.select("src").distinct().withColumn("filled", F.lit(1))
    draws = per.groupBy("src").agg((F.max(F.col("epochs") * F.col("blocks")) + F.coalesce(
        F.max(F.when(F.col("whole"), F.col("place") + 1)), F.lit(0))).alias("blocks"))
    draws = draws.join(filled, "src", "left").select("src", (F.col("blocks") + F.coalesce("filled", F.lit(0))).alias("draws"), "filled")
    draws = materialize(draws, "mix-draws")
    total = draws.agg(F.sum("draws")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_blocks))

    # the tree's quotas, laid out along each source's draws
    leaf = split_quotas(draws, shards, total, seed)
    along = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaf = leaf.withColumn("begin", F.coalesce(F.sum("quota").over(along), F.lit(0))).filter("quota > 0")
    leaf = leaf.select("shard", "src", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("quota") - 1)).alias("draw"))

    last = F.when(F.col("whole"), F.col("epochs")).otherwise(F.col("epochs") - 1)
    visits = per.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    visits = visits.withColumn("draw", F.col("epoch") * F.col("blocks") + _rank(F.col("epoch"), F.col("block"), F.col("blocks"), seed))
    leaf = materialize(leaf, "mix-leaf")
    visits = materialize(visits.join(leaf, ["src", "draw"]).groupBy("src", "block").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("placed")), "mix-visits")
    at = draws.filter("filled = 1").select("src", (F.col("draws") - 1).alias("draw")).join(leaf, ["src", "draw"])
    extra = materialize(extra.join(hinted(at.select("src", F.col("shard").alias("extra_shard")), "src"), "src"), "mix-extra")

    none = F.array().cast("array<struct<epoch:bigint,shard:bigint>>")
    out = member.join(hinted(visits, "src"), ["src", "block"], "left").join(hinted(extra, "src"), ["src", "key"], "left")
    more = F.when(F.col("extra_shard").isNotNull(), F.array(F.struct(F.col("epochs").alias("epoch"), F.col("extra_shard").alias("shard")))).otherwise(none)
    out = out.withColumn("placements", F.concat(F.coalesce("placed", none), more)).withColumn("copies", F.size("placements").cast("bigint"))
    return out.select("id", "source", "size", "source_size", "target", "copies", "placements", *(["row"] if carry else []), "key")


def mixed_rows(mix: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per copy taken, dealt to its shard and ordered inside it by hash: (shard, epoch, id[, row])."""
    cols = ["id", *(["row"] if "row" in mix.columns else [])]
    x = mix.select(*cols, "key", F.explode("placements").alias("p")).select(
        "p.shard", "p.epoch", *cols, F.xxhash64(F.lit(seed), F.lit("order"), "p.epoch", "key").alias("at"))
    return x.repartition("shard").sortWithinPartitions("shard", "at").drop("at")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                      "copies", F.array_join(F.transform("placements", lambda p: p["shard"].cast("string")), ",").alias("shards"))


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the documents: each as often as it is taken, in shard order, with the input's columns."""
    return mixed_rows(mix_sources(docs, carry=docs.columns)).select("row.*")
