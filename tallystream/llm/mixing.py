"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix's words are apportioned to sources in proportion to their targets, then each source's
words to its shards in proportion to the shards' sizes, both by highest quotients, so all
quotas are integers, add up, and no small source rounds to nothing. Within a shard, documents
are put in a seeded order, and the shard's words are cut into blocks of BLOCK words. The
quota takes the whole shard as often as it holds it; the rest are blocks in a seeded order
(an affine permutation of their numbers) until it is filled, the last one in part. So what a
document gives follows from its place by arithmetic. No document gives more than MAX_EPOCHS
times its words.

mix gives the figures for each document; corpus gives the mixed texts, a row for each copy:
whole copies as they are, and one that joins the words of the chosen blocks by a space.

Defined results: NULL texts have size 0 and give nothing; a NULL source is a source of its
own, ordered last; repeated rows count each by itself and equal ones share the same values
up to their order; an empty table gives an empty result. A source without words has target 0.
Carried columns keep their names unless the operator adds one of the same name. All steps are
DataFrame operations. A source's documents are dealt to shards of about SHARD_WORDS words, at
most MAX_SHARDS of them, so a source that holds a third of all rows is ordered in many tasks
and no task ranks more than MAX_SHARDS quotas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept

BLOCK, SHARD_WORDS, MAX_SHARDS, MAX_EPOCHS, SEED = 32, 1 << 18, 1 << 15, 3, 20240917
#: Primes above any number of blocks of a shard; one is chosen for each shard.
STEPS = (1_000_000_007, 1_500_000_001, 2_147_483_647, 1_000_000_021)
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of the total by weight, at most cap times a source's size, the excess reshared.

    The loop stops sources at their cap until none is above; each round moves three numbers
    to the driver and stops at least one source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row for each source, not for each document
    pick = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    src = kept(src.select("source", "source_size", pick.cast("double").alias("w")))
    most = F.col("source_size").cast("double") * cap
    level = -1.0
    while True:
        stopped = most <= F.col("w") * level
        total, used, free = src.agg(F.sum("source_size"), F.sum(F.when(stopped, most)), F.sum(F.when(~stopped, F.col("w")))).first()
        if not free:
            break
        now = ((total or 0) - (used or 0.0)) / free
        if now <= level:
            break
        level = now
    return src.select("source", "source_size", F.least(most, F.col("w") * level).alias("target"))


def sainte_lague(df: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Adds quota: seats of a group dealt to its rows by the highest votes / (2k + 1).

    Only the quotients near a row's proportional share are ranked; what is surely above the
    last winning quotient is counted, not listed. Ties go by the columns in order.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, rows = F.sum(F.col(votes).cast("double")).over(w), F.count(F.lit(1)).over(w)
    base = df.withColumns({"_all": total, "_rows": rows}).withColumn("_share", F.when(F.col("_all") > 0, F.col(votes) * F.col(seats) / F.col("_all")).otherwise(0.0))
    # At the divisor all / seats the rounded shares miss the seats by half the rows at most; a row's part of that is bounded by its share of the votes, plus two for rounding.
    slack = F.lit(2) + F.ceil(F.col("_rows") * F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0))
    base = base.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share") + 0.5) - slack).cast("long")).withColumn("_last", (F.floor(F.col("_share") + 0.5) + slack).cast("long"))
    open_ = base.select(*group, *order, F.col(votes).alias("_v"), seats, "_sure", F.explode(F.sequence("_sure", "_last")).alias("_k")).filter("_v > 0")
    open_ = open_.withColumn("_q", F.col("_v") / (2 * F.col("_k") + 1))
    keys = [*group, *order]
    sure = base.withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    left = sure.select(*[F.col(c).alias(f"_l_{c}") for c in keys], "_left")
    same = [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in keys]
    ranked = open_.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_q"), *[F.col(c).asc_nulls_last() for c in order], "_k")))
    on = same[0]
    for s in same[1:]:
        on = on & s
    won = ranked.join(left, on).filter("_r <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in keys], "_won")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    out = sure.join(won, on, "left")
    return out.select(*df.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _quotas(sized: DataFrame, weights: tuple[int, ...], block: int, shard_words: int, seed: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """From (_key, source, size): the sources (_s, source_size, target, _shards), and the shards' (_qs, _qd, _words, _epochs, _rest, _step, _first)."""
    targets = kept(source_targets(sized.select("source", "size"), weights, cap))
    seats = targets.agg(F.sum("target")).first()[0] or 0.0
    n_shards = F.least(F.lit(MAX_SHARDS).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / shard_words)))
    by_source = targets.withColumn("_seats", F.lit(round(seats)).cast("long"))
    by_source = sainte_lague(by_source, [], "target", "_seats", ["source"]).select("source", "source_size", "target", F.col("quota").alias("_source_quota"), n_shards.alias("_shards"))
    by_source = kept(by_source)
    sources = by_source.select(F.col("source").alias("_s"), "source_size", "target", "_shards")
    placed = _in_shards(sized, sources, seed).groupBy("source", "_shard").agg(F.sum("size").alias("_words"))
    quota = by_source.select(F.col("source").alias("_s"), "_source_quota")
    shards = placed.join(quota, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quotas = sainte_lague(shards, ["source"], "_words", "_source_quota", ["_shard"]).withColumn("_take", F.least(F.col("quota"), F.col("_words") * cap))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_words") / block))
    step = F.element_at(F.array(*map(F.lit, STEPS)), (F.pmod(F.xxhash64("source", "_shard", F.lit(seed + 3)), F.lit(len(STEPS))) + 1).cast("int"))
    quotas = quotas.select(
        F.col("source").alias("_qs"), F.col("_shard").alias("_qd"), "_words", F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0).cast("long").alias("_epochs"),
        F.when(F.col("_words") > 0, F.col("_take") % F.col("_words")).otherwise(0).cast("long").alias("_rest"), blocks.alias("_blocks"),
        (step % blocks).alias("_step"), F.pmod(F.xxhash64("source", "_shard", F.lit(seed + 2)), blocks).alias("_first"),
    )
    return sources, quotas


def _in_shards(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    return sized.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_shard", F.pmod(F.xxhash64("_key", F.lit(seed + 1)), F.col("_shards")))


def _from_block(j: Column, block: int) -> Column:
    """How many words of block j the rest of the quota takes: blocks come in the order of their permuted numbers, the last block may be short."""
    last = F.col("_blocks") - 1
    at = lambda k: (k * F.col("_step") + F.col("_first")) % F.col("_blocks")
    short = last * block + block - F.col("_words")
    size = F.when(j == last, block - short).otherwise(F.lit(block))
    before = at(j) * block - F.when(at(last) < at(j), short).otherwise(0)
    return F.greatest(F.lit(0).cast("long"), F.least(size, F.col("_rest") - before))


def _chosen(sized: DataFrame, sources: DataFrame, quotas: DataFrame, block: int, seed: int, ties: list[str]) -> DataFrame:
    """sized with _epochs, _start (its first word's place in its shard) and _parts: (from, to) places of the words that it gives besides whole copies."""
    w = Window.partitionBy("source", "_shard").orderBy(F.xxhash64("_key", F.lit(seed)), "_key", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = _in_shards(sized, sources, seed).withColumn("_start", F.sum("size").over(w) - F.col("size"))
    run = run.join(quotas, F.col("source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qd")))
    end = F.col("_start") + F.col("size")

    def part(j: Column) -> Column:
        begin = F.greatest(F.col("_start"), j * block)
        return F.struct(begin.alias("a"), F.least(end, j * block + _from_block(j, block)).alias("b"))

    parts = F.filter(F.transform(F.sequence(F.floor(F.col("_start") / block), F.floor((end - 1) / block)), part), lambda x: x["b"] > x["a"])
    return run.withColumn("_parts", F.when((F.col("size") > 0) & (F.col("_rest") > 0), parts).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")))


def _taken() -> Column:
    return (F.col("_epochs") * F.col("size") + F.aggregate("_parts", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, cap: int = MAX_EPOCHS, carry: list[str] | None = None) -> DataFrame:
    """carry columns, then doc_id, size, source_size, target, taken. carry (default: none) names columns of docs to keep."""
    carry = [c for c in carry or [] if c not in ("size", "source_size", "target", "taken", key)]
    base = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), *[F.col(f"`{c}`").alias(f"_c_{c}") for c in carry])
    sized = base if carry else kept(base)
    sources, quotas = _quotas(sized if not carry else kept(base.select("_key", "source", "size")), weights, block, shard_words, seed, cap)
    ties = [f"_c_{c}" for c in carry if dict(docs.dtypes)[c].split("<")[0] in ("string", "bigint", "int", "double")]
    run = _chosen(sized, sources, kept(quotas), block, seed, ties)
    return run.select(*[F.col(f"`_c_{c}`").alias(c) for c in carry], F.col("_key").alias(key), "size", "source_size", "target", _taken().alias("taken"))


def corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, cap: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: the columns of docs, copy (0, 1, ...) and words, a row for each copy of a document in the mix.

    text is that of the copy: whole, or the words that the mix takes, joined by a space.
    """
    names = [c for c in docs.columns if c.lower() not in ("copy", "words")]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    base = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), row.alias("_row"))
    sources, quotas = _quotas(kept(base.select("_key", "source", "size")), weights, block, shard_words, seed, cap)
    run = _chosen(base.withColumn("_tie", F.xxhash64("_row")), sources, kept(quotas), block, seed, ["_tie"])
    whole = F.transform(F.array_repeat(F.lit(0), F.when(F.col("size") > 0, F.col("_epochs")).otherwise(0).cast("int")), lambda x, i: F.struct(i.alias("copy"), F.lit(False).alias("cut")))
    part = F.when(F.size("_parts") > 0, F.array(F.struct(F.col("_epochs").cast("int").alias("copy"), F.lit(True).alias("cut")))).otherwise(F.array().cast("array<struct<copy:int,cut:boolean>>"))
    copies = run.select("_row", "size", "_start", "_parts", F.explode(F.concat(whole, part)).alias("_c"))
    words = F.regexp_extract_all(F.col("_row")[text], F.lit(WORD), F.lit(0))
    joined = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("_parts", lambda x: F.slice(w, (x["a"] - F.col("_start") + 1).cast("int"), (x["b"] - x["a"]).cast("int")))), " ")), F.lit(0))
    new = F.when(F.col("_c.cut"), joined).otherwise(F.col("_row")[text])
    n = F.when(F.col("_c.cut"), F.aggregate("_parts", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])).otherwise(F.col("size"))
    return copies.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in names], F.col("_c.copy").alias("copy"), n.alias("words"))
