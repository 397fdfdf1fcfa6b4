"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is made of equal-token blocks.  Sources get blocks by highest quotients
target / (2 s + 1), and within a source its shards get theirs by the same rule, so every
shard has an integer quota.  A shard's documents stand in seeded order on a ring that is
cut into blocks; the shard's quota of blocks is taken from the ring's start, around it
more than once if the quota is larger than the shard.

The highest-quotient rule is evaluated without a list of all seats: a divisor that gives
at most the wanted number of seats fixes a lower bound for every entry, one that gives at
least as many an upper bound, and only the quotients between the two are ranked.  Their
number is at most about twice the number of entries.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dealt, stored, text_of

WEIGHTS = (1, 2, 3)
#: Most times that a source may be repeated in the mix.
MAX_REPEATS = 3
#: Words of a block, and words of a shard.
BLOCK, SHARD_WORDS = 64, 1_000_000
SEED = 17


def size_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`."""
    return F.regexp_count(text, F.lit("[^ \t-\r]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Sources by code point, null last, weigh weights in turn and share the sum of all
    sizes; a target stops at repeats times its source's size and the excess is shared
    anew by weight.  Sorted by that limit a weight, the first k sources stop and the
    others share what is left: one pass of running sums finds k.  One row a source.
    """
    everywhere = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(everywhere) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * float(repeats)).withColumn("level", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("level", F.asc_nulls_last("source"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    # If all sources before this one stop, a unit of weight gets this much.
    share = (total - (F.sum("limit").over(upto) - F.col("limit"))) / (F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
    found = ranked.withColumn("share", share).withColumn("place", F.row_number().over(by_level))
    found = found.withColumn("open", F.min(F.when(F.col("share") <= F.col("level"), F.struct("place", "share"))).over(whole))
    stops = F.col("open").isNull() | (F.col("place") < F.col("open.place"))
    target = F.when(stops, F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.col("open.share")))
    return found.select("source", "source_size", target.alias("target"))


def sainte_lague(entries: DataFrame, group: list[str], key: list[str], votes: str, seats: str, most: str) -> DataFrame:
    """Adds quota: seats of each group shared among its entries by highest votes/(2s+1).

    seats is the group's number of seats on each of its rows, most an entry's limit.  Ties
    go to the lesser key.  Entries without votes get none.
    """
    w = Window.partitionBy(*group)
    n, total = F.count("*").over(w), F.sum(votes).over(w)
    rows = entries.withColumn("__n", n).withColumn("__total", total)
    # At the divisor total/x an entry has round(votes * x / total) seats.
    at = lambda x: F.when(F.col("__total") > 0, F.round(F.col(votes) * x / F.col("__total"))).otherwise(0.0)
    low = F.greatest(F.lit(0.0), at(F.greatest(F.lit(0.0), F.col(seats) - F.col("__n") / 2 - 1)) - 1)
    high = at(F.col(seats) + F.col("__n") / 2 + 1) + 1
    rows = rows.withColumn("__low", F.least(low, F.col(most)).cast("long")).withColumn("__high", F.least(high, F.col(most)).cast("long"))
    rows = rows.withColumn("__open", F.col(seats) - F.sum("__low").over(w))
    between = rows.where("__high > __low").select(*key, *[g for g in group if g not in key], F.col(votes).alias("__v"), "__open", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)).alias("__s"))
    order = Window.partitionBy(*group).orderBy((F.col("__v") / (2 * F.col("__s") + 1)).desc(), *[F.asc_nulls_last(k) for k in key], "__s")
    won = between.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= F.col("__open")).groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.count("*").alias("__won"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    joined = rows.join(won, same, "left")
    return joined.select(*entries.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).alias("quota"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """docs with extra columns size, source_size, target, taken (words the mix takes).

    Returns doc_id, text_digest, source, size, source_size, target, taken.  Null texts have
    no words; a null source is a source of its own; repeated rows count as rows of their
    own; no document is taken more than repeats times; an empty table gives no rows.
    Reruns agree: the order in a shard is a hash of seed, doc_id and text.
    """
    rows = dealt(docs, "doc_id", "text", "source").select(
        "doc_id", "source", size_of(text_of()).alias("size"), F.xxhash64(F.lit(seed), "doc_id", text_of()).alias("draw")
    )
    rows = stored(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, repeats)
    whole = Window.partitionBy()
    goal = goal.withColumn("__all", F.lit(0)).withColumn("blocks", F.round(F.sum("target").over(whole) / block).cast("long"))
    # The last block of a source or shard may be a part of one, so a small source has one too.
    goal = goal.withColumn("most", F.ceil(F.col("source_size") * repeats / block))
    goal = sainte_lague(goal, ["__all"], ["source"], "target", "blocks", "most").withColumnRenamed("quota", "source_quota")
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")).select(F.col("source").alias("of"), "source_size", "target", "source_quota", "shards")
    goal = stored(goal, "mix-targets")
    # Documents of a source go to its shards by hash, so a hot source is many shards.
    placed = rows.join(goal, rows.source.eqNullSafe(goal.of)).drop("of")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards")))
    parts = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    parts = parts.withColumn("most", F.ceil(F.col("shard_size") * repeats / block))
    parts = sainte_lague(parts, ["source"], ["source", "shard"], "shard_size", "source_quota", "most").select(F.col("source").alias("of"), F.col("shard").alias("at"), "shard_size", "quota")
    ring = placed.join(parts, placed.source.eqNullSafe(parts.of) & (placed.shard == parts.at)).drop("of", "at")
    order = Window.partitionBy("source", "shard").orderBy("draw", F.asc_nulls_last("doc_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ring = ring.withColumn("stop", F.sum("size").over(order))
    words = F.least(F.col("quota") * block, F.col("shard_size") * repeats)
    rest = words % F.greatest(F.col("shard_size"), F.lit(1))
    rounds = F.floor(words / F.greatest(F.col("shard_size"), F.lit(1)))
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("stop") - F.col("size"))))
    return ring.select("doc_id", "source", "draw", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; see mixed."""
    return mixed(docs, **how).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as the mix takes it, to the nearest whole number.

    Only at a ring's cut does a row's share of words differ from a whole number.  Rows
    that are equal in doc_id, source and text share what they are taken.
    """
    seed, names = how.get("seed", SEED), {}
    for name in ("id", "source", "draw", "copies", "own", "copy"):  # none of docs' own
        names[name] = f"__{name}"
        while names[name] in docs.columns:
            names[name] += "_"
    n = names
    plan = mixed(docs, **how).groupBy("doc_id", "source", "draw").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    plan = plan.where("size > 0").select(F.col("doc_id").alias(n["id"]), F.col("source").alias(n["source"]), F.col("draw").alias(n["draw"]), copies.alias(n["copies"])).where(F.col(n["copies"]) > 0)
    rows = docs.withColumn(n["own"], F.xxhash64(F.lit(seed), "doc_id", text_of()))
    same = F.col("doc_id").eqNullSafe(F.col(n["id"])) & F.col("source").eqNullSafe(F.col(n["source"])) & (F.col(n["own"]) == F.col(n["draw"]))
    return rows.join(plan, same).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), n["copies"])).alias(n["copy"])).drop(n["copy"])
