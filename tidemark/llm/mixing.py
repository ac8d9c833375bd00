"""Mixing sources to target weights.

The mix is as large as the corpus, in tokens, and is handed out in blocks of equal tokens: by highest quotients
(Sainte-Lague) to the sources, then likewise to the shards of each source. Within a shard, documents stand in seeded
order; the quota is met by whole passes and then by the leading blocks of one more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tokenizer import documents, token_counts
from tidemark.sources.shared import table, written

#: Tokens of a block.
BLOCK = 256
#: Tokens of a shard, at least; with more than MAX_SHARDS shards of this size, shards are larger instead.
SHARD = 1 << 22
MAX_SHARDS = 50_000


def apportion(weights: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients weight / (2 seats + 1), none beyond ``most``; seats that all are full for stay free.

    The divisor at which the rounded shares add up is found by bisection, so billions of seats cost no more than few;
    the last seats go one by one, of equal quotients to the first.
    """
    weights = np.where(np.isfinite(weights), np.maximum(weights, 0), 0).astype(float)
    most = np.full(len(weights), seats, np.int64) if most is None else np.asarray(most, np.int64)
    most = np.where(weights > 0, most, 0)
    if seats >= most.sum():
        return most
    at = lambda d: np.minimum(np.floor(weights * d + 0.5).astype(np.int64), most)
    low, high = 0.0, 1.0
    while at(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if at(middle).sum() <= seats:
            low = middle
        else:
            high = middle
    given = at(low * (1 - 1e-11))  # below any tie, which the loop then settles
    while given.sum() < seats:
        quotients = np.where(given < most, weights / (2 * given + 1), -1)
        given[int(np.argmax(quotients))] += 1
    return given


def _sharded(counted: DataFrame, totals: dict[str | None, int], seed: int) -> DataFrame:
    size = max(SHARD, -(-sum(totals.values()) // MAX_SHARDS))
    shards = F.create_map(*[F.lit(x) for s, n in totals.items() for x in (s, max(1, -(-n // size)))])
    return counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), shards[F.col("source")]).cast("int"))


def plan_mix(sources: DataFrame, targets: DataFrame, total: int, block: int = BLOCK) -> list[dict]:
    """A dict for each target: source, target_share, max_repeats, source_tokens, seats, quota_tokens.

    sources: (source, n_tokens). Seats are handed out as if every source were large enough; what a source cannot fill
    with max_repeats copies of itself stays open, so that the others keep their share of ``total`` exactly.
    Targets of one source repeated count once, with the greatest share and the most repeats; nulls count as 0.
    """
    rows = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    known = [r.asDict() for r in rows.join(sources, "source", "left").orderBy("source").collect()]  # one row a source
    seats = apportion(np.array([r["target_share"] for r in known], float), round(total / block * min(1.0, sum(r["target_share"] for r in known))))
    for r, n in zip(known, seats):
        r["source_tokens"] = r.pop("n_tokens") or 0
        r["seats"] = int(n)
        r["quota_tokens"] = min(int(n) * block, r["max_repeats"] * r["source_tokens"])
    return known


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = 17, block: int = BLOCK, vocab: str | None = None) -> tuple[DataFrame, list[dict], int]:
    """((doc_id, source, n_tokens, copies) of each document of the mix, the plan, all tokens of docs).

    docs: doc_id, source, text. Documents without tokens or of a source without target are in no mix, but their tokens
    count in the total. Repeated rows are documents of their own. Empty inputs give an empty mix.
    """
    spark = docs.sparkSession
    counted = written(token_counts(docs.select("doc_id", "source", "text"), vocab=vocab), "tokens")
    sources = counted.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    total = sources.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    plan = plan_mix(sources, targets, total, block)
    used = {r["source"]: r["source_tokens"] for r in plan if r["quota_tokens"] > 0}
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("passes", T.IntegerType()), T.StructField("rest", T.LongType())])
    if not used:
        return counted.limit(0).withColumn("copies", F.lit(0)), plan, total
    placed = _sharded(counted.where(F.col("source").isin(list(used)) & (F.col("n_tokens") > 0)), used, seed)
    sizes = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect()  # MAX_SHARDS and as many as sources at most
    quotas = []
    for r in plan:
        own = sorted((x for x in sizes if x["source"] == r["source"]), key=lambda x: x["shard"])
        if not own or r["quota_tokens"] <= 0:
            continue
        n = np.array([x["n"] for x in own])
        seats = apportion(n, -(-r["quota_tokens"] // block), -(-(r["max_repeats"] * n) // block))
        for x, s, size in zip(own, seats, n):
            tokens = min(int(s) * block, r["max_repeats"] * int(size))
            quotas.append((x["source"], x["shard"], tokens // int(size), tokens % int(size)))
    ordered = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    chosen = placed.join(F.broadcast(spark.createDataFrame(quotas, schema)), ["source", "shard"])
    chosen = chosen.withColumn("_middle", F.sum("n_tokens").over(ordered) - F.col("n_tokens") / 2)
    chosen = chosen.withColumn("copies", F.col("passes") + (F.col("_middle") <= F.col("rest")).cast("int"))
    return chosen.where("copies > 0").select("doc_id", "source", "n_tokens", "copies"), plan, total


def shares(mixed: DataFrame, plan: list[dict], total: int) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, quota_tokens, mixed_tokens, most_copies, share_of_mix, share_of_total) for each target."""
    spark = mixed.sparkSession
    kinds = "source string, target_share double, max_repeats int, source_tokens long, quota_tokens long"
    rows = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["source_tokens"], r["quota_tokens"]) for r in plan], kinds)
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    out = rows.join(reached, "source", "left").na.fill(0, ["mixed_tokens", "most_copies"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # one row a source
    return out.withColumn("share_of_mix", F.try_divide(F.col("mixed_tokens"), whole)).withColumn("share_of_total", F.try_divide(F.col("mixed_tokens"), F.lit(total)))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(documents(spark, d), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(*mix(documents(spark, d), table(spark, d, "mix_targets")))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """For each target, whether no document is in the mix too often, and whether its tokens are its quota but for the documents that stand at a shard's end."""
    mixed, plan, total = mix(documents(spark, d), table(spark, d, "mix_targets"))
    longest = mixed.groupBy("source").agg(F.max("n_tokens").alias("_longest"))
    out = shares(mixed, plan, total).join(longest, "source", "left").na.fill(0, ["_longest"])
    shards = F.ceil(F.col("source_tokens") / max(SHARD, -(-total // MAX_SHARDS))) + 1
    return out.select("source", "target_share", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("mixed_tokens") - F.col("quota_tokens")) <= shards * (F.col("_longest") + BLOCK)).alias("at_quota"))


QUERIES = {f.__name__: f for f in (p8_mix, p8_shares, p8_limits)}
