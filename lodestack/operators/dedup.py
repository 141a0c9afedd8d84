"""Exact duplicates, and near-duplicate clustering of 64-bit perceptual hashes.

First-fit clustering (a row joins the first earlier representative within the distance) equals the lexicographically first
maximal independent set: a row is a representative if no earlier representative is within the distance.  Pairs come from
a banded equi-join, as hashes within t bits share at least one of t + 1 bands, and rows are decided in rounds: a row
is settled when all its earlier neighbours are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes; 64 if either is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(64))


def hash_of_hex(c: Column) -> Column:
    """A signed long from 16 hex digits; null if empty."""
    word = lambda at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.when(F.length(c) == 16, F.shiftleft(word(1), 32).bitwiseOR(word(9)))


def near_pairs(df: DataFrame, key: str, hash_col: str, most: int, within: str | None = None) -> DataFrame:
    """``a, b, d``: pairs with key a < b whose hashes differ in at most ``most`` bits (and whose ``within`` is equal)."""
    n = most + 1
    edges = [round(i * 64 / n) for i in range(n + 1)]
    bands = []
    for i in range(n):
        mask = ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
        bands.append(F.struct(F.lit(i).alias("band"), F.col(hash_col).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    groups = [F.col(within)] if within else [F.lit(0)]
    posted = df.where(F.col(hash_col).isNotNull()).select(F.col(key).alias("k"), F.col(hash_col).alias("h"), *[g.alias("g") for g in groups], F.explode(F.array(*bands)).alias("p"))
    left = posted.select("g", "p.band", "p.bits", F.col("k").alias("a"), F.col("h").alias("ha"))
    right = posted.select("g", "p.band", "p.bits", F.col("k").alias("b"), F.col("h").alias("hb"))
    pairs = left.join(right, ["g", "band", "bits"]).where("a < b").withColumn("d", distance(F.col("ha"), F.col("hb")))
    return pairs.where(F.col("d") <= most).select("a", "b", "d").distinct()


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """Written to the shared folder and read back: rounds do not pile up, and what depends on partitions is computed once."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/lodestack/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_fit(df: DataFrame, key: str, hash_col: str, most: int, within: str | None = None) -> DataFrame:
    """``key`` and ``representative``: the first earlier representative within ``most`` bits, or the row itself.

    Order is that of ``key``, which must be unique.  Rows without a hash are on their own.
    """
    pairs = cut(near_pairs(df, key, hash_col, most, within).select("a", "b"))
    settled = None  # k, rep: rows in pairs that are decided
    open_ = cut(pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct())
    while not open_.isEmpty():
        earlier = pairs.join(open_.withColumnRenamed("k", "b"), "b")
        if settled is None:
            state = earlier.withColumn("rep", F.lit(None).cast("boolean")).withColumn("done", F.lit(False))
        else:
            state = earlier.join(settled.select(F.col("k").alias("a"), "rep"), "a", "left").withColumn("done", F.col("rep").isNotNull())
        verdict = state.groupBy("b").agg(F.coalesce(F.bool_or(F.col("rep")), F.lit(False)).alias("covered"), F.bool_and("done").alias("all_done"))
        now = open_.join(verdict.withColumnRenamed("b", "k"), "k", "left").select(
            "k",
            F.when(F.col("covered").isNull(), True).when(F.col("covered"), False).when(F.col("all_done"), True).alias("rep"),
        )
        now = cut(now)
        fresh = now.where("rep is not null")
        settled = fresh if settled is None else cut(settled.unionByName(fresh))
        open_ = now.where("rep is null").select("k")
    if settled is None:
        return df.select(key, F.col(key).alias("representative"))
    reps = settled.where("rep").select(F.col("k").alias("a"))
    joined = pairs.join(reps, "a").groupBy("b").agg(F.min("a").alias("first_rep")).join(settled.where("not rep").select(F.col("k").alias("b")), "b")
    return df.select(key).join(joined.withColumnRenamed("b", key), key, "left").select(key, F.coalesce("first_rep", key).alias("representative"))


def keep_last(df: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """The last row of each key.  Rows combine before they are shuffled, so a key may have any number of them."""
    others = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*position)).alias("last_")
    return df.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"last_.{c}").alias(c) for c in df.columns])


def numbered_ids(df: DataFrame, base: str, order: list[str], out: str = "unique_id") -> DataFrame:
    """``base``, ``base_1``, ``base_2`` and so on for repeated bases."""
    from .selection import ranked

    n = F.col("n_") - 1
    return ranked(df, [base], order, "n_").withColumn(out, F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string")))).drop("n_")
