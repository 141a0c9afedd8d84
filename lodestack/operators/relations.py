"""Joins with fallbacks, upserts, set differences and validation of packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``ids``."""
    return df.join(ids, key, "left_semi")


def missing(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The ids that ``df`` does not have."""
    return ids.join(df, key, "left_anti")


def last_of(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """A lookup table in which later duplicates win."""
    return df.groupBy(key).agg(F.max_by(value, position).alias(value))


def fallback_join(left: DataFrame, lookups: list[tuple[Column, DataFrame, str]], value: str, out: str) -> DataFrame:
    """``out`` from the first lookup that knows a row: each is (key of the left row, table, its key)."""
    now = left
    names = []
    for i, (key, table, name) in enumerate(lookups):
        side = table.select(F.col(name).alias(f"k_{i}"), F.col(value).alias(f"v_{i}"))
        now = now.join(side, key == F.col(f"k_{i}"), "left").drop(f"k_{i}")
        names.append(f"v_{i}")
    return now.withColumn(out, F.coalesce(*names)).drop(*names)


def upsert(new: DataFrame, old: DataFrame, key: str, human: list[str]) -> DataFrame:
    """``new`` rows, in which what people have filled in before is kept."""
    side = old.select(F.col(key).alias("k_"), *[F.col(c).alias("old_" + c) for c in human])
    joined = new.join(side, F.col(key) == F.col("k_"), "left")
    return joined.select(*[F.coalesce(F.when(F.trim("old_" + c) != "", F.col("old_" + c)), F.col(c)).alias(c) if c in human else F.col(c) for c in new.columns])


def resolve_paths(df: DataFrame, key: str, candidates: list[str], listing: DataFrame, path: str = "path") -> DataFrame:
    """``resolved``: the first of a row's candidate paths that exists, or null."""
    spread = df.select(key, F.posexplode(F.array(*candidates)).alias("n", "c")).where("c is not null and trim(c) <> ''")
    there = spread.join(listing.select(F.col(path).alias("c")).distinct(), "c", "left_semi")
    return df.join(there.groupBy(key).agg(F.min_by("c", "n").alias("resolved")), key, "left")


def checks(df: DataFrame, rules: dict[str, tuple[str, str]], unique: list[str]) -> DataFrame:
    """``check, level, n``: how many rows break each rule (level, condition), and how many repeat a unique column.

    One pass for the rules and one aggregation for each unique column; rules that nothing breaks are listed with 0.
    """
    counts = df.agg(*[F.count_if(F.expr(condition)).alias(name) for name, (_, condition) in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(level).alias("level"), F.col(n).alias("n")) for n, (level, _) in rules.items()])).alias("r")
    out = counts.select(rows).select("r.check", "r.level", "r.n")
    for c in unique:
        again = df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
        out = out.unionByName(again.select(F.lit(f"duplicate_{c}").alias("check"), F.lit("error").alias("level"), "n"))
    return out


def append_once(path: str, rows: DataFrame, keys: list[str], into: str) -> DataFrame:
    """Stored rows with those of the same keys replaced, written to the new folder ``into`` and read from there.

    Running it twice changes nothing.  The old folder stays whole until the caller points readers to the new one.
    """
    if into.rstrip("/") == path.rstrip("/"):
        raise ValueError("a table cannot be overwritten while it is read")
    spark = rows.sparkSession
    old = spark.read.schema(rows.schema).parquet(path)
    old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows).write.mode("overwrite").parquet(into)
    return spark.read.schema(rows.schema).parquet(into)


def ids_in_order(df: DataFrame, order: list[Column | str], pattern: str, out: str, first: int = 0) -> DataFrame:
    """Identifiers numbered from ``first`` in an order, by a global sort without a window over all rows."""
    from .selection import ranked

    return ranked(df, [], order, "n_").withColumn(out, F.format_string(pattern, F.col("n_") + (first - 1))).drop("n_")
