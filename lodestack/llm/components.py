"""Connected components of a link table, without collecting links anywhere.

Rounds of large-star and small-star: every node's neighbours are hung on its smallest
neighbour, until no row changes.  Each round is two aggregations with fixed-size buffers and
two joins, written to the shared folder; the number of rounds grows with the logarithm of the
longest chain.  Least neighbours are dealt out anew before they are joined, so both sides of a join are plain
shuffles and Spark splits a hub's rows over tasks (skew join); nothing above the joins needs keys together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stage


def _spread(least: DataFrame) -> DataFrame:
    return least.hint("rebalance")


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _spread(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    )


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _spread(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``root``, the smallest node that links reach, for every linked node.

    ``edges`` has two long columns; their order, repeats, self links and nulls do not matter:
    nulls and self links are left out.  No edges give no rows.
    """
    with Scratch(edges.sparkSession, "components") as scratch:
        now = scratch.stage(
            edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(f"{u} is not null and {v} is not null and u <> v").distinct(),
            "edges",
        )
        seen, turn = None, 0
        while True:
            now = scratch.stage(_small(_large(now)), f"turn{turn}")
            scratch.drop(f"turn{turn - 1}" if turn else "edges")
            mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
            if mark == seen:
                break
            seen, turn = mark, turn + 1
        roots = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return stage(roots, "roots")
