"""Top-k, quotas, samples, splits and experiment designs.  All chance is a hash of seed and key, so that results do not
depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chance(seed: int, *keys: str) -> Column:
    """A text that orders rows at random, the same way every time."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def ranked(df: DataFrame, groups: list[str], order: list[Column | str], out: str) -> DataFrame:
    """``out``: 1, 2, 3 and so on by ``order`` within groups, none of which has to fit into one task.

    Rows are sorted by ranges of groups and order; a row's rank is its place in its partition and the number of its group's
    rows in those before.  ``order`` should end with a key, so that ranks do not depend on partitions.  Ranges are drawn from
    a sample, another one each time, so places are written once and read by both sides of the join.
    """
    from .dedup import cut

    sorts = [F.col(g) if isinstance(g, str) else g for g in [*groups, *order]]
    placed = cut(df.repartitionByRange(*sorts).sortWithinPartitions(*sorts).withColumns({"p_": F.spark_partition_id(), "m_": F.monotonically_increasing_id()}), "places")
    counts = placed.groupBy("p_", *groups).agg(F.min("m_").alias("first_"), F.count("*").alias("here_"))
    # A row for each partition and group in it: partitions and groups together at most.
    before = F.sum("here_").over(Window.partitionBy(*groups).orderBy("p_")) - F.col("here_")
    base = counts.select(F.col("p_").alias("q_"), *[F.col(g).alias(f"g_{i}") for i, g in enumerate(groups)], (before - F.col("first_")).alias("base_"))
    same = F.col("p_") == F.col("q_")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"g_{i}"))
    return placed.join(base, same).withColumn(out, F.col("m_") + F.col("base_") + 1).select(*df.columns, out)


def top_k(df: DataFrame, group: str, score: str, tie: list[Column], k: int, least: float) -> DataFrame:
    """``selection``: low_score, below_top_k or selected_top_k."""
    known = df.withColumn("enough_", F.col(score) >= least)
    placed = ranked(known, [group, "enough_"], [F.col(score).desc(), *tie], "rank_")
    chosen = F.when(~F.col("enough_"), "low_score").when(F.col("rank_") <= k, "selected_top_k").otherwise("below_top_k")
    return placed.withColumn("selection", chosen).drop("enough_", "rank_")


def quota(df: DataFrame, group: str, order: list[Column], n: int, seed: int, key: str) -> DataFrame:
    """Of each group the first half of ``n`` (rounded up) by ``order``, the rest drawn at random."""
    head = n // 2 + n % 2
    first = ranked(df, [group], [*order, key], "rank_").withColumn("part", F.when(F.col("rank_") <= head, "head").otherwise("tail"))
    # Only the first few of a draw are kept, so each task passes on no more than these (group limit).
    drawn = F.row_number().over(Window.partitionBy(group, "part").orderBy(chance(seed, key), key))
    return first.withColumn("draw_", drawn).where(F.col("draw_") <= F.greatest(F.lit(head), F.lit(n - head))).where((F.col("part") == "head") | (F.col("draw_") <= n - head)).drop("rank_", "draw_")


def capped(df: DataFrame, group: str, caps: dict[str, int], order: list[Column], seed: int, key: str) -> DataFrame:
    """Of each group with a cap all rows if they are no more, else the first half (rounded up, at least one) by ``order`` and
    the rest drawn at random; other groups go."""
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col(group))
    known = df.withColumn("cap_", cap).where("cap_ is not null")
    head = F.greatest(F.lit(1), F.ceil(F.col("cap_") / 2))
    ranked = known.withColumn("rank_", F.row_number().over(Window.partitionBy(group).orderBy(*order, key)))
    # Only ranks up to the cap matter for the head; the draw ranks what is left.
    ranked = ranked.withColumn("head_", F.col("rank_") <= head)
    drawn = F.row_number().over(Window.partitionBy(group, "head_").orderBy(chance(seed, key), key))
    taken = (F.col("head_") | (F.col("draw_") <= F.col("cap_") - head)) & (F.col("cap_") > 0)
    return ranked.withColumn("draw_", drawn).where(taken).select(*df.columns)


def balanced_top_up(df: DataFrame, group: str, categories: list[str], total: int, score: str, seed: int, key: str) -> DataFrame:
    """At most ``total`` rows: even caps for the categories, the first ones getting the rest, then the best of what is left of any group."""
    caps = {c: total // len(categories) + (i < total % len(categories)) for i, c in enumerate(categories)}
    order = [F.col(score).desc()]
    counts = {r[group]: r["count"] for r in df.where(F.col(group).isin(*categories)).groupBy(group).count().collect()}
    chosen = capped(df, group, caps, order, seed, key)
    left = total - sum(min(caps[c], counts.get(c, 0)) for c in categories)
    if left <= 0:
        return chosen
    rest = df.join(chosen.select(F.col(key).alias("taken_")), F.col(key) == F.col("taken_"), "left_anti")
    return chosen.unionByName(rest.orderBy(*order, key).limit(left))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), drawn at random."""
    return df.orderBy(chance(seed, key), key).limit(n)


def diverse(df: DataFrame, group: str, image: str, order: list[Column], n: int, seed: int, key: str) -> DataFrame:
    """At most ``n`` rows of each group: the best of each image first, then others at random."""
    best = F.row_number().over(Window.partitionBy(group, image).orderBy(*order, key)) == 1
    marked = df.withColumn("best_", best)
    # Only the first n are kept, so each task passes on no more than these (group limit).
    turn = Window.partitionBy(group).orderBy(F.col("best_").desc(), F.when(F.col("best_"), F.lit("")).otherwise(chance(seed, key)), *order, key)
    return marked.withColumn("turn_", F.row_number().over(turn)).where(F.col("turn_") <= n).drop("turn_").withColumnRenamed("best_", "best_of_image")


def balanced(df: DataFrame, flag: str, n: int, seed: int, key: str) -> DataFrame:
    """Half of ``n`` rows with the flag and half without; each task passes on no more than these (group limit)."""
    rank = F.row_number().over(Window.partitionBy(flag).orderBy(chance(seed, key), key))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= n // 2).drop("rank_")


def best_by(df: DataFrame, group: str, score: Column, position: list[str]) -> DataFrame:
    """The row with the greatest score in each group, the first of equals."""
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), *position)
    return df.withColumn("score", score).withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def detection_score(conf: Column, w: Column, h: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Confidence by the root of the area, less for boxes away from the centre."""
    away = F.abs(cx - width / 2) / width + F.abs(cy - height / 2) / height
    return conf * F.sqrt(w * h) * (F.lit(1.0) - F.lit(0.35) * away)


def pages(df: DataFrame, order: list[Column | str], size: int, by: str) -> DataFrame:
    """``page`` and ``tile`` numbers from 0 within ``by``."""
    n = F.col("n_") - 1
    return ranked(df, [by], order, "n_").withColumns({"page": F.floor(n / size).cast("int"), "tile": (n % size).cast("int")}).drop("n_")


def stride(df: DataFrame, sequence: str, order: list[str], step: int) -> DataFrame:
    """Every ``step``-th row of each sequence, from the first."""
    n = F.row_number().over(Window.partitionBy(sequence).orderBy(*order))
    return df.withColumn("n_", n).where(F.expr(f"(n_ - 1) % {step} = 0")).drop("n_")


def stratified_split(
    df: DataFrame, stratum: str, key: str, seed: int, train: float = 0.70, val: float = 0.15, rounded: bool = False, most: int | None = None, most_each: int | None = None
) -> DataFrame:
    """``split``: train, val or test in each stratum; shares are cut down (or rounded to even halves), the rest is test.

    ``most`` rows of the whole table, or ``most_each`` of each stratum, are drawn before the split.
    """
    if most is not None:
        df = sample(df, most, seed, key)
    placed = ranked(df, [stratum], [chance(seed, key), key], "rank_")
    if most_each is not None:
        placed = placed.where(F.col("rank_") <= most_each)
    sizes = placed.groupBy(F.col(stratum).alias("of_")).agg(F.count("*").alias("n_"))
    whole = (lambda c: F.bround(c)) if rounded else F.floor
    first, second = whole(F.col("n_") * train), whole(F.col("n_") * val)
    split = F.when(F.col("rank_") <= first, "train").when(F.col("rank_") <= first + second, "val").otherwise("test")
    return placed.join(sizes, F.col(stratum).eqNullSafe(F.col("of_"))).withColumn("split", split).select(*df.columns, "split")


def repeated(position: Column, total: int, values: list) -> Column:
    """The value at a position when ``total`` places are dealt out evenly, the first values getting the rest."""
    base, extra = divmod(total, len(values))
    out, upto = None, 0
    for i, v in enumerate(values):
        upto += base + (1 if i < extra else 0)
        out = F.when(position < upto, F.lit(v)) if out is None else out.when(position < upto, F.lit(v))
    return out


def balanced_schedule(df: DataFrame, key: str, total: int, axes: dict[str, list], seed: int, by: str | None = None) -> DataFrame:
    """A level of each axis for each row; every axis is shuffled by itself, so its levels are balanced."""
    out = df
    for i, (name, values) in enumerate(axes.items()):
        out = ranked(out, [by] if by else [], [chance(seed + i, key), key], "place_").withColumn(name, repeated(F.col("place_") - 1, total, values)).drop("place_")
    return out


def assign_by_ratio(df: DataFrame, key: str, total: int, ratios: dict[str, float], seed: int) -> DataFrame:
    """``subset`` by shares of ``total``; what rounding leaves goes to the first subsets, one each."""
    names = list(ratios)
    counts = [int(total * r) for r in ratios.values()]
    for i in range(total - sum(counts)):
        counts[i % len(counts)] += 1
    out, upto = None, 0
    for n, c in zip(names, counts):
        upto += c
        out = F.when(F.col("place_") <= upto, n) if out is None else out.when(F.col("place_") <= upto, n)
    return ranked(df, [], [chance(seed, key), key], "place_").withColumn("subset", out.otherwise(names[-1])).drop("place_")


def pick(seed: int, key: str, what: str, n: Column | int) -> Column:
    """A number below ``n`` for each key, by the first 8 hex digits of a hash."""
    text = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.lit(what)), 256)
    return F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def expand_counts(df: DataFrame, count: str, out: str = "copy") -> DataFrame:
    """``count`` rows for each row, numbered from 0."""
    return df.where(F.col(count) > 0).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)))


def rejection_placement(df: DataFrame, key: str, seed: int, x_range: tuple[int, int], y_range: tuple[int, int], w: str, other: tuple[str, str, str, str], attempts: int = 50) -> DataFrame:
    """A place that overlaps ``other`` by at most 0.05 and lies 20 pixels or more from its centre: the first of
    ``attempts`` hashed tries that does, or the last."""
    from ..functions.geometry import centre_distance, iou

    tries = df.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    text = lambda axis: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("attempt").cast("string"), F.lit(axis)), 256), 1, 8), 16, 10).cast("long")
    x = F.pmod(text("x"), F.lit(x_range[1] - x_range[0] + 1)) + x_range[0]
    y = F.pmod(text("y"), F.lit(y_range[1] - y_range[0] + 1)) + y_range[0]
    tries = tries.withColumns({"px": x, "py": y})
    mine = (F.col("px"), F.col("py"), F.col(w), F.col(w))
    theirs = tuple(F.col(c) for c in other)
    good = (iou(mine, theirs) <= 0.05) & (centre_distance(mine, theirs) >= 20)
    choice = F.coalesce(F.min(F.when(F.col("good_"), F.struct("attempt", "px", "py"))), F.max(F.struct("attempt", "px", "py")))
    chosen = tries.withColumn("good_", good).groupBy(key).agg(choice.alias("c"))
    return chosen.select(key, F.col("c.attempt").alias("attempt"), F.col("c.px").alias("px"), F.col("c.py").alias("py"))
