"""Links between similar sets that share a bucket, verified by exact Jaccard similarity.

Sets come as sorted arrays of 64-bit shingle hashes.  Buckets of up to ``MEMBERS`` members and ``ELEMENTS`` elements are compared in
one task each.  Larger ones are first compared with their centre, the member with the least number, by a join that Spark can split.  Members that
the centre does not reach, and those near it that the triangle inequality lets them link with, are compared with those that share one of their rarest shingles: two sets at the threshold
always share one among the first few in any common order (prefix filter), and rare ones first keep the groups small.
Groups that are still large are dealt out in tiles.  No link between components is lost on either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Maybe, Scratch, tidy

#: Members of buckets whose elements are counted before one task compares them.
CROWD = 256
#: Members, and elements of their sets, that one task compares without further division: some 50 MB of arrays.
MEMBERS, ELEMENTS = 4096, 1 << 20
#: Members that sets compare sooner than arrays.
FEW = 12
#: Members of one side of a tile.
TILE = 512


def _reaches(threshold: float, both: str, one: str, two: str) -> F.Column:
    return F.expr(f"{both} >= {threshold!r}D * ({one} + {two} - {both})")


def _links_of_few(cls: list[int], near: list[bool], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """As ``_links_of_many``, by sets."""
    own = [set(x.tolist()) for x in sets]
    part, out = [-1 if x else i for i, x in enumerate(near)], []
    for i in range(1, len(own)):
        for j in range(i):
            if part[i] == part[j]:
                continue
            both = len(own[i] & own[j])
            if both >= threshold * (len(own[i]) + len(own[j]) - both):
                out.append((cls[j], cls[i]))
                part = [part[j] if x == part[i] else x for x in part]
    return out


def _links_of_many(cls: list[int], near: list[bool], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join different parts of a group, whose members come by size; those that are ``near`` are one part from the start.

    A part grows by all members left that one of its own reaches, each of which is then compared with those still left.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of a single member meet nothing.
    shared = times[at] > 1
    at, owner = at[shared].astype(np.int32), np.repeat(np.arange(len(sets)), size)[shared]
    count = np.bincount(owner, minlength=len(sets))
    edge = np.concatenate(([0], np.cumsum(count)))
    near, mark, out = np.array(near), np.zeros(len(value), np.int32), []
    grown = np.flatnonzero(near & (count > 0)).tolist()
    left = np.flatnonzero(~near & (count > 0))
    held = at[~near[owner]]
    first = np.concatenate(([0], np.cumsum(count[left])))
    while len(left):
        if grown:
            c = grown.pop()
        else:
            c, left, first = int(left[0]), left[1:], first[1:]
        a, z = np.searchsorted(size[left], (threshold * size[c] * (1 - 1e-12), size[c] / threshold * (1 + 1e-12)), "left")
        if a == z:
            continue
        own = at[edge[c] : edge[c + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[held[first[a] : first[z]]], first[a:z] - first[a])
        mark[own] = 0
        hit = np.flatnonzero(both >= threshold * (size[c] + size[left[a:z]] - both)) + a
        if len(hit):
            reached = left[hit].tolist()
            out += [(cls[c], cls[v]) for v in reached]
            grown += reached
            stays = np.ones(len(left), bool)
            stays[hit] = False
            held = held[first[0] : first[-1]][np.repeat(stays, np.diff(first))]
            left = left[stays]
            first = np.concatenate(([0], np.cumsum(count[left])))
    return out


def _compare(rows: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Links that join different parts of a group; members that are ``near`` are one part from the start."""

    def links(members: list[tuple]) -> list[tuple[int, int]]:
        return (_links_of_few if len(members) <= FEW else _links_of_many)(*zip(*members), threshold) if len(members) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, [], []
        for b in batches:
            keys = zip(*[b.column(g).to_pylist() for g in group])
            edges, flat = b.column("sh").offsets.to_numpy(), b.column("sh").values.to_numpy()
            for i, (key, cls, near) in enumerate(zip(keys, b.column("cls").to_pylist(), b.column("near").to_pylist())):
                if key != now:
                    out += links(members)
                    now, members = key, []
                members.append((cls, near, flat[edges[i] : edges[i + 1]]))
            if out:
                yield _link_rows(out)
                out = []
        if out := links(members):
            yield _link_rows(out)

    sorted_rows = rows.repartition(*group).sortWithinPartitions(*group, F.size("sh"), "cls")
    return sorted_rows.select(*group, "cls", "near", "sh").mapInArrow(tidy(run), "u long, v long")


def _link_rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
    uv = np.array(links, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])


def _prefixes(members: DataFrame, threshold: float) -> DataFrame:
    """``members`` under each shingle of their prefixes (``part``), rarest shingles of the bucket first."""
    least = members.groupBy("key").agg(F.min(F.size("sh")).alias("least"))
    shingles = members.select("key", "cls", F.size("sh").alias("n"), F.explode("sh").alias("part"))
    often = shingles.groupBy("key", "part").agg(F.count("*").alias("times"))
    ranked = shingles.join(often, ["key", "part"]).where("times > 1")
    # Shingles that a single member holds come first in the order and lead nowhere: only their number counts.
    several = ranked.groupBy("key", "cls").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("times", "part"))).alias("shared"))
    # A set links with none smaller than the threshold's share of it.
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.greatest("least", F.col("n") * threshold)) - 1e-9)
    kept = several.join(least, "key").withColumn("many", (F.size("shared") - need + 1).cast("int"))
    return kept.where("many > 0").select("key", "cls", F.explode(F.expr("slice(shared.part, 1, many)")).alias("part"))


def _crowded(members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links of the members of large buckets."""
    centres = members.groupBy("key").agg(F.min_by("sh", "cls").alias("middle"), F.min("cls").alias("centre"))
    both = members.join(centres, "key").withColumn("both", F.size(F.array_intersect("sh", "middle")))
    away = F.expr("1D - both / (size(sh) + size(middle) - both)").alias("away")
    starred = scratch.stage(
        both.select("key", "cls", "sh", "centre", away, _reaches(threshold, "both", "size(sh)", "size(middle)").alias("near")),
        "starred",
    )
    links = starred.where("near and cls <> centre").select(F.col("centre").alias("u"), F.col("cls").alias("v"))
    apart = starred.where("not near").groupBy("key").agg(F.min("away").alias("nearest"))
    # Jaccard distance is a metric: a member that links with one apart is as far from the centre, less that link's length, at least.
    rest = starred.join(apart, "key").where(F.expr(f"not near or away >= nearest - {1 - threshold!r}D - 1e-9D")).drop("nearest")
    if rest.isEmpty():
        return links
    under = scratch.stage(_prefixes(rest, threshold).join(rest.select("key", "cls", "near"), ["key", "cls"]), "prefixes")
    groups = under.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("near").alias("all_near")).where("n > 1 and not all_near")
    groups = groups.select("key", "part", F.ceil(F.col("n") / TILE).alias("tiles"))
    placed = under.join(groups, ["key", "part"]).withColumn("own", F.pmod(F.xxhash64("cls"), "tiles"))
    tiles = placed.withColumn("every", F.explode(F.expr("sequence(0L, tiles - 1)")))
    tiles = tiles.select("key", "cls", "near", "part", F.least("own", "every").alias("i"), F.greatest("own", "every").alias("j"))
    sides = tiles.join(rest.select("key", "cls", "sh"), ["key", "cls"])
    return links.unionByName(_compare(sides, ["key", "part", "i", "j"], threshold))


def bucket_rows(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """``key``, ``cls`` and ``crowd`` of the buckets that hold different classes, once each, from ``key`` and ``cls``.

    Of buckets with the same members one stays: near copies share most of their bands.
    """
    shared = postings.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("key")
    shared = scratch.stage(shared, "buckets")
    met = scratch.stage(Maybe(shared).of(postings, "key").join(shared, "key").distinct(), "met")
    mixed = F.xxhash64(F.col("cls"), F.lit(1))
    marks = met.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(cls)").alias("x"), F.bit_xor(mixed).alias("y"), F.min("cls").alias("least"))
    kept = marks.groupBy("n", "x", "y", "least").agg(F.min("key").alias("key")).select("key", (F.col("n") > CROWD).alias("crowd"))
    return scratch.stage(met.join(kept, "key"), "kept")


def _linked(plain: DataFrame, crowd: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    links = scratch.stage(_compare(plain.withColumn("near", F.lit(False)), ["key"], threshold), "plain")
    return links if crowd.isEmpty() else links.unionByName(_crowded(crowd, threshold, scratch))


def _staged(members: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members of plain and of crowded buckets."""
    members = scratch.stage(members.where("size(sh) > 0").select("key", "cls", "sh", "crowd"), "members")
    return members.where("not crowd").drop("crowd"), members.where("crowd").drop("crowd")


def similar_links(members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links ``u``, ``v`` that connect all ``cls`` that share a ``key`` and whose sets ``sh`` reach the similarity.

    ``members`` has ``key``, ``cls``, ``sh`` (sorted distinct longs) and ``crowd``, true in all rows of a bucket that is to be
    divided.  A set without elements links with nothing.  Repeated rows do no harm.
    """
    return _linked(*_staged(members, scratch), threshold, scratch)


def bucket_links(members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """As ``similar_links``, but of the buckets with ``crowd`` only those are divided that are too large for one task."""
    plain, crowd = _staged(members, scratch)
    sums = crowd.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("sh")).alias("elements"))
    sums = scratch.stage(sums.select("key", F.expr(f"n > {MEMBERS} or elements > {ELEMENTS}").alias("large")), "sums")
    part = lambda condition: crowd.join(sums.where(condition).select("key"), "key")
    return _linked(plain.unionByName(part("not large")), part("large"), threshold, scratch)
