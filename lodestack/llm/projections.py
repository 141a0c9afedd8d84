"""Operator 7: embedding near-duplicates by sorted projection passes.

Equal vectors collapse first, by a digest.  Each pass orders the different vectors lexicographically by a
concatenation of random hashes (signs of projections on random directions) and compares each with the
next ``window`` in that order.  Passes carry 8-bit codes of the vectors and how far off these are, which settles nearly all pairs; the few
that are too close to the threshold to tell are compared on the vectors, joined once.  Pairs at or above the threshold are united over all passes.  Passes hand on only
links that join two groups of the rows at hand, so a group of thousands of near copies yields a row for each
member and not one for each pair.  Numbers of direct links are then counted exactly inside the components, in
tiles of bounded size, of which only counts leave.

Large or crowded tables need more passes and wider windows than small ones: rounds of new passes follow, each with a
window twice as wide, until a round joins no two components that were apart.  Windows do not cross partition borders,
which lie elsewhere in every pass; see the README for measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, small_batches, stage
from .components import components
from .neighbours import _inner, vectors_of

PASSES = 16
BITS = 48
WINDOW = 48
#: Passes of each round after the first.
MORE = 8
TILE_ROWS = 512
#: Rows of a block of the window products.
BLOCK = 512


def _usable(v: str) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    big = f"exists({v}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return F.expr(f"{v} is not null and not coalesce({big}, true) and exists({v}, x -> x <> 0)")


def _unit(column: pa.Array) -> np.ndarray:
    x = np.array(vectors_of(column))
    return x / np.sqrt(_inner(x, x))[:, None]


def _sorted_passes(classes: DataFrame, passes: int, bits: int, seed: int, turn: int = 0) -> DataFrame:
    """Every class under its key in every pass of a round, with the code of its unit vector, the code's scale and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            vs = vectors_of(b.column("v"))
            cls = b.column("cls").to_numpy()
            for dim in sorted({len(v) for v in vs}):
                rows = [i for i, v in enumerate(vs) if len(v) == dim]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim, turn] if turn else [seed, dim]).standard_normal((dim, passes * bits))
                x = np.array([vs[i] for i in rows])
                keys = ((x @ planes[dim]) >= 0).reshape(len(rows), passes, bits) @ weight
                x /= np.sqrt(_inner(x, x))[:, None]
                scale = (np.abs(x).max(1) / 127).astype(np.float32)
                code = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
                # Rounded up a little, as it is kept in 32 bits.
                off = (np.linalg.norm(x - code * scale[:, None].astype(np.float64), axis=1) + 1e-6).astype(np.float32)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                for p in range(passes):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p << 16 | dim, np.int32)), pa.array(keys[:, p]), pa.array(cls[rows]), codes, pa.array(scale), pa.array(off)],
                        names=["run", "key", "cls", "code", "scale", "off"],
                    )

    return classes.select("cls", "v").mapInArrow(run, "run int, key long, cls long, code binary, scale float, off float")


def _window_links(rows: DataFrame, threshold: float, window: int) -> DataFrame:
    """Links within windows of sorted rows that join different groups of a batch, and pairs that codes cannot settle (not ``sure``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            run_of, cls = b.column("run").to_numpy(), b.column("cls").to_numpy()
            scale, off = b.column("scale").to_numpy().astype(np.float64), b.column("off").to_numpy().astype(np.float64)
            for r in dict.fromkeys(run_of.tolist()):
                at = np.flatnonzero(run_of == r)
                x = np.frombuffer(b"".join(b.column("code").take(pa.array(at)).to_pylist()), np.int8).reshape(len(at), -1) * scale[at, None]
                c, e = cls[at], off[at]
                if held is not None and held[0] == r:
                    x, c, e = np.concatenate((held[2], x)), np.concatenate((held[1], c)), np.concatenate((held[3], e))
                old = len(c) - len(at)
                root: dict[int, int] = {}

                def find(i: int) -> int:
                    while (up := root.get(i, i)) != i:
                        root[i] = root.get(up, up)
                        i = up
                    return i

                out = []
                for s in range(max(0, old - window), len(c) - 1, BLOCK):
                    z, upto = min(s + BLOCK, len(c)), min(s + BLOCK + window, len(c))
                    new = max(s, old)  # pairs of old rows were compared before
                    near = x[s:z] @ x[new:upto].T
                    slack = e[s:z, None] + e[None, new:upto] * (1 + e[s:z, None])
                    apart = np.arange(new, upto)[None, :] - np.arange(s, z)[:, None]
                    open_ = (near + slack >= threshold) & (apart > 0) & (apart <= window)
                    sure = open_ & (near - slack >= threshold)
                    for settled, mask in ((True, sure), (False, open_ & ~sure)):
                        for i, j in np.argwhere(mask).tolist():
                            one, two = find(s + i), find(new + j)
                            if one != two:
                                if settled:
                                    root[max(one, two)] = min(one, two)
                                out.append((c[s + i], c[new + j], settled))
                held = (r, c[-window:], x[-window:], e[-window:])
                if out:
                    u, v, settled = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(settled)], names=["u", "v", "sure"])

    return rows.mapInArrow(run, "u long, v long, sure boolean")


def _settled(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose vectors reach the threshold, in double precision."""
    both = pairs.join(classes.select(F.col("cls").alias("u"), F.col("v").alias("x")), "u").join(classes.select(F.col("cls").alias("v"), F.col("v").alias("y")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = vectors_of(b.column("x")), vectors_of(b.column("y"))
            kept = []
            for dim in {len(x) for x in xs}:
                at = [i for i, x in enumerate(xs) if len(x) == dim]
                x, y = np.array([xs[i] for i in at]), np.array([ys[i] for i in at])
                x, y = (z / np.sqrt(_inner(z, z))[:, None] for z in (x, y))
                kept += [at[i] for i in np.flatnonzero(_inner(x, y) >= threshold)]
            own = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("u").take(own), b.column("v").take(own)], names=["u", "v"])

    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _exact_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``cls`` and ``linked``, the weight of the other classes of its component at or above the threshold."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / TILE_ROWS).alias("tiles"))
    placed = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("tiles")))
    every = F.explode(F.expr("sequence(0L, tiles - 1)")).alias("every")
    both = placed.select("root", "cls", "w", "v", "own", every)
    sides = both.select("root", F.col("own").alias("i"), F.col("every").alias("j"), F.lit(0).alias("side"), "cls", "w", "v").unionByName(
        both.select("root", F.col("every").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "cls", "w", "v")
    )
    tiles = sides.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile has a bounded number of rows on either side; it may go on in the next batch."""
        held: pa.Table | None = None
        for b in _then_none(batches):
            if b is not None:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
            if held is None or not held.num_rows:
                continue
            key = np.stack([held[n].to_numpy() for n in ("root", "i", "j")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            upto = held.num_rows if b is None else (int(cuts[-1]) if len(cuts) else 0)
            if not upto:
                continue
            done, held = held.slice(0, upto), held.slice(upto)
            x, cls, w, side = _unit(done["v"]), done["cls"].to_numpy(), done["w"].to_numpy(), done["side"].to_numpy()
            names, counts = [], []
            edges = [0, *cuts[cuts < upto].tolist(), upto]
            for s, e in zip(edges[:-1], edges[1:]):
                m = s + int(np.count_nonzero(side[s:e] == 0))
                near = x[s:m] @ x[m:e].T
                yes = near >= threshold
                # Products from matrix routines may differ in the last bits: settle close ones in a fixed order.
                for i, j in zip(*np.nonzero(np.abs(near - threshold) < 1e-9)):
                    yes[i, j] = _inner(x[s + i : s + i + 1], x[m + j : m + j + 1])[0] >= threshold
                yes &= cls[s:m, None] != cls[None, m:e]
                names.append(cls[s:m]), counts.append(yes @ w[m:e])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(counts).astype(np.int64))], names=["cls", "linked"])

    return tiles.mapInArrow(run, "cls long, linked long").groupBy("cls").agg(F.sum("linked").alias("linked"))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _roots(classes: DataFrame, threshold: float, passes: int, bits: int, window: int, seed: int, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` of the classes that rounds of passes link."""
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots, turn = None, 0
    while True:
        keyed = _sorted_passes(classes, MORE if turn else passes, bits, seed, turn)
        ordered = keyed.repartitionByRange(width, "run", "key", "cls").sortWithinPartitions("run", "key", "cls")
        found = scratch.stage(_window_links(ordered, threshold, window), "found")
        close = found.where("not sure").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = found.where("sure").select("u", "v").unionByName(_settled(close, classes, threshold))
        if turn:
            # Only links between components that are apart so far are new.
            of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias("root_" + side))
            links = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
            links = links.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).where("u <> v").distinct()
        links = scratch.stage(links, "links")
        if turn and links.isEmpty():
            return roots
        known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = components(known)
        turn, window = turn + 1, 2 * window


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    passes: int = PASSES,
    bits: int = BITS,
    window: int = WINDOW,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id``, ``kept``.

    Links are pairs with cosine at or above ``threshold`` in double precision; ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id that links reach, ``kept`` says that it is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do rows
    with a null id (whose component is null and which are not kept).  Vectors of different lengths do not link.
    Repeated rows count as other vectors and link.  An empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    rows = only(df, id_col, vector_col).toDF("id", "v").withColumn("ok", _usable("v") & F.col("id").isNotNull())
    # 128 bits of two hashes stand for a vector wherever it need not be at hand.
    good = rows.where("ok").withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    with Scratch(df.sparkSession, "projections") as scratch:
        classes = scratch.stage(good.groupBy("h", "g").agg(F.min("id").alias("cls"), F.count("*").alias("w"), F.any_value("v").alias("v")), "classes")
        roots = _roots(classes, threshold, passes, bits, window, seed, scratch)
        members = classes.join(roots, F.col("cls") == F.col("node")).select("root", "cls", "w", "v")
        counts = _exact_counts(members, threshold)
        named = (
            classes.select("h", "g", "cls", "w")
            .join(roots, F.col("cls") == F.col("node"), "left")
            .join(counts.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c"), "left")
            .select("h", "g", (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "cls").alias("component"))
        )
        named = stage(named, "vectors")
    linked = good.select("id", "h", "g").join(named, ["h", "g"]).select("id", "n_links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
