"""Operator 2: SimHash near-duplicates by a byte-position inverted index.

Fingerprints are made in one pass over the texts; from there on only (id, fingerprint) rows
move.  Equal fingerprints collapse first, by a plain aggregation, so groups of copies of any
size become one row.

Two 64-bit fingerprints that differ in at most ``d`` bits share at least ``8 - d`` of their 8
positional bytes: the guaranteed minimum of the count filter.  A list of a single byte at a position
holds 1/256 of the table, so tallies over such lists would pair nearly everything; the index
therefore posts each distinct fingerprint under every choice of ``8 - d`` byte positions and their
values, and two fingerprints meet in a list exactly if their tally can reach the minimum.  A posting
fixes ``8 - d`` bytes, so a list holds at most ``256 ** d`` different fingerprints.  Within a list shared
positional bytes are tallied for each pair, pairs at the minimum are retained, and these are verified on the
whole fingerprint.  Lists of up to ``PAIRWISE`` members compare all pairs in one array operation;
longer ones use midpoints, which is exact too: for d = 2, members within one bit of the same
value are within two bits of each other, and members two bits apart have such a value.
Only links that join two groups within a list are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, only, small_batches, stage, tidy
from .components import components

PAIRWISE = 256


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(words_per_shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:z], seed) for a, z in zip((ends - lengths).tolist(), ends[k - 1 :].tolist())], np.uint64)
    count = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words_per_shingle: int, seed: int) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long."""
    small_batches(df.sparkSession)
    source = only(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, words_per_shingle, seed) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[id_col, "fp"])

    return source.mapInArrow(tidy(run), T.StructType([source.schema[id_col], T.StructField("fp", T.LongType())]))


def _links_in_list(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of at most ``most`` bits that join different groups of the distinct ``fps``."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(fps[i]), int(fps[j])))

    if len(fps) <= PAIRWISE or most != 2:
        for i in range(len(fps) - 1):
            apart = fps[i + 1 :] ^ fps[i]
            tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            retained = np.flatnonzero(tally >= 8 - most)
            for j in retained[np.bitwise_count(apart[retained]) <= most].tolist():
                link(i, i + 1 + j)
        return out
    varying = np.bitwise_or.reduce(fps ^ fps[0])
    bits = [np.uint64(0)] + [np.uint64(1) << np.uint64(k) for k in range(64) if int(varying) >> k & 1]
    middle = np.concatenate([fps ^ b for b in bits])
    owner = np.tile(np.arange(len(fps)), len(bits))
    order = np.argsort(middle, kind="stable")
    middle, owner = middle[order], owner[order]
    for k in np.flatnonzero(middle[1:] == middle[:-1]).tolist():
        link(int(owner[k]), int(owner[k + 1]))
    return out


def fingerprint_links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct ``fp`` within ``most`` bits of each other."""
    minimum = 8 - most
    lists = list(combinations(range(8), minimum))
    mask = [sum(0xFF << 8 * p for p in positions) for positions in lists]
    signed = [m - (1 << 64) if m >> 63 else m for m in mask]
    posting = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)]))
    postings = distinct.select("fp", posting.alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a list may go on in the next batch."""
        held = np.zeros((0, 2), np.int64)
        for b in _and_last(batches):
            rows = held if b is None else np.concatenate((held, np.stack([b.column("key").to_numpy(), b.column("fp").to_numpy()], 1)))
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            upto = len(rows) if b is None else (int(cuts[-1]) if len(cuts) else 0)
            held = rows[upto:]
            begins = np.concatenate(([0], cuts[cuts < upto])) if upto else np.zeros(0, int)
            ends = np.append(begins[1:], upto)
            out: list[tuple[int, int]] = []
            for s, e in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
                fps = np.unique(rows[s:e, 1]).view(np.uint64)
                # 64-bit keys of different postings may be equal by chance; verification does not care.
                out += _links_in_list(fps, most)
            if out:
                uv = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

    many = postings.repartition("key").sortWithinPartitions("key", "fp")
    return many.mapInArrow(tidy(run), "u long, v long")


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 3,
    seed: int = 42,
    most: int = 2,
) -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Texts link if their fingerprints differ in at most ``most`` bits; ``component_id`` is the
    smallest id that links reach.  Null and empty texts have fingerprint zero and link like any
    other.  Rows with a null id link too; a component whose ids are all null has a null
    ``component_id``.  Repeated rows give repeated rows.  An empty table gives an empty one.
    Other columns are not read.
    """
    fps = stage(fingerprints(df, id_col, text_col, words_per_shingle, seed), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    roots = components(fingerprint_links(classes, most))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, all columns kept.

    Rows with a null id stay, and so do repeated rows of the smallest id.
    """
    found = near_duplicates(df, id_col, text_col, **params)
    name = free_name(df, "component_id")
    gone = found.where(f"component_id is not null and `{id_col}` <> component_id").select(F.col(id_col).alias(name)).distinct()
    left = df.join(gone, df[id_col] == gone[name], "left_anti")
    return left
