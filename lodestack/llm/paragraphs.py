"""Operator 6: substring dedup by paragraph MinHash banding.

Paragraphs are of two kinds: the non-empty lines of a text and, with ``within_lines``, overlapping runs of half of ``min_words`` words that begin at
content-defined places, wherever lines begin and end.  A run begins at the least five-word shingle of each stretch of as many
places as leave it inside ``min_words`` words, so every passage of ``min_words`` words holds a run that all its copies hold too.

Equal paragraphs (in lower case) are one class.  Classes whose MinHash bands collide are verified by exact Jaccard similarity of their
word shingles (``jaccard``), and links are closed to components.  In a component the first paragraph, by document and place, is the original; the
others are copies.  Runs with equal copies are extended word by word: words of each stretch of ``min_words`` words that stands
verbatim earlier are copied too.  A document loses what copies cover, if it is a passage of at least ``min_words`` words; copies of
the same earlier text join across less than a shingle of other words.

Equal texts are one text: the first row keeps it, all others lose it whole if it has ``min_words`` words.  Texts are known by a
digest, never written, and read again only where a filter of fixed size names them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Maybe, Scratch, free_name, small_batches, stage, tidy
from .components import components
from .jaccard import bucket_links, bucket_rows

ROWS = 3
RECALL = 0.998
#: Bands of runs.  A band is the shingle at which a run begins, itself the least of its stretch, and one more least value; so runs
#: that overlap in a text do not meet.  Runs at similarity 0.8 that begin alike meet with probability 0.992; equal ones need no band.
RUN_BANDS = 3
#: Copies of a run that one task compares at once: with at most 26 stretches a copy and some 64 bytes of arrays for each, about 30 MB.
#: More copies take the way of ``_verbatim_hot``, with the same result.
HOT = 1 << 14
#: Words that are hashed at once, unless one text has more.
WORDS = 100_000

_TIMES = np.uint64(0x100000001B3)


def bands_for(threshold: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` hashes that find a pair at the threshold with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def words_of(paragraph: str) -> list[str]:
    """Lower-case words."""
    return paragraph.lower().split()


def shingles(words: list[str], k: int) -> set:
    """Word shingles; the whole sequence if it is shorter."""
    return set(zip(*[words[i:] for i in range(k)])) if len(words) >= k else {tuple(words)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        """Their hashes."""
        if len(self) > 200_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words that begin at each word; the last ones go on with a value that stands for no word."""
    padded = np.concatenate((h, np.ones(k - 1, np.uint64)))
    value = np.zeros(len(h), np.uint64)
    for i in range(k):
        value = _mix(value * _TIMES + padded[i : i + len(h)])
    return value


def segment_shingles(h: np.ndarray, value: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of segments one after another, and where each segment's begin; short ones have one shingle."""
    counts = np.maximum(lengths - k + 1, 1)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    out = value[np.arange(int(counts.sum())) - np.repeat(first, counts) + np.repeat(starts, counts)]
    short = np.flatnonzero(lengths < k)
    if len(short):
        own = np.zeros(len(short), np.uint64)
        last = len(h) - 1
        for i in range(k):
            word = h[np.minimum(starts[short] + i, last)]
            own = _mix(own * _TIMES + np.where(i < lengths[short], word, np.uint64(1)))
        out[first[short]] = own
    return out, first


class Sketcher:
    """Band keys: least values of hashed shingles under random affine maps, of 32 bits each."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.names = _mix(rng.integers(0, 1 << 63, bands, dtype=np.uint64))

    def keys(self, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row of band keys for each of the sets that begin at ``first``."""
        value = (value >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(first), len(self.a)), np.uint32)
        for j in range(len(self.a)):
            least[:, j] = np.minimum.reduceat(value * self.a[j] + self.b[j], first)
        return self._joined(least)

    def square_keys(self, value: np.ndarray) -> np.ndarray:
        """The same of sets of equal size, one in each row."""
        value = (value >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(value), len(self.a)), np.uint32)
        for j in range(len(self.a)):
            least[:, j] = (value * self.a[j] + self.b[j]).min(1)
        return self._joined(least)

    def _joined(self, least: np.ndarray) -> np.ndarray:
        key = np.repeat(self.names[None, :], len(least), 0)
        for r in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r :: self.rows])
        return key


def _least(a: np.ndarray, w: int, step: int = 1 << 23) -> np.ndarray:
    """For each stretch of ``w`` values the place of the first least one, by their high 40 bits."""
    low = np.uint64((1 << 24) - 1)
    out = np.empty(max(len(a) - w + 1, 0), np.int64)
    for s in range(0, len(out), step):
        x = a[s : s + step + w - 1]
        m, k = (x & ~low) | np.arange(len(x), dtype=np.uint64), 1
        while 2 * k <= w:
            m, k = np.minimum(m[:-k], m[k:]), 2 * k
        n = len(x) - w + 1
        out[s : s + step] = (np.minimum(m[:n], m[w - k : w - k + n]) & low).astype(np.int64) + s
    return out


def _stretch_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words that begin at each word."""
    power, k, out, done = h, 1, None, 0
    while k <= n:
        if n & k:
            out = power if out is None else _mix(out[: len(power) - done] * _TIMES + power[done:])
            done += k
        if 2 * k <= n:
            power = _mix(power[:-k] * _TIMES + power[k:])
        k *= 2
    return _mix(out)


def run_words(min_words: int) -> int:
    """Words of a run."""
    return max(min_words // 2, 1)


def _anchors(value: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where runs begin, and the first and last stretch of ``n`` words that each stands for.  ``ends``: of texts."""
    place = _least(value, n - run_words(n) + 1)
    s = np.arange(len(place))
    text = np.searchsorted(ends, s, "right")
    inside = np.flatnonzero((text < len(ends)) & (s + n <= ends[np.minimum(text, len(ends) - 1)]))
    if not len(inside):
        return inside, inside, inside
    p, t = place[inside], text[inside]
    cuts = np.flatnonzero((p[1:] != p[:-1]) | (t[1:] != t[:-1])) + 1
    return p[np.concatenate(([0], cuts))], inside[np.concatenate(([0], cuts))], inside[np.concatenate((cuts - 1, [len(p) - 1]))]


def _square(x: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return x[starts[:, None] + np.arange(n)[None, :]]


def _run_classes(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    own = np.full(len(starts), 7, np.uint64)
    for i in range(n):
        own = _mix(own * _TIMES + h[starts + i])
    return own


def _line_classes(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words of segments, in their order."""
    place = (np.arange(len(h)) - np.repeat(starts, lengths)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(_mix(h + place * _TIMES)), starts) * _TIMES + lengths.astype(np.uint64))


def _grouped(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """Ranges of items of bounded total size."""
    s, total, e = 0, 0, 0
    for e, n in enumerate(sizes):
        if total and total + n > WORDS:
            yield s, e
            s, total = e, 0
        total += n
    if total or e >= s:
        yield s, e + 1


def _units(texts: DataFrame, bands: int, rows: int, k: int, seed: int, min_words: int, within_lines: bool) -> DataFrame:
    """The paragraphs of ``doc``, ``place``, ``text``: first word, words, kind, class and band keys."""
    length = run_words(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, of_lines, of_runs = WordHashes(), Sketcher(bands, rows, seed), Sketcher(RUN_BANDS, 1, seed + 1)

        def unit_rows(b, row, starts, lengths, kind, classes, keys):
            some = pa.array(row)
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            return pa.RecordBatch.from_arrays(
                [b.column(0).take(some), b.column(1).take(some), pa.array(starts.astype(np.int32)), pa.array(lengths.astype(np.int32)), pa.array(np.full(len(row), kind)), pa.array(classes.view(np.int64)), held],
                names=["doc", "place", "start", "words", "run", "cls", "keys"],
            )

        for b in batches:
            split = [[line.split() for line in x.lower().split("\n")] for x in b.column(2).to_pylist()]
            for s, e in _grouped(sum(map(len, x)) for x in split):
                flat = list(chain.from_iterable(chain.from_iterable(split[s:e])))
                if not flat:
                    continue
                h = seen.of(flat)
                value = shingle_hashes(h, k)
                lines = [np.fromiter(map(len, split[i]), np.int64, len(split[i])) for i in range(s, e)]
                ends = np.cumsum([x.sum() for x in lines])
                row = np.repeat(np.arange(s, e), [np.count_nonzero(x) for x in lines])
                lengths = np.concatenate(lines)
                lengths = lengths[lengths > 0]
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                begins = np.concatenate(([0], ends[:-1]))
                classes = _line_classes(h, starts, lengths)
                yield unit_rows(b, row, starts - begins[row - s], lengths, False, classes, of_lines.keys(*segment_shingles(h, value, starts, lengths, k)))
                if not within_lines:
                    continue
                at, _, _ = _anchors(value, ends, min_words)
                if len(at):
                    row = np.searchsorted(ends, at, "right")
                    keys = _mix(of_runs.square_keys(_square(value, at, length - k + 1)) ^ value[at][:, None])
                    yield unit_rows(b, row + s, at - begins[row], np.full(len(at), length), True, _run_classes(h, at, length), keys)

    doc = texts.schema["doc"].dataType.simpleString()
    return texts.select("doc", "place", "text").mapInArrow(tidy(run), f"doc {doc}, place binary, start int, words int, run boolean, cls long, keys array<long>")


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of ranges that begin at ``first``, one range after another."""
    return np.arange(int(counts.sum())) + np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)


def _lists(flat: list[np.ndarray], lengths: np.ndarray, present: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths, null where none is present."""
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0, kind.to_pandas_dtype()), kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), values, mask=pa.array(~present))


def _details(wanted: DataFrame, k: int, min_words: int) -> DataFrame:
    """For each wanted paragraph of ``place``, ``text``: its shingles, or the stretches that it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            starts_of, words_in, classes_of, sets_of, copies_of = (b.column(n) for n in ("starts", "words", "classes", "sets", "copies"))
            edges = starts_of.offsets.to_numpy() - starts_of.offsets[0].as_py()
            all_starts, all_words, all_classes, all_copies = (c.flatten().to_numpy() for c in (starts_of, words_in, classes_of, copies_of))
            all_sets = sets_of.flatten().to_numpy(zero_copy_only=False)
            begin, held = 0, ([], [], [], [])

            def batch(upto: int) -> pa.RecordBatch:
                rows = slice(int(edges[begin]), int(edges[upto]))
                own = pa.array(np.repeat(np.arange(begin, upto), np.diff(edges[begin : upto + 1])))
                sizes, wants_set = np.concatenate(held[3]), all_sets[rows]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(all_classes[rows]), b.column("place").take(own), b.column("doc").take(own), pa.array(np.concatenate(held[0]).astype(np.int32)),
                        _lists(held[1], np.where(wants_set, sizes, 0), wants_set, pa.int64()), _lists(held[2], np.where(wants_set, 0, sizes), ~wants_set, pa.int32()), pa.array(all_copies[rows]),
                    ],
                    names=["cls", "place", "doc", "start", "sh", "stretches", "n"],
                )

            for i, text in enumerate(b.column("text")):
                h = seen.of(words_of(text.as_py()))
                value = shingle_hashes(h, k)
                rows = slice(int(edges[i]), int(edges[i + 1]))
                starts, lengths, wants_set = all_starts[rows].copy(), all_words[rows], all_sets[rows]
                sizes = np.zeros(len(starts), np.int64)
                if wants_set.any():
                    own, first = segment_shingles(h, value, starts[wants_set], lengths[wants_set], k)
                    sets = [np.unique(x) for x in np.split(own.view(np.int64), first[1:])]
                    sizes[wants_set] = [len(x) for x in sets]
                    held[1].extend(sets)
                if not wants_set.all():
                    at, s, e = _anchors(value, np.array([len(h)]), min_words)
                    every = (_stretch_hashes(h, min_words) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    which = np.searchsorted(at, starts[~wants_set])
                    starts[~wants_set] = s[which]
                    sizes[~wants_set] = e[which] - s[which] + 1
                    held[2].append(every[_ranges(s[which], sizes[~wants_set])])
                held[0].append(starts)
                held[3].append(sizes)
                if edges[i + 1] - edges[begin] >= 20_000:
                    yield batch(i + 1)
                    begin, held = i + 1, ([], [], [], [])
            if begin < b.num_rows:
                yield batch(b.num_rows)

    doc = wanted.schema["doc"].dataType.simpleString()
    return wanted.mapInArrow(tidy(run), f"cls long, place binary, doc {doc}, start int, sh array<long>, stretches array<int>, n int")


def _short(place: bytes) -> int:
    """A number for a text, enough to tell whether two spans have one source."""
    return int.from_bytes(place[:7], "big")


def _short_column(place: str) -> F.Column:
    return F.conv(F.hex(F.substring(place, 1, 7)), 16, 10).cast("long")


_SPANS = "place binary, a int, z int, source long"


def _spans_of(row: np.ndarray, at: np.ndarray, copied: np.ndarray, source: np.ndarray, places: pa.Array, n: int) -> pa.RecordBatch:
    """Ranges of words: neighbouring copied stretches of ``n`` words of one row and one source are one."""
    row, at, source = row[copied], at[copied], source[copied]
    cuts = np.flatnonzero((row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1])) + 1
    first, last = np.concatenate(([0], cuts)), np.concatenate((cuts - 1, [len(row) - 1]))
    columns = [places.take(pa.array(row[first])), pa.array(at[first].astype(np.int32)), pa.array((at[last] + n).astype(np.int32)), pa.array(source[first])]
    return pa.RecordBatch.from_arrays(columns, names=["place", "a", "z", "source"])


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and hash of every stretch."""
    lists = t["stretches"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    at = np.arange(len(row)) - first[row] + t["start"].to_numpy()[row]
    return row, at, lists.flatten().to_numpy()


def _complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, in tables of whole groups."""
    held: pa.Table | None = None
    for b in chain(batches, [None]):
        if b is not None:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held is None or not held.num_rows:
            continue
        key = np.stack([held[k].to_numpy() for k in keys], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        upto = held.num_rows if b is None else (int(cuts[-1]) if len(cuts) else 0)
        if upto:
            yield held.slice(0, upto)
            held = held.slice(upto)


def _first_of(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each item the place of the first one with its group and hash."""
    order = np.lexsort((np.arange(len(h)), h, group))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1])
    out = np.empty(len(h), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _verbatim(rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Ranges of words in stretches of ``n`` words that stand verbatim before, in another text or without overlap in the same.

    Runs of up to ``HOT`` copies are compared in one task each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _complete_groups(batches, ["cls"]):
            row, at, h = _flat(t)
            places = t["place"].combine_chunks()
            known = places.dictionary_encode()
            place, names = known.indices.to_numpy(), np.array([_short(x) for x in known.dictionary.to_pylist()], np.int64)
            first = _first_of(t["cls"].to_numpy()[row], h)
            copied = (place[row[first]] != place[row]) | (at - at[first] >= n)
            if copied.any():
                yield _spans_of(row, at, copied, names[place[row[first]]], places, n)

    few = rows.where(F.col("n") <= HOT).repartition("cls").sortWithinPartitions("cls", "doc", "place", "start")
    found = few.select("cls", "place", "start", "stretches").mapInArrow(tidy(run), _SPANS)
    hot = rows.where(F.col("n") > HOT)
    return found if hot.isEmpty() else found.unionByName(_verbatim_hot(hot, n, scratch))


def _verbatim_hot(rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """The same for runs of very many copies: every batch passes on its first occurrences only, dealt out by slices of the
    hashes; what stands twice comes back to salted groups of the rows."""
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["cls", "doc", "place", "start", "stretches"]
    kind = rows.schema["doc"].dataType.simpleString()

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([(c, "ascending") for c in ("cls", "doc", "place", "start")])
            # Nulls come before others, as in the order of documents elsewhere.
            none = t.filter(pa.compute.is_null(t["doc"]))
            t = pa.concat_tables([none, t.filter(pa.compute.is_valid(t["doc"]))])
            row, at, h = _flat(t)
            cls = t["cls"].to_numpy()[row]
            first = _first_of(cls, h)
            chosen, times = np.unique(first, return_counts=True)
            part = (h[chosen].view(np.uint32) % np.uint32(slices)).astype(np.int32)
            order = np.lexsort((chosen, part, cls[chosen]))
            chosen, times, part = chosen[order], times[order], part[order]
            cuts = np.concatenate(([0], np.flatnonzero((cls[chosen][1:] != cls[chosen][:-1]) | (part[1:] != part[:-1])) + 1, [len(chosen)])).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts), x)
            own = pa.array(row[chosen])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cls[chosen][cuts[:-1]]), pa.array(part[cuts[:-1]]), lists(pa.array(h[chosen])), lists(t["doc"].combine_chunks().take(own)), lists(t["place"].combine_chunks().take(own)),
                    lists(pa.array(at[chosen].astype(np.int32))), lists(pa.array(times.astype(np.int32))),
                ],
                names=["cls", "slice", "h", "docs", "places", "at", "times"],
            )

    packed = rows.select(*columns).mapInArrow(tidy(firsts), f"cls long, slice int, h array<int>, docs array<{kind}>, places array<binary>, at array<int>, times array<int>")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _complete_groups(batches, ["cls", "slice"]):
            counts = np.diff(t["h"].combine_chunks().offsets.to_numpy())
            group = np.repeat(np.arange(len(counts)), counts)
            cls = t["cls"].to_numpy()[group]
            flat = {c: t[c].combine_chunks().flatten() for c in ("h", "docs", "places", "at", "times")}
            h = flat["h"].to_numpy()
            docs = flat["docs"].to_pylist()
            key = list(zip(*[cls.tolist(), h.tolist(), [d is not None for d in docs], [d if d is not None else 0 for d in docs], flat["places"].to_pylist(), flat["at"].to_pylist()]))
            order = np.array(sorted(range(len(key)), key=key.__getitem__), np.int64)
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (cls[order][1:] != cls[order][:-1])
            begins = np.flatnonzero(new)
            twice = np.add.reduceat(flat["times"].to_numpy()[order], begins) > 1
            kept = order[begins[twice]]
            if len(kept):
                own = pa.array(kept)
                yield pa.RecordBatch.from_arrays([pa.array(cls[kept]), pa.array(h[kept]), flat["places"].take(own), flat["at"].take(own)], names=["cls", "h", "first", "at"])

    again = packed.repartition("cls", "slice").sortWithinPartitions("cls", "slice").mapInArrow(tidy(shared), "cls long, h int, first binary, at int")
    known = again.groupBy("cls").agg(F.collect_list(F.struct("h", "first", "at")).alias("k"))
    known = scratch.stage(known.select("cls", F.col("k.h").alias("stretches"), F.col("k.first").alias("firsts"), F.col("k.at").alias("ats")), "shared")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, tuple[bytes, int]] = {}
        for b in batches:
            found_in, ats, sources = [], [], []
            for i, (place, start, hs) in enumerate(zip(b.column("place").to_pylist(), b.column("start").to_pylist(), b.column("stretches").to_pylist())):
                if place is None:  # what the rows that follow share
                    table = dict(zip(hs, zip(b.column("firsts")[i].as_py(), b.column("ats")[i].as_py())))
                    continue
                for at, h in enumerate(hs, start):
                    if (found := table.get(h)) and (found[0] != place or at - found[1] >= n):
                        found_in.append(i), ats.append(at), sources.append(_short(found[0]))
            if found_in:
                every = np.ones(len(ats), bool)
                yield _spans_of(np.array(found_in), np.array(ats), every, np.array(sources, np.int64), b.column("place"), n)

    salts = rows.select("cls", F.ceil(F.col("n") / HOT).alias("salts")).distinct()
    each = known.join(salts, "cls").select("cls", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(None).cast("binary").alias("place"), F.lit(0).alias("start"), "stretches", "firsts", "ats")
    own = rows.select("cls", F.pmod(F.xxhash64("place"), F.ceil(F.col("n") / HOT)).alias("salt"), "place", "start", "stretches", F.lit(None).cast("array<binary>").alias("firsts"), F.lit(None).cast("array<int>").alias("ats"))
    grouped = each.unionByName(own).repartition("cls", "salt").sortWithinPartitions("cls", "salt", F.col("place").asc_nulls_first())
    return grouped.select("place", "start", "stretches", "firsts", "ats").mapInArrow(tidy(spans), _SPANS)


def _heads(source: DataFrame, twice: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each text: the first of those that stand ``twice`` or more.  Copies combine before they are shuffled."""
    repeated = Maybe(twice.select("place"))
    first = repeated.of(source, "place").groupBy("place").agg(F.min(F.struct("doc", "text")).alias("first"))
    first = scratch.stage(first.select("first.doc", "place", "first.text"), "heads")
    return repeated.beside(source, "place").select("doc", "place", "text").unionByName(first)


def _digest(text: F.Column) -> F.Column:
    """128 bits of a text, from two hashes; null if it is."""
    word = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.when(text.isNotNull(), F.unhex(F.concat(word(F.xxhash64(text)), word(F.xxhash64(F.lit(1), text)))))


def _edge(n: int, threshold: float) -> int:
    """Words at either end of a run of ``n`` shingles that a run at the threshold may lack; a change further in breaks more shingles."""
    return int(n * (1 - threshold) / (1 + threshold) + 1e-9)


def copied_spans(source: DataFrame, bands: int, threshold: float, k: int, min_words: int, seed: int, within_lines: bool) -> DataFrame:
    """``place``, ``first`` (the first document of a repeated text, else null) and ``a``, ``z``, ``source``, the ranges of words that are
    copies, of the texts that lose any words.  ``source``: ``doc``, ``place`` and ``text``, without null texts."""
    spark = source.sparkSession
    with Scratch(spark, "paragraphs") as scratch:
        counts = source.groupBy("place").agg(F.min("doc").alias("least"), F.count("*").alias("rows"), F.count("doc").alias("named")).where("rows > 1")
        twice = scratch.stage(counts.select("place", F.struct(F.when(F.col("rows") == F.col("named"), F.col("least")).alias("doc")).alias("first")), "twice")
        heads = _heads(source, twice, scratch)
        units = scratch.stage(_units(heads, bands, ROWS, k, seed, min_words, within_lines), "units")
        met = bucket_rows(units.select(F.explode("keys").alias("key"), "cls"), scratch)

        # Where classes stand that are repeated or met.
        repeated = units.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1")
        known = repeated.join(met.select("cls", F.lit(True).alias("met")).distinct(), "cls", "full")
        known = scratch.stage(known.select("cls", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("met", F.lit(False)).alias("met")), "classes")
        places = scratch.stage(Maybe(known.select("cls")).of(units.drop("keys"), "cls").join(known, "cls"), "places")
        scratch.drop("units")
        first = scratch.stage(places.groupBy("cls", "met").agg(F.min(F.struct("doc", "place", "start")).alias("first"), F.max("words").alias("words")), "first")

        # Their texts once more: shingles of met classes, stretches around repeated runs.
        sets = first.where("met").select(F.col("first.place").alias("p"), F.col("first.start").alias("start"), "words", "cls", F.lit(True).alias("sh"), F.lit(0).alias("n"))
        copied = places.where("run and n > 1").select(F.col("place").alias("p"), "start", "words", "cls", F.lit(False).alias("sh"), F.col("n").cast("int").alias("n"))
        wants = sets.unionByName(copied).groupBy("p").agg(F.collect_list(F.struct("start", "words", "cls", "sh", "n")).alias("w"))
        wants = scratch.stage(wants.select("p", F.col("w.start").alias("starts"), F.col("w.words").alias("words"), F.col("w.cls").alias("classes"), F.col("w.sh").alias("sets"), F.col("w.n").alias("copies")), "wants")
        asked = Maybe(wants.select("p")).of(heads, "place").join(wants, F.col("place") == F.col("p")).drop("p")
        details = scratch.stage(_details(asked, k, min_words), "details")

        # Near copies, by components of verified links.
        members = met.join(details.where("sh is not null").select("cls", "sh").dropDuplicates(["cls"]), "cls")
        roots = components(bucket_links(members, threshold, scratch))
        linked = scratch.stage(first.join(roots, F.col("cls") == F.col("node")).select("cls", "first", "root"), "linked")
        originals = linked.groupBy("root").agg(F.min("first").alias("original"))
        near = linked.join(originals, "root").where(F.col("first") != F.col("original")).select(F.col("cls").alias("c"), "original")
        original = first.join(near, F.col("cls") == F.col("c"), "left").select("cls", F.coalesce("original", "first").alias("original"), F.col("original").isNotNull().alias("near"))
        spans = places.join(original, "cls").where(
            (F.col("place") != F.col("original.place"))
            | (F.col("start") >= F.col("original.start") + F.when(F.col("run"), min_words).otherwise(F.col("words")))
        )
        edge = F.when(F.col("run") & F.col("near"), _edge(run_words(min_words) - k + 1, threshold)).otherwise(0)
        spans = spans.select("place", (F.col("start") + edge).alias("a"), (F.col("start") + F.col("words") - edge).alias("z"), _short_column("original.place").alias("source"))
        if within_lines:
            spans = spans.unionByName(_verbatim(details.where("stretches is not null"), min_words, scratch))
        held = spans.groupBy("place").agg(F.collect_list(F.struct("a", "z", "source")).alias("spans"))
        both = held.join(twice.select(F.col("place").alias("p"), "first"), F.col("place") == F.col("p"), "full")
        columns = [F.col(f"spans.{c}").alias(c) for c in ("a", "z", "source")]
        return stage(both.select(F.coalesce("place", "p").alias("place"), "first", *columns), "removals")


def joined_spans(spans: list[tuple[int, int, int]], k: int, min_words: int) -> list[list[int]]:
    """Passages that spans cover, if they have ``min_words`` words; spans of one source join across fewer than ``k`` words."""
    out, source = [], None
    for a, z, own in sorted(spans):
        if out and (a <= out[-1][1] or (own == source and a - out[-1][1] < k)):
            if z >= out[-1][1]:
                out[-1][1], source = z, own
        else:
            out.append([a, z])
            source = own
    return [x for x in out if x[1] - x[0] >= min_words]


def cut_text(text: str, spans: list[list[int]]) -> tuple[str, list[int]]:
    """``text`` without these ranges of words, and the numbers of the lines that lost any word."""
    out, lost, nth, s = [], [], 0, 0
    for number, line in enumerate(text.split("\n")):
        n = len(line.split())
        begin, nth = nth, nth + n
        while s < len(spans) and spans[s][1] <= begin:
            s += 1
        if not n or s == len(spans) or spans[s][0] >= nth:
            out.append(line)
            continue
        lost.append(number)
        if spans[s][0] <= begin and spans[s][1] >= nth:
            continue
        gone = [False] * n
        for a, z in spans[s:]:
            if a >= nth:
                break
            gone[max(a - begin, 0) : z - begin] = [True] * (min(z - begin, n) - max(a - begin, 0))
        edges = [w.start() for w in re.finditer(r"\S+", line)] + [len(line)]
        left = line[: edges[0]] + "".join(line[edges[i] : edges[i + 1]] for i, g in enumerate(gone) if not g)
        out.append(left.rstrip() if gone[-1] else left)
    return "\n".join(out), lost


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    words_per_shingle: int = 5,
    min_words: int = 50,
    recall: float = RECALL,
    seed: int = 11,
    within_lines: bool = False,
) -> DataFrame:
    """All columns of ``df``, with copied passages removed from the text, and ``removed_lines`` (array of int), the numbers
    of the lines that lost all or some of their words.

    Only whole lines go, unless ``within_lines`` asks for runs of words, too.  Lines count from 0.  Null texts stay null and empty ones empty; neither loses lines.  Of passages in rows that share an
    id, the first by a digest of the text stays; within one row, the first.  Rows that repeat an id and its text are one row and stay alike.  Null ids come before others.
    An empty table gives an empty one.  Clashing column names get underscores.
    """
    if min_words < 2 * words_per_shingle:
        raise ValueError("a passage must have at least two shingles' words")
    small_batches(df.sparkSession, 1000)
    bands = bands_for(threshold, recall=recall)
    taken = df.limit(0)
    names = {}
    for wanted in ("place", "removed_lines", "gone_place", "gone_first", "gone_a", "gone_z", "gone_source", "gone_cut"):
        names[wanted] = free_name(taken, wanted)
        taken = taken.withColumn(names[wanted], F.lit(0))
    place, lines, p, first, cut_ = (names[n] for n in ("place", "removed_lines", "gone_place", "gone_first", "gone_cut"))
    spans = [names[n] for n in ("gone_a", "gone_z", "gone_source")]
    digest = _digest(F.col(f"`{text_col}`"))
    source = df.select(F.col(f"`{id_col}`").alias("doc"), digest.alias("place"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    gone = copied_spans(source, bands, threshold, words_per_shingle, min_words, seed, within_lines)
    named, known = Maybe(gone.select("place")), df.withColumn(place, digest)
    own = [F.col(f"`{c}`") for c in df.columns]
    untouched = named.beside(known, place).select(*own, F.array().cast("array<int>").alias(lines))
    found = gone.select(F.col("place").alias(p), F.col("first").alias(first), *[F.col(c).alias(n) for c, n in zip(("a", "z", "source"), spans)])
    joined = named.of(known, place).join(found, F.col(place) == F.col(p), "left")
    later = F.col(first).isNotNull() & ~F.col(f"`{first}`.doc").eqNullSafe(F.col(f"`{id_col}`"))

    @F.pandas_udf("text string, lines array<int>")
    def cut(text: pd.Series, a: pd.Series, z: pd.Series, source: pd.Series, later: pd.Series) -> pd.DataFrame:
        rows = []
        for x, begin, end, own, whole in zip(text, a, z, source, later):
            if whole:
                n = len(x.split())
                passages = [[0, n]] if n >= min_words else []
            else:
                passages = [] if begin is None else joined_spans(list(zip(begin.tolist(), end.tolist(), own.tolist())), words_per_shingle if within_lines else 1, min_words)
            rows.append(cut_text(x, passages) if passages else (x, []))
        return pd.DataFrame(rows, columns=["text", "lines"])

    done = joined.withColumn(cut_, cut(F.col(f"`{text_col}`"), *[F.col(n) for n in spans], later))
    columns = [F.col(f"`{cut_}`.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return untouched.unionByName(done.select(*columns, F.col(f"`{cut_}`.lines").alias(lines)))
