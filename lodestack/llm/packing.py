"""Operator 3: mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens: its documents in the order of input partitions and rows.
Queues are served ``quantum`` tokens at a time.  A source earns credit in proportion to its target share
and is served when it has a quantum's worth: the j-th quantum of a source with share p is due
at virtual time (j + 1/2) / p, and quanta in the order of their due times are the round-robin's
output.  So each window holds the sources in target proportions, the rest of a quantum that does
not fit goes on in the next window, and what a source is owed is carried on over windows and partitions
alike, as due times depend on nothing but the source's own queue.  Targets default to the sources'
shares of all tokens, which empties all queues at once; other targets keep every token too, and
queues that outlast the others fill the last windows.

The order is made by two prefix sums: a running count in each partition, and the totals of
partitions added up.  No source has to fit into a task; ids move once, joined to their documents' pieces.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SLICE_BYTES, slices
from .common import only, small_batches, stage, tidy
from .merges import MergeTable, ShortWords

CACHE_WORDS = 500_000
#: Words that a worker takes along to its next task.
KEPT_WORDS = 65_536
#: Words that are spelt at once.
SPELT_WORDS = 1 << 17
WINDOW = 4096
QUANTUM = 256


def _gathered(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, each from its begin on, one after another."""
    at = np.repeat(begin - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return values[at]


class WordIds:
    """Ids of words seen, in flat arrays.

    When full, only the words met most often stay, and those of the slice at hand, which costs time but no result.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def __len__(self) -> int:
        return len(self.words)

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.n = self.begin = self.met = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def keep(self, most: int) -> None:
        """Forget all but the ``most`` words met most often."""
        if len(self) > most:
            rows = np.argsort(-self.met, kind="stable")[:most]
            words, met, (n, ids) = self.words.take(pa.array(rows)), self.met[rows], self.spell(rows)
            self.clear()
            self._add(words, n, ids, met)

    def rows(self, words: pa.StringArray, times: np.ndarray, encode: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows of distinct words, each met so many times more; those that are not held are encoded."""
        at = self._find(words)
        if len(self) + np.count_nonzero(at < 0) > self.most:
            self.keep(self.most // 4)
            at = self._find(words)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            at[new] = len(self) + np.arange(len(new))
            self._add(fresh, *encode(fresh), np.zeros(len(new), np.int64))
        self.met[at] += times
        return at

    def spell(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these rows has, and the ids one after another."""
        n = self.n[rows]
        return n, _gathered(self.ids, self.begin[rows], n)

    def _find(self, words: pa.StringArray) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def _add(self, words: pa.StringArray, n: np.ndarray, ids: np.ndarray, met: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.n, self.met, self.ids = np.concatenate((self.n, n)), np.concatenate((self.met, met)), np.concatenate((self.ids, ids))
        self.begin = np.cumsum(self.n) - self.n


class WordBpe:
    """The tokenizer of a file, with lower case and white space dropped, for whole texts.

    No token spans white space, so texts are looked up by their words.  Texts
    with marks that the file's normaliser treats in a special way go through the ``tokenizers`` library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # A line end stands between words; no match spans it.
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.table = MergeTable.from_json(path)
        self.short = ShortWords(self.table)
        self.odd = re.compile("[\x1c-\x1fΣİ\ud800-\udfff]")
        self.cache = WordIds(CACHE_WORDS)

    def _pack(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each cut by the pattern into pieces: how many of each word, and all of them."""
        cut = pa.array(self.pattern.findall("\n".join(words.to_pylist())), pa.string()).dictionary_encode()
        n, ids = self._replayed(cut.dictionary)
        at, begin = cut.indices.to_numpy(), np.cumsum(n) - n
        between = pc.equal(cut.dictionary, "\n").to_numpy(zero_copy_only=False)
        n[between] = 0
        upto = np.cumsum(n[at])
        upto = np.concatenate((upto[between[at]], upto[-1:] if len(at) else [0]))
        return np.diff(upto, prepend=0), _gathered(ids, begin[at], n[at])

    def _replayed(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: how many of each, and all of them."""
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        bounds = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1].astype(np.int64)
        raw, lengths = np.frombuffer(pieces.buffers()[2], np.uint8), np.diff(bounds)
        few = lengths <= ShortWords.MOST
        if few.all():
            return self.short.encode(raw, bounds[:-1], lengths)
        n, short = self.short.encode(raw, bounds[:-1][few], lengths[few])
        long = self.table.encode([raw[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(~few)], "<u4")
        at = np.empty(len(pieces), np.int64)
        at[few], at[~few] = np.arange(len(n)), len(n) + np.arange(len(long))
        n = np.concatenate((n, [len(x) // 4 for x in long]))
        return n[at], _gathered(np.concatenate((short, np.frombuffer(b"".join(long), "<u4"))), (np.cumsum(n) - n)[at], n[at])

    def _plain(self, text: str) -> bool:
        from unicodedata import is_normalized

        if text.isascii():
            return not ("<|" in text or self.odd.search(text))
        return is_normalized("NFC", text) and not (self.odd.search(text) or any(s in text for s in self.specials))

    def _looked_up(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of plain texts by their words."""
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.string()))
        words = split.values.dictionary_encode()
        at = words.indices.to_numpy()
        rows = self.cache.rows(words.dictionary, np.bincount(at, minlength=len(words.dictionary)), self._pack)
        bounds = split.offsets.to_numpy()
        del split, words
        # Spelt some texts at a time, as places in the cache take several times the ids.
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SPELT_WORDS, "right")) - 1)
            n, ids = self.cache.spell(rows[at[bounds[first] : bounds[last]]])
            ends = np.concatenate(([0], np.cumsum(n)))[bounds[first : last + 1] - bounds[first]] * ids.itemsize
            packed = ids.tobytes()
            yield from (packed[a:b] for a, b in itertools.pairwise(ends.tolist()))
            first = last

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, four bytes each) of texts, without special tokens added."""
        plain = [self._plain(t) for t in texts]
        found = self._looked_up([t for t, p in zip(texts, plain) if p]) if any(plain) else iter(())
        return [next(found) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, p in zip(texts, plain)]


_held: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each worker process."""
    if path not in _held:
        _held[path] = WordBpe(path)
    return _held[path]


def _forget() -> None:
    """Empty the tokenizers' caches."""
    for held in _held.values():
        held.cache.clear()


def tokenised(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows with their place (``part``, ``row``), packed ids and the start in their partition's queue."""
    small_batches(df.sparkSession)
    source = only(df, id_col, text_col, source_col)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, row = tokenizer(path), TaskContext.get().partitionId(), 0
        queued: dict[str | None, int] = defaultdict(int)
        for t in slices(batches, text_col, SLICE_BYTES):
            packed = [p + end for p in tok.encode([x or "" for x in t[text_col].to_pylist()])]
            sources, starts = t[source_col].to_pylist(), []
            for s, p in zip(sources, packed):
                starts.append(queued[s])
                queued[s] += len(p) // 4
            n = len(packed)
            out = pa.table(
                {
                    "id": t[id_col],
                    "source": t[source_col],
                    "part": pa.array(np.full(n, part, np.int32)),
                    "row": pa.array(np.arange(row, row + n, dtype=np.int64)),
                    "start": pa.array(starts, pa.int64()),
                    "n": pa.array([len(p) // 4 for p in packed], pa.int64()),
                    "ids": pa.array(packed, pa.binary()),
                }
            )
            row += n
            yield from out.to_batches(max_chunksize=1000)
        tok.cache.keep(KEPT_WORDS)

    kind = source.schema
    schema = T.StructType(
        [
            T.StructField("id", kind[id_col].dataType),
            T.StructField("source", kind[source_col].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("row", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return source.mapInArrow(tidy(run, _forget), schema)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the running count of tokens in it."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("length").to_numpy()
        upto = at + np.cumsum(n)
        out = [*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n)]
        if len(n):
            at = int(upto[-1])
        yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, "slot", "at"])


def pack(
    df: DataFrame,
    path: str,
    end_id: int = 2,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents: id, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``, ``source``.

    A document's ids are its text's and ``end_id``; each id lies in one piece.  All sequences but the
    last are full.  Null and empty texts are the end id alone; a null source is a queue of its own;
    repeated rows are packed each; an empty table gives no rows.  Sources without a target share in the
    proportion of their tokens.  Other columns are not read.
    """
    spark = df.sparkSession
    toks = stage(tokenised(df, path, end_id, id_col, text_col, source_col), "tokens")
    # Where each partition's part of a queue begins, and how long the queue is.
    parts = toks.groupBy("source", "part").agg(F.sum("n").alias("m"))
    queue = Window.partitionBy("source")
    begins = parts.select(
        F.col("source").alias("s"),
        F.col("part").alias("p"),
        (F.sum("m").over(queue.orderBy("part")) - F.col("m")).alias("base"),
        F.sum("m").over(queue).alias("total"),
    )
    share = F.col("total").cast("double")
    if targets:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("source")), share)
    docs = toks.select("source", "part", "row", "start", "n").join(
        begins, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    )
    docs = docs.select("part", "row", "source", "n", (F.col("base") + F.col("start")).alias("q0"), share.alias("share"))
    turn = F.explode(F.expr(f"sequence(q0 div {quantum}, (q0 + n - 1) div {quantum})")).alias("turn")
    runs = docs.select("part", "row", "source", "n", "q0", "share", turn).select(
        "part",
        "row",
        "source",
        F.greatest("q0", F.col("turn") * quantum).alias("from"),
        F.least(F.col("q0") + F.col("n"), (F.col("turn") + 1) * quantum).alias("to"),
        "q0",
        ((F.col("turn") + 0.5) / F.col("share")).alias("due"),
    )
    runs = runs.select("part", "row", "due", "source", "from", (F.col("from") - F.col("q0")).alias("start"), (F.col("to") - F.col("from")).alias("length"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = runs.repartitionByRange(width, "due", "source", "from").sortWithinPartitions("due", "source", "from").drop("due", "from", "source")
    slotted = stage(
        ordered.mapInArrow(_placed, T.StructType([*ordered.schema.fields, T.StructField("slot", T.IntegerType()), T.StructField("at", T.LongType())])), "runs"
    )
    # One row for each partition: a count bounded by the cluster's settings, not by the data.
    slots = slotted.groupBy("slot").agg(F.sum("length").alias("m"))
    bases = slots.select(F.col("slot").alias("k"), (F.sum("m").over(Window.orderBy("slot")) - F.col("m")).alias("base"))
    at = slotted.join(F.broadcast(bases), F.col("slot") == F.col("k")).select("part", "row", "start", "length", (F.col("at") + F.col("base")).alias("at"))
    seq = F.explode(F.expr(f"sequence(at div {window}, (at + length - 1) div {window})")).alias("sequence_id")
    cut = at.select("part", "row", "start", "length", "at", seq)
    begin = F.greatest("at", F.col("sequence_id") * window)
    end = F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * window)
    cut = cut.select(
        F.col("part").alias("part_"),
        F.col("row").alias("row_"),
        F.struct(
            (F.col("start") + begin - F.col("at")).alias("start"), (end - begin).alias("length"), "sequence_id", (begin - F.col("sequence_id") * window).alias("offset")
        ).alias("piece"),
    )
    # All pieces of one document: as many as it has quanta, and window ends among them.
    per_doc = cut.groupBy("part_", "row_").agg(F.collect_list("piece").alias("pieces"))
    joined = toks.join(per_doc, (F.col("part") == F.col("part_")) & (F.col("row") == F.col("row_")))
    piece = F.explode("pieces").alias("piece")
    return joined.select("id", "n", "source", "ids", piece).select(
        F.col("id").alias(id_col),
        F.col("piece.start").alias("start"),
        F.col("piece.length").alias("length"),
        F.expr("substring(ids, int(piece.start * 4 + 1), int(piece.length * 4))").alias("ids"),
        F.col("n").alias("doc_tokens"),
        F.col("piece.sequence_id").alias("sequence_id"),
        F.col("piece.offset").alias("offset"),
        F.col("source").alias(source_col),
    )


def with_crc(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc_of(ids: list[int]) -> int:
    """The checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
