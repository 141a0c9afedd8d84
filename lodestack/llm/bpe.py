"""Operator 1: byte-level BPE encoding and decoding by corpus-level merge replay.

A task's texts are its corpus slice: their distinct words are encoded together (see
``merges``), then every text is spelled out of encoded words.  Texts stay where they are;
nothing is shuffled, so hot keys and groups of copies do not matter.  Memory is bounded by
one slice of texts (``SLICE_BYTES``) and the word cache.

Null texts count as empty.  Empty texts have no ids and decode to no bytes.  Repeated rows
give repeated results; other columns are kept, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import only, small_batches
from .merges import MergeTable, WordCache

SLICE_BYTES = 8_000_000
CACHE_WORDS = 300_000


class ByteBpe:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        self.table = MergeTable.from_ranks(path)
        self.pattern = regex.compile(pattern)
        self.odd = re.compile(r" \s| $")
        self.cache = WordCache(CACHE_WORDS)

    def _words(self, chunk: str) -> list[str]:
        """Matches of the pattern; letters after a space, with a mark behind them or not, need no search."""
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        if chunk[-1] in ".,;:" and chunk[1:-1].isalpha() and chunk[0] == " ":
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _pack(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of text, each cut by the pattern into words."""
        cut = [self._words(c) for c in chunks]
        words = dict.fromkeys(itertools.chain.from_iterable(cut))
        packed = dict(zip(words, self.table.encode([w.encode("utf-8", "surrogatepass") for w in words])))
        return [packed[ws[0]] if len(ws) == 1 else b"".join([packed[w] for w in ws]) for ws in cut]

    def _chunks(self, text: str) -> list[str]:
        """Pieces at whose ends no match of the pattern goes on.

        A single space before a non-space starts a match.  Texts with spaces in a row, or at
        the end, are one piece.
        """
        if not text or self.odd.search(text):
            return [text] if text else []
        parts = text.split(" ")
        return ([parts[0]] if parts[0] else []) + [" " + p for p in parts[1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts (little-endian, four bytes each), a slice at a time."""
        cut = [self._chunks(t) for t in texts]
        self.cache.learn(dict.fromkeys(itertools.chain.from_iterable(cut)), self._pack)
        get = self.cache.__getitem__
        return [b"".join(map(get, cs)) for cs in cut]

    def decode(self, packed: bytes) -> bytes:
        """Bytes that packed ids stand for."""
        return b"".join(map(self.table.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_held: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process."""
    if (path, pattern) not in _held:
        gc.disable()  # the caches hold no cycles, and walking them takes long
        _held[path, pattern] = ByteBpe(path, pattern)
    return _held[path, pattern]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Batches gathered until their texts have ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and packed ``ids`` of every row of ``df``."""
    small_batches(df.sparkSession)
    source = only(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for t in slices(batches, text_col, SLICE_BYTES):
            packed = c.encode([x or "" for x in t[text_col].to_pylist()])
            yield from pa.table({id_col: t[id_col], "ids": pa.array(packed, pa.binary())}).to_batches()

    schema = T.StructType([source.schema[id_col], T.StructField("ids", T.BinaryType())])
    return source.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded``, the bytes of ``ids_col``; null ids stay null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = [None if x is None else c.decode(x) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, keeping of either only counts and digests.

    Both happen in one pass, so that neither ids nor bytes leave the Python worker.
    """
    small_batches(df.sparkSession)
    source = only(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for t in slices(batches, text_col, SLICE_BYTES):
            packed = c.encode([x or "" for x in t[text_col].to_pylist()])
            out = pa.table(
                {
                    id_col: t[id_col],
                    "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                    "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                    "decoded_sha256": [hashlib.sha256(c.decode(p)).hexdigest() for p in packed],
                }
            )
            yield from out.to_batches()

    schema = T.StructType(
        [
            source.schema[id_col],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return source.mapInArrow(run, schema)
