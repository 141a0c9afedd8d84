"""Near copies of whole texts: MinHash bands of word shingles, verified by exact Jaccard similarity.

SimHash distances of two bits reach almost identical texts only.  Here texts whose bands collide are compared by the
similarity of their shingle sets, as the paragraphs of operator 6 are, and links are closed to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Maybe, Scratch, free_name, only, small_batches, stage, tidy
from .components import components
from .jaccard import bucket_links, bucket_rows
from .paragraphs import RECALL, ROWS, Sketcher, WordHashes, bands_for, segment_shingles, shingle_hashes, words_of


def _sketches(df: DataFrame, id_col: str, text_col: str, bands: int, k: int, seed: int) -> DataFrame:
    """``cls``, a number of its own, id, text and band keys of every text that has words."""
    source = only(df, id_col, text_col).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sketch, place = WordHashes(), Sketcher(bands, ROWS, seed), TaskContext.get().partitionId() << 40
        for b in batches:
            rows, keys = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                h = seen.of(words_of(text or ""))
                if len(h):
                    rows.append(i)
                    keys.append(sketch.keys(*segment_shingles(h, shingle_hashes(h, k), np.array([0]), np.array([len(h)]), k))[0].view(np.int64))
            if rows:
                some = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(place, place + len(rows))), some.column(0), some.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["cls", "id", "text", "keys"]
                )
                place += len(rows)

    return source.mapInArrow(tidy(run), f"cls long, id {source.schema['id'].dataType.simpleString()}, text string, keys array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """``cls`` and ``sh``, the hashes of the distinct shingles of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            for s in range(0, b.num_rows, 50):
                part, sets = b.slice(s, 50), []
                for text in part.column(1).to_pylist():
                    h = seen.of(words_of(text))
                    own, _ = segment_shingles(h, shingle_hashes(h, k), np.array([0]), np.array([len(h)]), k)
                    sets.append(np.unique(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "sh"])

    return texts.select("cls", "text").mapInArrow(tidy(run), "cls long, sh array<long>")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words_per_shingle: int = 5, recall: float = RECALL, seed: int = 13) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component of similar texts, all columns kept.

    Texts without words link with nothing.  Rows with a null id stay.
    """
    small_batches(df.sparkSession, 1000)
    with Scratch(df.sparkSession, "near-copies") as scratch:
        texts = scratch.stage(_sketches(df, id_col, text_col, bands_for(threshold, recall=recall), words_per_shingle, seed), "sketches")
        met = bucket_rows(texts.select(F.explode("keys").alias("key"), "cls"), scratch)
        held = Maybe(met.select("cls")).of(texts, "cls")
        roots = components(bucket_links(met.join(_sets(held, words_per_shingle), "cls"), threshold, scratch))
        named = roots.join(texts.select("cls", "id"), F.col("node") == F.col("cls")).select("root", "id")
        least = named.groupBy("root").agg(F.min("id").alias("least"))
        name = free_name(df, "id_")
        gone = stage(named.join(least, "root").where("id <> least").select(F.col("id").alias(name)).distinct(), "copies")
    return df.join(gone, df[id_col] == gone[name], "left_anti")
