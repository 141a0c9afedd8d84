"""Operator 10: quality classifier, a factorisation machine.

Features are hashed lower-case words (logarithmic counts, scaled to unit length), structure statistics of the text and
its length as metadata.  The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

whose last term holds all pairwise interactions of rank ``FACTORS`` in time linear in the features.

Training takes at most ``SAMPLE`` labelled rows of either label, chosen by a hash of their id, so what
reaches the driver is bounded; scoring covers every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, only, small_batches, tidy

BUCKETS = 1 << 14
FACTORS = 8
#: The most rows of either label that training takes.
SAMPLE = 4000
THRESHOLD = 0.7

_marks = re.compile(r"[^\w\s.,;:'\"?()-]")
_stops = re.compile(r"[.,;:?]")
_digits = re.compile(r"\d")
STATISTICS = 12


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: structure statistics first, then hashed words."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    lower = text.lower()
    counts = Counter(lower.split())
    lines = text.split("\n")
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    upper = sum(map(str.isupper, words)) if n else 0
    marks = _marks.findall(text)
    stats = [
        np.log1p(n) / 10,
        np.log1p(chars) / 12,
        min(chars * per_word / 10, 3.0),
        upper * per_word,
        min(len(marks) * per_word, 3.0),
        len(_digits.findall(text)) * per_char * 5,
        min(len(_stops.findall(text)) * per_word * 2, 3.0),
        len(counts) * per_word,
        max(counts.values(), default=0) * per_word,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 5,
        float(n == 0),
    ]
    sums: dict[int, float] = {}
    for w, c in counts.items():
        k = STATISTICS + zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        sums[k] = sums.get(k, 0.0) + c
    idx = np.fromiter(sums, np.int32, len(sums))
    val = np.log1p(np.fromiter(sums.values(), np.float64, len(sums)))
    if len(val):
        val /= np.linalg.norm(val)
    return np.concatenate((np.arange(STATISTICS, dtype=np.int32), idx)), np.concatenate((np.array(stats), val)).astype(np.float32)


@dataclass
class Machine:
    """Weights of a factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For rows laid end to end, each with at least one feature."""
        x = val[:, None]
        v = self.factors[idx] * x
        sums = np.add.reduceat(v, starts, axis=0, dtype=np.float64)
        squares = np.add.reduceat((v * v).sum(1, dtype=np.float64), starts)
        return self.bias + np.add.reduceat(self.linear[idx] * val, starts, dtype=np.float64) + 0.5 * ((sums * sums).sum(1) - squares)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.08, seed: int = 3) -> Machine:
    """Adagrad on the logistic loss, both labels with equal weight in total."""
    rng = np.random.default_rng(seed)
    size = STATISTICS + BUCKETS
    m = Machine(0.0, np.zeros(size, np.float32), (rng.standard_normal((size, FACTORS)) * 0.02).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        m.bias = 4.0 if not len(labels) or labels[0] == 1 else -4.0
        m.factors[:] = 0
        return m
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum()))
    g_linear, g_factors, g_bias = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 32):
            batch = order[s : s + 32]
            idx = np.concatenate([rows[i][0] for i in batch])
            val = np.concatenate([rows[i][1] for i in batch])
            lengths = np.array([len(rows[i][0]) for i in batch])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            z = m.logits(idx, val, starts)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weight[batch] / len(batch)
            each = np.repeat(err, lengths).astype(np.float32)
            v = m.factors[idx]
            sums = np.add.reduceat(v * val[:, None], starts, axis=0)
            grad_v = each[:, None] * val[:, None] * (np.repeat(sums, lengths, axis=0) - v * val[:, None])
            at, back = np.unique(idx, return_inverse=True)
            lin, fac = np.zeros(len(at), np.float32), np.zeros((len(at), FACTORS), np.float32)
            np.add.at(lin, back, each * val)
            np.add.at(fac, back, grad_v)
            lin += 1e-5 * m.linear[at]
            fac += 1e-4 * m.factors[at]
            g_linear[at] += lin * lin
            g_factors[at] += fac * fac
            m.linear[at] -= rate * lin / np.sqrt(g_linear[at])
            m.factors[at] -= rate * 0.3 * fac / np.sqrt(g_factors[at])
            g_bias += float(err.sum()) ** 2
            m.bias -= rate * float(err.sum()) / g_bias**0.5
    return m


def held_out(id_col: str) -> F.Column:
    """Rows whose labels are never learnt; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Train on at most ``sample`` labelled documents of either label that are not held out.

    Labels other than 0 and 1 and null ids are left out; of repeated labels of an id the least counts.
    """
    small_batches(documents.sparkSession)
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out("doc_id"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = None
    for y in (0, 1):
        part = known.where(f"quality = {y}").orderBy(*order).limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample rows of two numbers.
    ids = chosen.toPandas()
    wanted = documents.sparkSession.createDataFrame(ids.astype("int64"), "id_ long, quality long") if len(ids) else None
    if wanted is None:
        return train([], np.zeros(0))
    texts = only(documents, "doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("id_")).select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                names=["doc_id", "quality", "idx", "val"],
            )

    found: pd.DataFrame = texts.mapInArrow(tidy(run), "doc_id long, quality long, idx binary, val binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(found["idx"], found["val"])]
    return train(rows, found["quality"].to_numpy().astype(np.float64))


def score(df: DataFrame, machine: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``df`` and the score, between 0 and 1, of every whole text.

    Null texts count as empty; empty texts are scored by their structure.  Repeated rows get equal scores.
    """
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(machine)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            out = []
            texts = b.column(at)
            for s in range(0, b.num_rows, 200):
                made = [features(x) for x in texts.slice(s, 200).to_pylist()]
                starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in made])[:-1]))
                z = m.logits(np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]), starts)
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*b.schema.names, name])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(only(documents, "doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, all columns kept."""
    name = free_name(documents, "score")
    return score(documents, fit(documents, labels), name=name).where(F.col(name) >= threshold).drop(name)
