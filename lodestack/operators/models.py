"""Running models over rows: a model is made once for each batch stream on an executor; finished rows are not run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes a batch of rows; returns any number of rows for them.
Runner = Callable[[pd.DataFrame], pd.DataFrame]

PREDICTIONS = "image_id long, model_name string, pred_class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def run_model(df: DataFrame, make: Callable[[], Runner], schema: str) -> DataFrame:
    """What the runner that ``make`` builds on the executors returns for all rows; an empty table gives an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = None
        for batch in batches:
            if len(batch):
                runner = runner or make()
                yield runner(batch)

    return df.mapInPandas(run, schema)


def unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones, so that a stopped job can go on; rows with a null key never count as finished."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def shaped(raw: DataFrame, least: float, centred: bool = False) -> DataFrame:
    """Predictions of at least a confidence: six decimals, corners and sizes with two.

    Boxes come as corners ``x1 y1 x2 y2``, or ``centred`` as centre and size in the same columns.  Rows without a
    confidence are dropped.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    if centred:
        x1, y1, x2, y2 = x1 - x2 / 2, y1 - y2 / 2, x1 + x2 / 2, y1 + y2 / 2
    sides = {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "width": x2 - x1, "height": y2 - y1}
    kept = raw.where(F.col("confidence") >= least)
    return kept.withColumns({n: F.bround(v, 2) for n, v in sides.items()} | {"confidence": F.bround("confidence", 6)})


def with_fallback(df: DataFrame, scored: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """Every row with its results; where the model gave none, the values of ``columns``.  One result for each key."""
    results = scored.select(F.col(key).alias("key_"), *[F.col(c).alias(f"got_{c}") for c in columns], F.lit(True).alias("found_"))
    joined = df.join(results, F.col(key) == F.col("key_"), "left")
    filled = [F.when(F.col("found_"), F.col(f"got_{c}")).otherwise(F.lit(v)).alias(c) for c, v in columns.items()]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *filled)
