"""What Python workers keep between tasks."""

import random
import time

import public_tokenizers as public
import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.llm import packing

PATH = public.path("word_bpe_49k.json")


def test_workers_hand_memory_back(spark):
    """After a task with many words, workers keep neither the words nor the memory: later steps run beside them."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(60_000))) for i in range(4)], "doc_id long, text string")
    packing.tokenised(docs.coalesce(1).withColumn("source", F.lit("s")), PATH, 2, "doc_id", "text", "source").write.format("noop").mode("overwrite").save()

    def look(batches):
        for _ in batches:
            time.sleep(0.2)
            resident, shared = map(int, open("/proc/self/statm").read().split()[1:3])
            yield pa.RecordBatch.from_pydict({"mb": [(resident - shared) * 4096 >> 20], "words": [sum(len(t.cache) for t in packing._held.values())]})

    seen = spark.range(0, 16, 1, 16).mapInArrow(look, "mb long, words long").collect()
    assert max(r.words for r in seen) < 100_000 and max(r.mb for r in seen) <= 160, seen
