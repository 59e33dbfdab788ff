"""What is counted to order shingles stays as little however many partitions the documents have."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import near_dedup as N
from shelfspark.llm.shingles import shingle_set


def test_counts_are_a_row_a_task_and_ranks_are_those_of_all(spark):
    texts = [(i, f"common words of all and {i} of its own {i * 7}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(30)
    crowd = docs.select("doc_id", F.col("doc_id").alias("comp"))
    assert N._shingle_counts(docs, crowd, 2).count() <= N.ORDER_TASKS
    total = np.zeros(1 << N.ORDER_BITS, np.int64)
    for _, text in texts:
        np.add.at(total, (shingle_set(text.encode(), 2) >> np.uint64(64 - N.ORDER_BITS)).astype(np.int64), 1)
    assert (N._rarity(docs, crowd, 2) == np.minimum(255, np.log2(1 + total) * 12).astype(np.uint8)).all()
