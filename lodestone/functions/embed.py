"""A deterministic embedder for runs without a provider: signed feature hashing of words, of length one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import bounded_batches

WIDTH = 64


def embedded(rows: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, vector): words hash to a dimension and a sign, the square roots of their counts add up. No words, no vector.

    Words are hashed by Spark, so a text goes to Python as numbers; a batch's sums are one pass over them.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    hashed = bounded_batches(rows).select(F.col(key).cast("long").alias("key"), F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            order = np.lexsort((values, row))
            row, values = row[order], values[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (values[1:] != values[:-1]))) if len(row) else np.array([], np.int64)
            weight = np.sqrt(np.diff(np.append(first, len(row))).astype(float))
            kind, sign = values[first].astype(np.uint64), np.where(values[first] < 0, -1.0, 1.0)
            place = row[first] * width + ((kind >> np.uint64(8)) % np.uint64(width)).astype(np.int64)
            out = np.bincount(place, weights=weight * sign, minlength=batch.num_rows * width).reshape(-1, width)
            length = np.linalg.norm(out, axis=1)
            vectors = (out / np.where(length > 0, length, 1)[:, None]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v if n > 0 else None for v, n in zip(vectors, length, strict=True)], pa.list_(pa.float64()))], ["key", "vector"])

    return hashed.mapInArrow(run, "key long, vector array<double>").withColumnRenamed("key", key)
