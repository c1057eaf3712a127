"""A Bloom filter of bounded size, made by the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel as K


class Bloom:
    """A set of hashes that may say yes too often, never no wrongly. Its size is bounded; a full one lets all through."""

    BITS = (1 << 20, 1 << 29)

    def __init__(self, n: int):
        self.bits = int(np.clip(1 << int(np.ceil(np.log2(max(n, 1) * 12))), *self.BITS))
        self.table = np.zeros(self.bits >> 3, np.uint8)

    def _places(self, h: np.ndarray):
        for k in (1, 2, 3):
            p = K.mix(h + np.uint64(k)) & np.uint64(self.bits - 1)
            yield (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, p & np.uint64(7)).astype(np.uint8)

    def add(self, h: np.ndarray) -> None:
        for byte, bit in self._places(h):
            np.bitwise_or.at(self.table, byte, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for byte, bit in self._places(h):
            out &= (self.table[byte] & bit) > 0
        return out


def bloom_of(spark: SparkSession, rows: DataFrame, hashed=lambda batch: batch.column(0).to_numpy().view(np.uint64)):
    """A broadcast Bloom filter of what hashed makes of batches of rows (by default the first column), made by the executors in parts and joined bit by bit; only pages that aren't empty are sent."""
    n = rows.count()

    def run(batches):
        mine = Bloom(n)
        for batch in batches:
            mine.add(np.unique(hashed(batch)))
        for at in np.flatnonzero(mine.table.reshape(-1, 4096).any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(at)], pa.int32()), pa.array([mine.table[at * 4096 : (at + 1) * 4096].tobytes()], pa.binary())], ["page", "bits"])

    def joined(t: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"page": t.column("page").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = Bloom(n)
    parts = max(1, min(8, n // 200_000))
    for r in rows.coalesce(parts).mapInArrow(run, "page int, bits binary").groupBy("page").applyInArrow(joined, "page int, bits binary").toLocalIterator():
        out.table[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)
