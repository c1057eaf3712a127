"""Packing documents into sequences of CAPACITY tokens: Martello-Toth dominance reduction, then best fit decreasing, over sizes instead of documents.

1. Documents are cut into pieces of at most CAPACITY tokens (runs of non-space characters), and the pieces are counted by size. All that follows on the
   driver works on those at most CAPACITY counts, so it costs the same for any corpus.
2. Reduction: a set {j}, {j, k} or {j, k, b} with the largest piece j is fixed for good when it dominates every other set that could hold j: for each such
   set the other pieces can be exchanged, each or in sums, for no smaller ones of the fixed set. No optimal packing is lost. What is fixed leaves the
   instance, which opens further reductions, until none is left.
3. The rest goes by best fit, largest first: bins of equal content are one entry with a multiplicity, and whole multiplicities are moved at once.
4. The plan says which ranks among the pieces of a size go to which bins. Ranks are counted within hash buckets and offset by the buckets before, so
   that no size, however common, is ranked in one task.

Defined results: null, empty and blank texts have no tokens and take no place; an empty table has no bins. Every row is a document of its own, also if its doc_id
is null or repeated. Texts of any length are cut into as many pieces as they need. Pieces of a size tie, and are ranked by doc_id and start; of bins that fit
alike the last filled is taken. Other columns, of whatever names, aren't read by the query, and are kept by the pipeline's stage: see there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import Scratch, fresh, table
from .mixing import tokens

CAPACITY = 2048
BUCKET_PIECES = 200_000
Pattern = tuple[tuple[int, int], ...]


def _times(counts: np.ndarray, chosen: list[int]) -> int:
    return min(int(counts[s]) // chosen.count(s) for s in chosen)


def dominating(counts: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """A set with one piece of size j that dominates all others with it, or None."""
    rest = counts.copy()
    rest[j] -= 1
    sizes = np.flatnonzero(rest)
    room = capacity - j
    fit = sizes[sizes <= room]
    if not len(fit):
        return [j]
    k = int(fit[-1])
    if k == room:
        return [j, k]
    low = np.repeat(fit[:3], np.minimum(rest[fit[:3]], 3))[:3]
    if len(low) < 2 or low[0] + low[1] > room:
        return [j, k]
    if len(low) == 3 and low.sum() <= room:
        return None
    two = _largest_pair(rest, fit, room)
    if two <= k:
        return [j, k]
    rest[k] -= 1
    others = fit[(fit <= room - k) & (rest[fit] > 0)]
    rest[k] += 1
    if not len(others):
        return None
    b = int(others[-1])
    above = fit[fit > b]
    pair = np.repeat(above[:2], np.minimum(rest[above[:2]], 2))[:2]
    return [j, k, b] if len(pair) < 2 or pair.sum() > room else None


def _largest_pair(rest: np.ndarray, fit: np.ndarray, room: int) -> int:
    """The largest sum of two pieces that fits."""
    at = np.searchsorted(fit, room - fit, "right") - 1
    ok = at >= 0
    same = ok & (fit[np.maximum(at, 0)] == fit) & (rest[fit] < 2)
    at = np.where(same, at - 1, at)
    ok &= at >= 0
    return int((fit[ok] + fit[at[ok]]).max()) if ok.any() else 0


def reduced(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Fixed patterns with multiplicities, and the counts of what is left."""
    counts, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j] and (chosen := dominating(counts, j, capacity)):
                n = _times(counts, chosen)
                for s in chosen:
                    counts[s] -= n
                fixed.append((tuple((s, chosen.count(s)) for s in dict.fromkeys(chosen)), n))
                changed = True
    return fixed, counts


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing, by whole multiplicities: the same bins as one piece at a time gives."""
    room: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    for s in np.flatnonzero(counts)[::-1].tolist():
        m = int(counts[s])
        for r in range(s, capacity + 1):
            if r == capacity:
                room[r].append(((), m))  # empty bins, as many as could be needed
            while m and room[r]:
                pattern, n = room[r].pop()
                q = r // s
                t = min(n, m // q)
                if t:
                    room[r - q * s].append((pattern + ((s, q),), t))
                    m -= t * q
                if t < n and m:
                    if m < q:
                        room[r - m * s].append((pattern + ((s, m),), 1))
                        m, t = 0, t + 1
                if t < n:
                    room[r].append((pattern, n - t))
            if r == capacity:
                room[r].clear()
            if not m:
                break
    return [x for r in room[:-1] for x in r]


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (size, first rank, first bin, slot, place in the bin), sorted: ranks from the first one on go to the bins from the first one on."""
    fixed, rest = reduced(counts, capacity)
    rows, bins, rank = [], 0, np.zeros(capacity + 1, np.int64)
    for pattern, n in fixed + best_fit(rest, capacity):
        slot = place = 0
        for s, copies in pattern:
            for _ in range(copies):
                rows.append((s, rank[s], bins, slot, place))
                rank[s] += n
                slot, place = slot + 1, place + s
        bins += n
    if not np.array_equal(rank, counts):
        raise AssertionError("the plan doesn't place every piece once")
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _assigned(rows: np.ndarray):
    def run(batches):
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            size, rank = batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, size << 44 | rank, "right") - 1
            bins = rows[at, 2] + rank - rows[at, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(rows[at, 3]), pa.array(rows[at, 4]), *(batch.column(n) for n in names)], ["bin_id", "slot", "place", *names])

    return run


def _pieces(capacity: int, text_at: int):
    """Of each struct row: its pieces as (doc_id, start, n_tokens, row), where the row has the piece's text. The pieces of a text make it up again."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True

    def run(batches):
        for batch in batches:
            whole = batch.column("row")
            for r0, data, offsets in K.blocks(whole.field(text_at), lower=False):
                token = ~space[data]
                token[1:] &= space[data[:-1]]
                heads = offsets[:-1][offsets[:-1] < len(data)]
                token[heads] = ~space[data[heads]]
                place = np.append(np.flatnonzero(token), len(data))
                first = np.searchsorted(place, offsets)
                n = np.diff(first)
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                begin = np.where(k == 0, offsets[row], place[np.minimum(first[row] + k * capacity, len(place) - 1)])
                last = k == many[row] - 1
                end = np.where(last, offsets[row + 1], place[np.minimum(first[row] + (k + 1) * capacity, len(place) - 1)])
                raw = data.tobytes()
                texts = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary()).cast(pa.string())
                mine = whole.take(pa.array(row + r0))
                fields = [texts if i == text_at else mine.field(i) for i in range(mine.type.num_fields)]
                cut = pa.StructArray.from_arrays(fields, fields=[f.with_type(pa.string()) if i == text_at else f for i, f in enumerate(mine.type)])
                start = k * capacity
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + r0)), pa.array(start), pa.array(np.minimum(capacity, n[row] - start)), cut], ["doc_id", "start", "n_tokens", "row"])

    return run


def _planned(pieces: DataFrame, capacity: int, own, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """The pieces (with n_tokens, n, doc_id and start) with the rank of the first of each row's n pieces, and the plan. own orders what a bucket holds."""
    n = pieces.agg(F.sum("n")).collect()[0][0] or 0
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(8, n // BUCKET_PIECES))).alias("bucket")
    counted = scratch.save(pieces.select("n_tokens", bucket, "n").groupBy("n_tokens", "bucket").agg(F.sum("n").alias("n")), "counted")
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect():
        counts[r["n_tokens"]] = r["n"]
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counted.select("n_tokens", "bucket", before(Window.partitionBy("n_tokens").orderBy("bucket")).alias("offset"))
    inside = pieces.select("*", bucket).withColumn("own", before(Window.partitionBy("n_tokens", "bucket").orderBy(*own)))
    ranked = inside.join(offset, ["n_tokens", "bucket"]).withColumn("rank", F.col("own") + F.col("offset"))
    return ranked.drop("own", "offset", "bucket"), plan(counts, capacity)


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(x, T.LongType()) for x in names]


def packed(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """(bin_id, slot, place in the bin, doc_id, start in the document, n_tokens) of all pieces."""
    scratch = scratch or Scratch(spark)
    sized = scratch.save(docs.select("doc_id", tokens().alias("tokens")).where("tokens > 0"), "sizes")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(capacity).cast("long")))
    pieces = sized.select("doc_id", "tokens", start.alias("start")).select("doc_id", "start", F.least(F.lit(capacity), F.col("tokens") - F.col("start")).cast("long").alias("n_tokens"), F.lit(1).alias("n"))
    ranked, rows = _planned(pieces, capacity, ("doc_id", "start"), scratch)
    return ranked.select("doc_id", "start", "n_tokens", "rank").mapInArrow(_assigned(rows), T.StructType(_longs("bin_id", "slot", "place", "doc_id", "start", "n_tokens")))


def packed_rows(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """The same with a struct of the document's columns, row, that has the piece's text. Pieces are ranked by narrow keys, of which equal pieces have one and
    count; the texts then meet their key's ranks in a join by its hash, so that no size, however common, brings many texts to one task."""
    scratch = scratch or Scratch(spark)
    row = docs.select(F.col("doc_id").cast("long"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cut = row.mapInArrow(_pieces(capacity, docs.columns.index("text")), T.StructType([*_longs("doc_id", "start", "n_tokens"), row.schema["row"]]))
    cut = scratch.save(cut.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "start", "n_tokens", F.xxhash64(F.col("doc_id").isNull(), "row.text").alias("hash"), "row"), "pieces")
    key = ["doc_id", "start", "n_tokens", "hash"]
    keys = scratch.save(cut.groupBy(*key).agg(F.count("*").alias("n")), "keys")
    ranked, rows = _planned(keys, capacity, ("doc_id", "start", "hash"), scratch)
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))) - 1
    whole = cut.withColumn("copy", copy).join(ranked.select(*key, "rank").hint("shuffle_hash"), key).withColumn("rank", F.col("rank") + F.col("copy"))
    return whole.select("start", "n_tokens", "row", "rank").mapInArrow(_assigned(rows), T.StructType([*_longs("bin_id", "slot", "place", "start", "n_tokens"), row.schema["row"]]))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: bin_id, slot, place, start and n_tokens, then the document's columns, where text is the piece's (the pieces of a text make it up
    again) and n_chars its length. If documents have columns of the first names, those of the bins get underscores before them."""
    out = packed_rows(spark, docs)
    bins = ["bin_id", "slot", "place", "start", "n_tokens"]
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.length("row.text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[F.col(b).alias(name) for b, name in zip(bins, fresh(docs.columns, *bins))], *columns)
